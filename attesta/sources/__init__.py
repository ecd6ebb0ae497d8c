"""Readers, parsers and adapters that turn raw inputs into evidence rows."""
