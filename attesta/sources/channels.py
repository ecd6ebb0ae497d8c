"""Chat-channel events: normalisation, source URIs and ingestion jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import guards, ids

# Alternative JSON keys of each normalised field, first non-empty wins.
ROOM_KEYS = {
    "conversation_id": ["roomId", "room_id", "conversationId", "conversation_id"],
    "message_id": ["id", "messageId", "message_id", "webhook_id", "@conversation_id"],
    "actor_id": ["personId", "actorId", "personEmail", "from"],
    "display_name": ["personEmail", "personDisplayName", "displayName", "@actor_id"],
    "thread_id": ["parentId", "threadId", "thread_id"],
    "reply_target": ["parentId", "replyTarget", "reply_target"],
    "auth_scope": ["authScope", "auth_scope", "=internal"],
    "text": ["text", "markdown", "body"],
    "event_id": ["eventId", "event_id", "id", "@message_id"],
}
CHAT_KEYS = {
    "conversation_id": ["M.chat.id", "chat_id", "conversation_id"],
    "message_id": ["M.message_id", "message_id", "update_id", "@conversation_id"],
    "actor_id": ["M.from.id", "from.id", "from_id", "M.from.username", "=unknown"],
    "display_name": ["M.from.username", "M.from.first_name", "M.from.last_name", "@actor_id"],
    "thread_id": ["M.message_thread_id", "M.reply_to_message.message_id", "@message_id"],
    "reply_target": ["M.reply_to_message.message_id", "M.message_thread_id", "@message_id"],
    "auth_scope": ["auth_scope", "M.auth_scope", "=internal"],
    "text": ["M.text", "M.caption"],
    "event_id": ["update_id", "M.update_id", "@message_id"],
}
CHAT_ENVELOPES = ["message", "edited_message", "channel_post"]
OPTIONAL = {"thread_id", "reply_target"}


def source_uri(channel: Column, conversation: Column, message: Column) -> Column:
    scheme = F.when(channel == "webex", F.lit("webex://rooms/")).when(channel == "telegram", F.lit("telegram://chats/"))
    prefix = F.coalesce(scheme, F.concat(channel, F.lit("://conversations/")))
    return F.concat(prefix, conversation.cast("string"), F.lit("/messages/"), message.cast("string"))


def _present(value: Column) -> Column:
    """NULL for values that a dynamic language would treat as false."""
    return F.when(~value.isin("", "0", "false", "null", "{}", "[]"), value)


def normalize_events(events: DataFrame, channel: str, payload: str = "payload") -> DataFrame:
    """Canonical message columns from raw JSON events, next to the original columns."""
    keys = CHAT_KEYS if channel == "telegram" else ROOM_KEYS
    raw = lambda path: _present(F.get_json_object(F.col(payload), f"$.{path}"))

    def lookup(path: str, done: dict[str, Column]) -> Column:
        if path.startswith("="):
            return F.lit(path[1:])
        if path.startswith("@"):
            return F.nullif(done[path[1:]], F.lit(""))
        if path.startswith("M."):
            wrapped = F.lit(None).cast("string")
            for envelope in reversed(CHAT_ENVELOPES):
                wrapped = F.when(raw(envelope).isNotNull(), raw(f"{envelope}.{path[2:]}")).otherwise(wrapped)
            bare = F.coalesce(*[raw(e) for e in CHAT_ENVELOPES]).isNull()
            return F.when(bare, raw(path[2:])).otherwise(wrapped)
        return raw(path)

    done: dict[str, Column] = {}
    for name, paths in keys.items():
        value = F.coalesce(*[lookup(p, done) for p in paths])
        done[name] = value if name in OPTIONAL else F.coalesce(value, F.lit(""))
    named = {k: v for k, v in done.items()}
    return events.withColumns({"channel": F.lit(channel), **named, "source_uri": source_uri(F.lit(channel), done["conversation_id"], done["message_id"])})


def message_jobs(messages: DataFrame, kind: str = "room") -> DataFrame:
    """One job for the message text and one per attachment.

    ``messages`` has ``channel, conversation_id, message_id, text`` and
    ``attachments ARRAY<STRUCT<name, content BINARY>>``.
    """
    base = F.concat(F.col("channel"), F.lit(f"://{kind}s/"), F.col("conversation_id"), F.lit("/messages/"), F.col("message_id"))
    key = lambda suffix: F.concat_ws(":", F.col("conversation_id"), F.col("message_id"), suffix)
    binary = lambda c: c.cast("binary")
    message = F.struct(
        F.concat(base, F.lit("#message")).alias("source_uri"), key(F.lit("message")).alias("source_key"), binary(F.col("text")).alias("content"),
        F.lit("document").alias("source_type"), F.lit("text/plain").alias("mime_type"), F.concat(F.col("channel"), F.lit("-message")).alias("parser_hint"),
    )
    attachments = F.transform(
        F.coalesce(F.col("attachments"), F.array().cast("array<struct<name:string,content:binary>>")),
        lambda a: F.struct(
            F.concat(base, F.lit("/attachments/"), a["name"]).alias("source_uri"), key(a["name"]).alias("source_key"), a["content"].alias("content"),
            guards.classify(a["name"])["source_type"].alias("source_type"), guards.canonical_mime(a["name"]).alias("mime_type"),
            F.concat(F.col("channel"), F.lit("-attachment")).alias("parser_hint"),
        ),
    )
    jobs = messages.select("channel", "conversation_id", "message_id", F.inline(F.concat(F.array(message), attachments)))
    hashed = jobs.withColumns({"source_id": ids.ingest_source_id(F.col("channel"), F.col("source_key")), "content_hash": F.sha2(F.col("content"), 256)})
    return hashed.withColumn("job_id", ids.job_id(F.col("channel"), F.col("source_id"), F.col("content_hash"), F.col("parser_hint"))).drop("source_key")
