import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from attesta.operators.filters import RetrievalFilters
from attesta.operators.store import EvidenceStore
from attesta.sources import channels, files, manifest, parsers
from attesta.streaming import ingest as stream


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"})
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped(**{
    "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="Main" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {M}><si><t>name</t></si><si><t>qty</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {M}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="s"><v>9</v></c><c><v>4</v></c></row></sheetData></worksheet>',
})
PDF = b"%PDF-1.4 stream BT (Hello \\(x\\)) Tj (  ) Tj endstream stream (Page two) TJ endstream \xff"
EML = b"From: a@x.org\r\nSubject: S\r\nMessage-ID: <1>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nBody text\r\n--B\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=\"d.csv\"\r\n\r\na,b\r\n1,2\r\n--B--\r\n"


def parsed(name, data):
    return [(b["text"], b["locator"]) for b in parsers.parse_file(name, data)]


def test_format_parsers():
    assert parsed("a.docx", DOCX) == [("One two", "a.docx#paragraph-1"), ("Three", "a.docx#paragraph-3")]
    assert parsed("a.xlsx", XLSX) == [("name | qty\n9 | 4", "a.xlsx#sheet-1")]
    assert parsed("a.pdf", PDF) == [("Hello (x)", "a.pdf#page-1"), ("Page two", "a.pdf#page-2")]
    assert parsed("a.json", b'{"b":1,"a":[2]}') == [(json.dumps({"a": [2], "b": 1}, indent=2), "a.json")]
    assert parsed("a.xml", b"<r><x>1</x><x>2<y>3</y></x></r>") == [("1 2 3", "a.xml/r[1]"), ("1", "a.xml/r[1]/x[1]"), ("2 3", "a.xml/r[1]/x[2]"), ("3", "a.xml/r[1]/x[2]/y[1]")]
    assert parsed("a.tsv", b"ts_time\tv\n1\t2\n \t \n3\t4\n") == [("ts_time: 1\nv: 2", "a.tsv#row-2"), ("ts_time: 3\nv: 4", "a.tsv#row-4")]
    assert parsed("a.log", b"l1\nl2\n\nl3") == [("l1\nl2", "a.log:L1-L2"), ("l3", "a.log:L4-L4")]
    for name, data in (("a.bin", b"\x00\x01"), ("a.zip", zipped(x="y")), ("a.docx", zipped(x="y"))):
        with pytest.raises(ValueError):
            parsers.parse_file(name, data)


def test_archive_safety(monkeypatch):
    assert [n for n, _ in parsers.archive_members("a.zip", zipped(**{"d/x.txt": "1", "y.txt": "2"}))] == ["d/x.txt", "y.txt"]
    with pytest.raises(ValueError):
        list(parsers.archive_members("a.zip", zipped(**{"../x.txt": "1"})))
    monkeypatch.setattr(parsers, "MAX_EXPANSION_BYTES", 3)
    with pytest.raises(ValueError):
        list(parsers.archive_members("a.zip", zipped(x="12", y="34")))


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.log").write_text("2024-01-01T00:00:00Z ERROR x request_id=r1\n")
    (root / "sub" / "b.csv").write_text("id,name\n1,x\n")
    (root / "pack.zip").write_bytes(zipped(**{"in/c.md": "# Title\ntext", "in/d.sql": "CREATE TABLE t1 (id INT);"}))
    (root / "bad.zip").write_bytes(zipped(**{"../evil.txt": "1"}))
    (root / "broken.json").write_text("{not json")
    (root / "m.eml").write_bytes(EML)
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("e.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    (root / "t.tar.gz").write_bytes(tar.getvalue())
    return root


def test_jobs_expand_and_quarantine(spark, folder):
    jobs = files.parse_jobs(files.ingestion_jobs(files.scan_files(spark, str(folder)), "directory"))
    rows = {r.source_uri.split("/in/", 1)[1]: r for r in jobs.collect()}
    assert set(rows) == {"a.log", "sub/b.csv", "pack.zip/in/c.md", "pack.zip/in/d.sql", "bad.zip", "broken.json", "m.eml#body", "m.eml/attachments/d.csv", "t.tar.gz/e.txt"}
    assert "unsafe" in rows["bad.zip"].error and rows["broken.json"].error and not rows["a.log"].error
    assert rows["pack.zip/in/d.sql"].source_type == "schema" and rows["m.eml/attachments/d.csv"].blocks[0].text == "a: 1\nb: 2"
    assert all(r.job_id.startswith("job_") and len(r.job_id) == 68 for r in rows.values())


def test_stream_ingests_each_file_once(spark, folder, tmp_path):
    store = EvidenceStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream.watch(store, str(folder), str(tmp_path / "ckpt"), domain_id="criminal").awaitTermination()
    assert store.read("jobs").count() == 9
    assert store.read("source_versions").count() == 7
    states = {r.state: r["count"] for r in store.read("lifecycle").groupBy("state").count().collect()}
    assert states["received"] == 9 and states["indexed"] == 7 and states["quarantined"] == 2
    assert store.read("chunks").where("domain_id = 'criminal'").count() >= 7
    (folder / "new.txt").write_text("late file")
    stream.watch(store, str(folder), str(tmp_path / "ckpt"), domain_id="criminal").awaitTermination()
    assert store.read("jobs").count() == 10
    assert store.status(RetrievalFilters()).count() == 8


def test_polling_takes_modified_files_again(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.txt").write_text("one")
    store = EvidenceStore(spark, str(tmp_path / "store"))
    seen = spark.createDataFrame([], "source_uri string, size_bytes long, modified_at timestamp")
    seen = stream.poll(store, str(root), seen, "p0")
    seen = stream.poll(store, str(root), seen, "p1")
    assert store.read("jobs").count() == 1
    (root / "a.txt").write_text("two longer")
    stream.poll(store, str(root), seen, "p2")
    assert store.read("jobs").count() == 2
    assert [r.version_number for r in store.read("source_versions").orderBy("version_number").collect()] == [1, 2]


def test_remote_reader_fetches_each_path_once(spark):
    observed = spark.createDataFrame([("sftp://x/old",)], "source_uri string")
    got = stream.remote_files(spark, ["x/new", "x/old"], observed, lambda p: p.encode()).collect()
    assert [(r.source_uri, bytes(r.content)) for r in got] == [("sftp://x/new", b"x/new")]


def test_chat_update_normalisation(spark):
    update = {"update_id": 9, "edited_message": {"message_id": 5, "chat": {"id": 77}, "from": {"id": 3, "username": "u"}, "caption": "hi", "reply_to_message": {"message_id": 4}}}
    bare = {"message_id": 6, "chat": {"id": 78}, "text": "yo"}
    df = spark.createDataFrame([(json.dumps(update),), (json.dumps(bare),)], "payload string")
    rows = channels.normalize_events(df, "telegram").collect()
    first = rows[0]
    assert (first.conversation_id, first.message_id, first.actor_id, first.display_name, first.text, first.event_id) == ("77", "5", "3", "u", "hi", "9")
    assert (first.thread_id, first.reply_target, first.auth_scope, first.source_uri) == ("4", "4", "internal", "telegram://chats/77/messages/5")
    assert (rows[1].actor_id, rows[1].event_id, rows[1].thread_id) == ("unknown", "6", "6")


def write_manifest(root, **changes):
    import hashlib

    (root / "x.txt").write_text("alpha evidence")
    fixture = {"fixture_id": "f1", "path": "x.txt", "source_id": "s1", "source_type": "document", "domain_id": "d", "acl_scope": "internal", "language": "en", "content_sha256": hashlib.sha256(b"alpha evidence").hexdigest()}
    fixture.update(changes)
    query = {"query_id": "q1", "text": "alpha", "relevant_source_ids": ["s1"]}
    (root / "manifest.json").write_text(json.dumps({"manifest_version": 1, "fixture_set": "t", "default_filters": {"principal_acl_scopes": ["internal"]}, "fixtures": [fixture], "queries": [query]}))


def test_manifest_checks(spark, tmp_path):
    write_manifest(tmp_path)
    fixtures, queries = manifest.load(spark, str(tmp_path))
    assert fixtures.first().content == "alpha evidence" and queries.first().modes == manifest.MODES
    for bad in ({"content_sha256": "0" * 64}, {"path": "../x.txt"}, {"path": "missing.txt"}, {"source_id": ""}):
        write_manifest(tmp_path, **bad)
        with pytest.raises(manifest.ManifestError):
            manifest.load(spark, str(tmp_path))


def test_release_differences(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    actual = manifest.relative_files(spark, str(tmp_path)).drop("content")
    assert manifest.release_differences(actual, actual).count() == 0
    changed = actual.where("path = 'a'").unionByName(spark.createDataFrame([("c", 1, "x")], "path string, size long, sha256 string")).withColumn("size", F.when(F.col("path") == "a", F.lit(9)).otherwise(F.col("size")))
    got = {r.path: r.problem for r in manifest.release_differences(actual, changed).collect()}
    assert got == {"a": "content differs", "b": "not in manifest", "c": "file missing"}
