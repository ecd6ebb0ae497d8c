import re

from pyspark.sql import functions as F

from attesta.functions import extract as X
from attesta.functions import guards as G
from attesta.functions import redact as R
from attesta.functions import text as T

TEXTS = ["source_version_id of Straße foo.bar:baz", "", "a\r\n\nb c\n", "ÉTÉ_x/y-z 12.5 ΣΟΦΟΣ", "no\x0btabs end"]


def one(spark, *columns, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_terms_match_driver_side_terms(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.lexical_terms(F.col("t")).alias("terms")).collect()
    for row in rows:
        assert set(row.terms) == set(T.query_terms(row.t))


def test_splitlines_agrees_with_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS + ["\n", "a\u2028b\x85c", "x\n\n"]], "t string").select("t", T.splitlines(F.col("t")).alias("l")).collect()
    for row in rows:
        assert row.l == row.t.splitlines()


def test_lexical_score_is_share_of_query_terms(spark):
    assert one(spark, T.lexical_score(F.col("t"), ["a", "b", "zz"]), text="b a b")[0] == 2 / 3
    assert one(spark, T.lexical_score(F.col("t"), []))[0] == 0.0


def test_term_score_counts_substrings(spark):
    assert one(spark, T.term_score(F.lower("t"), ["Err", "miss"]), text="An ERROR")[0] == 0.5


def test_token_and_byte_estimates(spark):
    row = one(spark, T.estimated_tokens(F.col("t")), T.estimated_bytes(F.col("t")), text="éé12345")
    assert (row[0], row[1]) == (2, 9)
    assert one(spark, T.estimated_tokens(F.col("t")), text="")[0] == 1


def test_strip_removes_unicode_space(spark):
    assert one(spark, T.strip(F.col("t")), text="  a b \x1c\n")[0] == "a b"


def test_typed_ids_follow_the_whole_mention(spark):
    text = "Request-ID: r1 correlation_id=c1 session id = s1 request_id=correlation-7"
    row = one(spark, *[X.typed_ids(F.col("t"), k) for k in ("correlation", "request", "session")], text=text)
    assert [list(x) for x in row] == [["c1", "correlation-7"], ["r1"], ["s1"]]


def test_timestamps_and_offsets(spark):
    text = "2024-01-02T03:04:05Z 2024-01-02 05:04:05+0200 2024-13-02 03:04:05 2024-01-02T03:04:06.5"
    found = one(spark, X.timestamps(F.col("t")), text=text)[0]
    assert [t.isoformat() for t in found] == ["2024-01-02T03:04:05", "2024-01-02T03:04:06.500000"]


def test_stack_frames_keep_text_order(spark):
    frames = one(spark, X.stack_frames(F.col("t")), text='b/c.java:9 File "x.py", line 3')[0]
    assert [f.raw for f in frames] == ["b/c.java:9", "x.py:3"]


def test_query_table_drops_rules_and_ragged_rows(spark):
    rows = one(spark, X.query_table_rows(F.col("t")), text="id | st\n---+---\n1 | ok\n\n2 | x | y\n 3|no ")[0]
    assert rows == [{"id": "1", "st": "ok"}, {"id": "3", "st": "no"}]
    assert one(spark, X.query_table_rows(F.col("t")), text="plain")[0] == []
    assert one(spark, X.query_table_rows(F.col("t")), text="")[0] == []


def test_schema_objects_and_symbols(spark):
    sql = "CREATE TABLE IF NOT EXISTS a.b (id INT);\nSELECT max(x) FROM c"
    assert one(spark, X.schema_objects(F.col("t")), text=sql)[0][0] == "a.b"
    assert "a.b" not in one(spark, X.symbol_names(F.col("t"), F.lit("db/x.sql")), text="select 1")[0]
    assert one(spark, X.symbol_names(F.col("t"), F.lit("/d/./notes.md")), text="# Head one\ntext")[0] == ["/", "Head one", "d", "notes", "notes.md"]


def test_word_boundaries_are_unicode(spark):
    assert one(spark, X.has_error(F.col("t")), text="éERROR")[0] is False
    assert one(spark, X.has_error(F.col("t")), text="an Error!")[0] is True


def test_redaction_order_and_patterns(spark):
    text = "api_key: abc, token=abcdef Authorization: Bearer zzz https://u:p@svc.internal:8080/x?y http://example.com/internal"
    out = one(spark, R.redact_text(F.col("t"), F.array(F.lit("abc"), F.lit("abcdef"), F.lit(""))), text=text)[0]
    assert out == "api_key: [redacted], token=[redacted] Authorization: Bearer [redacted] [redacted] http://example.com/internal"


def test_redact_metadata_keeps_no_secret(spark):
    meta = F.create_map(F.lit("DB_Password"), F.lit("s3"), F.lit("owner"), F.lit("me"))
    row = one(spark, R.redact_metadata(meta), R.sensitive_values(meta))
    assert row[0] == {"DB_Password": "[redacted]", "owner": "me"} and row[1] == ["s3"]


def test_private_endpoints(spark):
    cases = {"http://10.1.2.3/x": True, "https://a.corp": True, "https://user@x.org/": True, "http://:@x.org/": False, "https://x.org/10.": False, "http:///p": True, "host.lan": True, "see 192.168.1.1": True, "https://x.org": False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.is_private_endpoint(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_sql_guard_column_and_driver_forms_agree(spark):
    statements = ["select 1", " ", "with a as (select 1) select * from a;", "select 1; select 2", "drop table x", "explain select 1", "describe t"]
    rows = spark.createDataFrame([(s,) for s in statements], "t string").select("t", G.sql_rejection(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [G.rejection_reason(s) for s in statements]
    assert [r.r for r in rows] == [None, "empty", None, "multiple statements", "write-capable", "not read-only", None]


def test_template_rendering():
    assert G.render_template("select * from t where a = {{ x }} and b = {{y}}", {"x": "o'k", "y": None}) == "select * from t where a = 'o''k' and b = NULL"
    for bad in ({"x": 1}, {"x": 1, "y": 2, "z": 3}):
        try:
            G.render_template("select {{x}}, {{y}}", bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_safe_paths(spark):
    cases = {"a/b": True, "/a": False, "a/../b": False, "..\\x": False, "./a": True}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", G.is_safe_path(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_looks_like_text(spark):
    rows = spark.createDataFrame([(b"ok",), (b"\x00x",), (b"\xff\xfe",), (b"",)], "b binary").select(G.looks_like_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [True, False, False, True]


def test_language_uses_last_suffix(spark):
    rows = spark.createDataFrame([("a/B.PSM1",), ("x.py.txt",), ("none",)], "t string").select(X.language(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == ["powershell", None, None]
    assert re.fullmatch(X.IDENTIFIER_QUERY, "load_7")


def test_redact_metadata_at_any_depth(spark):
    tree = '{"owner":"x","auth":{"api_key":"k-1","parts":[{"password":"p-2"},"plain"]},"token":["t-3"]}'
    meta = F.create_map(F.lit("title"), F.lit("a"), F.lit("nested"), F.lit(tree), F.lit("secret"), F.lit("s-0"), F.lit("broken"), F.lit("{no json"), F.lit("none"), F.lit(None))
    clean, secrets = one(spark, R.redact_metadata(meta), R.sensitive_values(meta))
    assert not any(s in str(clean) for s in ("k-1", "p-2", "t-3", "s-0")) and set(secrets) == {"k-1", "p-2", "t-3", "s-0"}
    assert clean["title"] == "a" and clean["broken"] == "{no json" and clean["none"] is None and '"plain"' in clean["nested"] and '"owner":"x"' in clean["nested"]


def test_texts_match_their_own_query(spark):
    for text in ("latency 40 µs", "ﬁle", "Straße", "STRASSE ΣΊΣΥΦΟΣ", "İstanbul ŉ ǰ", "Ꭰꭰ"):
        assert one(spark, T.lexical_score(F.lit(text), T.query_terms(text)))[0] == 1.0


def test_csv_cells(spark):
    cells = one(spark, T.csv_cells(F.col("t")), text='_time, "host, name" ,"say ""hi""",,last')[0]
    assert cells == ["_time", "host, name", 'say "hi"', "", "last"]


def test_casefold_of_every_special_character(spark):
    single, several = T.extra_foldings()
    texts = [*single, *several, "", "plain", "É plain", "Straße", "STRAẞE ß ﬁ", "ΑΣ ς Σß", "ΐ" * 3 + "ßß", "".join(several), "ABC" + "".join(single) + "ß"]
    folded = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", T.casefold(F.col("t")).alias("f"))
    for r in folded.collect():
        want = None if r.t is None else "".join(single.get(c, several.get(c, c)) for c in r.t).lower()
        assert r.f == want, r.t
