from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.sources import blocks as B

TEXT = st.lists(st.one_of(st.just(""), st.just("  "), st.text(alphabet="ab ", min_size=1, max_size=30)), max_size=25).map("\n".join)


def walk(lines, limit, newline, overshoot):
    """Line-by-line statement of the packing rules."""
    spans, at = [], 0
    while at < len(lines):
        end, size = at + 1, len(lines[at])
        while end < len(lines) and lines[end].strip():
            grown = size + newline + len(lines[end])
            if (size >= limit) if overshoot else (grown > limit):
                break
            size, end = grown, end + 1
        spans.append((at, end))
        at = end + 1 if end < len(lines) and not lines[end].strip() else end
    return spans


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 60), st.booleans())
def test_spans_follow_the_packing_rules(text, limit, overshoot):
    newline = 0 if overshoot else 1
    lines = text.splitlines()
    assert list(B.block_spans(lines, limit, newline=newline, overshoot=overshoot)) == walk(lines, limit, newline, overshoot)


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a\n\n\nb\nc\n"), (2, "x" * 2000), (3, " \n "), (4, None)], "id int, t string")
    rows = B.explode_blocks(df, B.chunk_blocks(F.col("t")), ["id"]).orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.text, r.line_start, r.line_end) for r in rows] == [(1, 0, "a", 1, 1), (1, 1, "b\nc", 3, 5), (2, 0, "x" * 2000, 1, 1)]


def test_overlap_rereads_lines_and_ends():
    lines = [f"line{i}" for i in range(6)]
    spans = list(B.block_spans(lines, 12, newline=1, overshoot=False, overlap=1))
    assert spans[0] == (0, 2) and spans[-1][1] == 6 and all(b > a for a, b in spans)


def test_few_texts_are_python_objects_at_a_time(spark):
    """Batches are bounded by rows and bytes, and blocks go back to Arrow after TEXTS_AT_ONCE texts."""
    import pyarrow as pa

    from attesta.session import BATCH_CONF, prepare

    texts = ["a\n\nb", None, "", "c"] * B.TEXTS_AT_ONCE
    packed = B._packed(pa.array(texts, pa.string()), lambda t: B.text_blocks(t, 900, newline=1, overshoot=False))
    assert [None if p is None else [x["text"] for x in p] for p in packed.to_pylist()] == [["a", "b"], None, [], ["c"]] * B.TEXTS_AT_ONCE
    assert B._packed(pa.array([], pa.string()), lambda t: []).type == packed.type
    for key in BATCH_CONF:
        spark.conf.unset(key)
    prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 * 1024 * 1024
