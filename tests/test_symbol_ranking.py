"""Symbol-aware ranking collapses the symbols to chunks before its limit."""

from attesta.operators import code_index


def test_one_chunk_with_many_symbols_leaves_room_for_others(spark):
    rows = [("c1", "v1", f"run_z{i}", f"run_z{i}", "function", i) for i in range(6)] + [("c2", "v1", "run_a", "run_a", "function", 50), ("c3", "v2", "run", "run", "function", 1)]
    rows += [(None, "v3", "run_y", "run_y", "function", 2), ("c4", "v1", "other", "other", "function", 3)]
    symbols = spark.createDataFrame(rows, "chunk_id string, source_version_id string, name string, qualified_name string, kind string, line_start int")
    got = {r["chunk_id"]: r["score"] for r in code_index.rank_symbols(symbols, "run", 3).collect()}
    assert got == {"c3": 1.0, "c1": 1 / 2, "c2": 1 / 9}
