import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from attesta.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens, special_tokens={})


def test_round_trip_and_ids(spark, odd_docs, no_docs, ranks, library):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(-1, "ab" * 3000 + "é" * 500), (-2, "  \n\n \u2003x\u0085y it's I'LL 12,5"), (-3, "\u1680a\x1cb\x1fc")], docs.schema))
    rows = bpe.decode(bpe.encode(docs, ranks, cache_docs=50, cache_pieces=500), ranks).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    once = bpe.encode(docs, ranks, cache_docs=50, cache_pieces=500, back=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, rows))
    assert bpe.encode(no_docs.drop("ids"), ranks, cache_docs=5, cache_pieces=5).count() == 0


def test_folds_agree(spark, ranks, library):
    pieces = sorted({w for t in ("Ein übermäßig langes Wort", " thhathanerst", "aaaaaaaaaaaaaa", "漢字かな", "🙂🙂", "\x00") for w in t.split(" ")} | {" ciónmentellos"} - {""})
    rows = spark.createDataFrame([(p,) for p in pieces if p], "piece string").select("piece", bpe.encode_piece(F.col("piece"), ranks).alias("ids")).collect()
    for r in rows:
        assert list(r["ids"]) == bpe.merge_bytes(r["piece"].encode(), ranks.tokens) == library._encode_single_piece(r["piece"])


def test_every_token_is_reached(ranks):
    assert not ranks.unreached


def test_pair_table_is_exact(ranks):
    shift, owner, rank = ranks.placed
    pairs = {(int(a), int(b)): int(c) for a, b, c in ranks.pairs}
    assert all(owner[shift[a] + b] == a and rank[shift[a] + b] == c for (a, b), c in pairs.items())
    assert sum(o >= 0 for o in owner) == len(pairs)
