"""MinHash near-duplicates by HyperMinHash registers, banding and verification on full sets.

A document's set holds its distinct word shingles. Six hash functions deal the set into 40 buckets
each; a register keeps the least hash of a bucket as its number of leading zeros (6 bits) and the
10 bits behind the leading one. Band j is bucket j of all six functions, so its registers are
independent: sets of similarity s share a band with probability 1 - (1 - s^6)^40 (0.99999998 at
0.85, 0.999995 at 0.8). Pairs from bands are first estimated from the registers, corrected for
accidental equality, and dropped when the estimate is 4.5 standard errors below the threshold; the
others are confirmed on their full sets.

Equal word sequences are one node from the start. Groups never emit all their pairs: in each
round every band key compares its members with one leader, and members already in the leader's
component are skipped. What is left after the rounds, pairs of one key in different components,
is found without listing them all: two sets near the same leader, one of them not linked to it,
can only be similar if they share many of their differences from it, and those are joined with a
prefix filter (``delta_pairs``). So no link is lost.

Defined results: texts without words (and null texts) have an empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows and equal ids are
judged by text; a component without any id has a null component_id; a document is kept if its id
equals component_id (null equals null); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from attesta.llm.common import save, texts, with_arrow_columns
from attesta.llm.graph import components

FUNCTIONS = 6
BUCKETS = 40
MANTISSA_BITS = 10
EMPTY = 0xFFFF
LEADER_ROUNDS = 2
#: Members at least this similar to the leader of their key are compared by their differences from it.
NEAR = 0.1
#: Ids of documents to be compared are broadcast up to this number, joined beyond it.
BROADCAST_IDS = 2_000_000

_SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(FUNCTIONS)], dtype=np.uint64)
_ODD = np.array([0xBF58476D1CE4E5B9 * (2 * i + 1) % 2**64 | 1 for i in range(64)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the blank and TAB..CR, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mix(total * _ODD[i] + h[i : len(words) - k + 1 + i])
    return np.unique(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, bucket by bucket: shape (BUCKETS, FUNCTIONS), EMPTY where nothing fell."""
    out = np.full((BUCKETS, FUNCTIONS), EMPTY, np.uint16)
    for f in range(FUNCTIONS):
        g = _mix(hashes ^ _SEEDS[f])
        bucket, value = g % np.uint64(BUCKETS), (g >> np.uint64(12)).astype(np.int64)  # 52 bits: exact as a double
        least = np.full(BUCKETS, 1 << 52, np.int64)
        np.minimum.at(least, bucket.astype(np.int64), value)
        filled = least < (1 << 52)
        length = np.frexp(least.astype(np.float64))[1]  # bits of the value
        zeros = np.minimum(52 - length, 62)
        mantissa = ((least << (zeros + 1)) >> (52 - MANTISSA_BITS)) & ((1 << MANTISSA_BITS) - 1)
        out[filled, f] = ((zeros << MANTISSA_BITS) | mantissa)[filled]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity from register rows, and the number of registers it rests on.

    Different sets also agree in a register by accident: their least hashes then share the number
    of leading zeros (one time in three) and all mantissa bits.
    """
    used = ~((a == EMPTY) & (b == EMPTY))
    n = np.maximum(used.sum(axis=1), 1)
    chance = 2.0**-MANTISSA_BITS / 3
    equal = ((a == b) & used).sum(axis=1) / n
    return np.maximum(0.0, (equal - chance) / (1 - chance)), n


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), node (fingerprint of the word sequence), n_shingles, regs."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            nodes, counts, regs = [], [], []
            for text in texts(batch):
                words = words_of(text)
                hashes = shingle_set(words, size)
                nodes.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(len(hashes))
                regs.append(registers(hashes).tobytes() if words else None)
            return [pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(regs, pa.binary())]

        return compute

    fields = [T.StructField("node", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("regs", T.BinaryType())]
    return with_arrow_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), fields, make, keep=["doc_id", "th"])


def full_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """node, regs and hashes (sorted set) of the nodes in ``members`` (node, doc_id, regs)."""
    ids = members.select(F.col("doc_id").alias("wanted_id")).distinct()
    if ids.count() <= BROADCAST_IDS:  # eight bytes each
        ids = F.broadcast(ids)
    picked = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            nodes, sets = [], []
            for text in texts(batch):
                words = words_of(text)
                nodes.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sets.append(shingle_set(words, size).astype(np.int64))
            return [pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))]

        return compute

    fields = [T.StructField("node", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))]
    sets = with_arrow_columns(picked, fields, make, keep=["doc_id"])
    own = members.select(F.col("node").alias("own_node"), F.col("doc_id").alias("first_id"), "regs")
    matched = sets.join(own, (F.col("node") == F.col("own_node")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return matched.groupBy("node").agg(F.first("regs").alias("regs"), F.first("hashes").alias("hashes"))


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * |A & B| >= num * |A | B|: estimate first, then the full sets."""
    regs = sets.select("node", "regs")
    both = pairs.join(regs.select(F.col("node").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("node").alias("b"), F.col("regs").alias("rb")), "b")
    threshold = num / den

    def plausible(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            guess, n = estimate(ra, rb)
            likely = guess >= threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / n) - 1e-3
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(likely)) for x in (batch.column(batch.schema.get_field_index("a")), batch.column(batch.schema.get_field_index("b")))], names=["a", "b"])

    likely = both.select("a", "b", "ra", "rb").mapInArrow(plausible, "a binary, b binary")
    hashes = sets.select("node", "hashes")
    full = likely.join(hashes.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return full.select("a", "b", shared.alias("i"), F.size("ha").alias("x"), F.size("hb").alias("y")).where(den * F.col("i") >= num * (F.col("x") + F.col("y") - F.col("i"))).select("a", "b")


def rest_pairs(led: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (node, leader) of one key and different components that may still be similar.

    ``led`` is (key, leader, node, comp). Members near their key's leader are joined on what they
    differ in (:func:`delta_pairs`). Members far from it are paired key by key; by the triangle
    inequality of the Jaccard distance a far member has no link to one that is not far as well.
    """
    of = led.select("leader", "node", "comp").distinct()
    hashes = sets.select("node", "hashes")
    both = of.join(hashes, "node").join(hashes.select(F.col("node").alias("leader"), F.col("hashes").alias("pivot")), "leader")
    less, more = F.sort_array(F.array_except("pivot", "hashes")), F.sort_array(F.array_except("hashes", "pivot"))
    told = both.select("leader", "node", "comp", F.size("pivot").alias("p"), less.alias("less"), more.alias("more")).select("*", F.size("less").alias("a"), F.size("more").alias("b"))
    told = save(told.withColumn("sim", (F.col("p") - F.col("a")) / (F.col("p") + F.col("b"))), "deltas")
    far = led.join(told.where(F.col("sim") <= NEAR + (1 - num / den) + 1e-9).select("leader", "node"), ["leader", "node"], "left_semi")
    other = far.select("key", F.col("node").alias("leader"), F.col("comp").alias("lead_comp"))
    far_pairs = far.select("key", "node", "comp").join(other, "key").where("comp < lead_comp").select("node", "leader")
    return far_pairs.union(delta_pairs(told.where(F.col("sim") >= NEAR), num, den))


def delta_pairs(told: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs near one pivot that may be similar although at least one is not linked to the pivot.

    Let a set lack ``a`` of the pivot's ``p`` elements and have ``b`` others; these are its
    differences. For x and y to reach the threshold, at least

        need = (num (p + bx + by) - den (p - ax - ay)) / (num + den)

    differences must be the same in both, which is more than none if x is not linked to the
    pivot. That is an overlap join on small sets, so a prefix filter applies: the common
    differences stand early enough in both lists, which go from rare to frequent.
    """
    alone = -F.floor(-(num * (F.col("p") + F.col("b")) - den * (F.col("p") - F.col("a"))) / F.lit(num + den))  # need with a y without differences
    kept = told.withColumns({"linked": den * (F.col("p") - F.col("a")) >= num * (F.col("p") + F.col("b")), "n": F.col("a") + F.col("b")})
    each = kept.select("leader", "node", "comp", "p", "a", "b", "n", "linked", F.greatest(alone, F.lit(1)).alias("least"), F.explode(F.concat("more", "less")).alias("difference"))
    each = save(each, "differences")
    counts = each.groupBy("leader", "difference").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("leader", "node").orderBy(F.coalesce("often", F.lit(1)), "difference")  # over the differences of one set
    listed = each.join(counts.where("often > 1"), ["leader", "difference"], "left").withColumn("pos", F.row_number().over(rarest) - 1)
    listed = save(listed.where(F.col("often").isNotNull() & (F.col("pos") <= F.col("n") - F.col("least"))).drop("least", "often"), "prefixes")  # a difference of one set meets nothing
    x = listed.where("not linked")
    y = listed.select("leader", "difference", *[F.col(c).alias(f"{c}_y") for c in ("node", "comp", "a", "b", "n", "linked", "pos")])
    need = -F.floor(-(num * (F.col("p") + F.col("b") + F.col("b_y")) - den * (F.col("p") - F.col("a") - F.col("a_y"))) / F.lit(num + den))
    met = (F.col("comp") != F.col("comp_y")) & (F.col("linked_y") | (F.col("node") < F.col("node_y"))) & (F.col("pos") <= F.col("n") - need) & (F.col("pos_y") <= F.col("n_y") - need)
    on = (F.col("l.leader") == F.col("r.leader")) & (F.col("l.difference") == F.col("r.difference"))
    return x.alias("l").join(y.alias("r"), on & met).select("node", F.col("node_y").alias("leader")).distinct()


def linked(docs: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame | None:
    """(node, comp) of the nodes with links; ``nodes`` is (node, doc_id, regs), one row each."""
    empty = bytes([0xFF] * (2 * FUNCTIONS))
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: F.struct(j.alias("j"), F.col("regs").substr(j * (2 * FUNCTIONS) + 1, F.lit(2 * FUNCTIONS)).alias("r")))).alias("x"))
    keys = bands.where(F.col("x.r") != F.lit(empty)).select(F.xxhash64("x.j", "x.r").alias("key"), "node")
    shared_keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    multi = save(keys.join(shared_keys, "key"), "bands")
    if multi.isEmpty():
        return None
    members = multi.select("node").distinct().join(nodes, "node")
    sets = save(full_sets(docs, members, size), "sets")
    links, labels = None, None
    for turn in range(LEADER_ROUNDS + 1):
        placed = multi.withColumn("comp", F.col("node")) if labels is None else multi.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        leaders = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(min(turn, LEADER_ROUNDS - 1))).alias("p"), F.col("node").alias("leader"), F.col("comp").alias("lead_comp"))).alias("x"), (F.min("comp") != F.max("comp")).alias("mixed"))
        led = placed.join(leaders.where("mixed").select("key", "x.leader", "x.lead_comp"), "key")
        if turn < LEADER_ROUNDS:
            pairs = led.where("comp <> lead_comp").select("node", "leader")
        else:
            pairs = rest_pairs(save(led.select("key", "leader", "node", "comp"), "mixed"), sets, num, den)
        fresh = save(confirmed(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), sets, num, den), "links")
        if fresh.isEmpty():
            continue
        links = fresh if links is None else links.union(fresh)
        labels = components(links)
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th, n_shingles, component_id (least id of the component) and kept, for every row of ``docs``.

    Links join documents whose shingle sets have a similarity of at least ``num / den``.
    """
    base = save(sketches(docs, size), "sketches")
    nodes = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"))
    labels = linked(docs, save(nodes, "nodes"), size, num, den)
    firsts = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    if labels is None:
        classes = firsts.select("node", F.col("first_id").alias("component_id"))
    else:
        own = firsts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = own.join(labels.select("node"), "node", "left_semi").groupBy("comp").agg(F.min("first_id").alias("least_id"))
        classes = own.join(least, "comp", "left").select("node", F.coalesce("least_id", "first_id").alias("component_id"))
    rows = base.drop("regs").join(classes, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "th", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of another id; rows of equal id and text go together."""
    gone = near_duplicates(docs, size, num, den).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti")
