"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Words are runs of characters other than the blank and TAB..CR. Defined results: a null text has
no words, so every count is 0 and the base rule fails; repeated rows are judged one by one; an
empty table gives an empty result. Only ``doc_id`` and ``text`` are read, whatever else exists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import let

# Word pattern, symbols, base thresholds.
WORD = r"[^ \t-\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he at are this or from an".split(),
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas au avec".split(),
    "de": "der die das den dem des und in zu ein eine mit von ist auf für als sich nicht es".split(),
    "es": "el la los las de del que y en un una se no con por para su al lo como".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` keeps a document; an open side is None."""

    metric: str
    low: float | None
    high: float | None


#: The threshold table. Metrics are ratios, so a rule means the same at every text length.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("alphabetic_word_ratio", 0.5, None),
)


def repeated_words(words: Column, window: Column | int = REPEAT_WINDOW) -> Column:
    """Words covered by windows that occur at least twice in ``words``.

    Windows are compared by hash first; only those whose hash repeats are compared as words.
    """
    k = int(window)
    starts = F.sequence(F.lit(0), F.size(words) - k)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def twice(sorted_rows: Column) -> Column:
        """Positions in rows (w, i) sorted by w whose w equals a neighbour's."""
        return let(
            sorted_rows,
            lambda s: F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False)),
            ),
        )

    def covered(h: Column) -> Column:
        by_hash = twice(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("w"), i.alias("i")))))
        by_words = twice(F.sort_array(F.transform(by_hash, lambda x: F.struct(F.slice(words, x["i"] + 1, k).alias("w"), x["i"].alias("i")))))
        return let(
            F.sort_array(F.transform(by_words, lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(k), x - F.get(p, j - 1))), F.lit(0).cast("long"), lambda total, x: total + x
            ),
        )

    zero = F.lit(0).cast("long")
    return F.when(F.size(words) <= k, zero).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))
    )


def measures(text: Column) -> dict[str, Column]:
    """All counts of a text; ``rows`` computes them over a split text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    stops = sorted({w for group in STOP_WORDS.values() for w in group})
    counts = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        ),
    )
    return {
        "counts": counts,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "line_counts": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the metric columns."""
    keep = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            keep = keep & (F.col(rule.metric) >= rule.low)
        if rule.high is not None:
            keep = keep & (F.col(rule.metric) <= rule.high)
    return keep


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios and verdict of every document: doc_id, counts, ratios, base_failed, kept."""
    rows = docs.select("doc_id", *[c.alias(n) for n, c in measures(F.col("text")).items()]).select(
        "doc_id", "counts.*", "word_chars", "n_symbols", "line_counts.*"
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "stop_word_ratio": F.col("n_stop_words") / words,
            "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "alphabetic_word_ratio": F.col("n_alpha_words") / words,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
