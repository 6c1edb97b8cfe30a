"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of anything but ASCII white space. Null and empty texts have no words and fail.
Repeated rows are judged one by one; columns of the input that clash with a metric's name are replaced
in `measure` and left alone in `apply_rules(...)`, which adds only `base_failed` and `kept`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fenced_where, words_of

#: Runs without one of the symbols # * $ % & | < >
NO_SYMBOL = "[^#*$%&|<>]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "are", "this", "not",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "für",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "par", "sur", "pas", "au",
    "el", "los", "las", "y", "en", "por", "con", "para", "una", "se", "del", "lo", "no", "su", "es",
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails if its metric lies outside [low, high] and it has `min_words` words at least."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's verdict, beside the base rules. Ratios are per word or per line that has a word.
RULES = (
    Rule("symbol_ratio", high=0.3),
    Rule("mean_word_chars", low=1.5, high=30.0),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.01, min_words=60),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios as columns; one narrow projection per row, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    in_words = F.length(F.regexp_replace(t, SPACE_CLASS, ""))
    df = docs.withColumns({"_words": words_of(F.col(text)), "_word_chars": in_words, "_symbols": F.length(F.regexp_replace(t, NO_SYMBOL, "")), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    # hashes of the five-word windows; `_words` is referenced often, so the optimizer keeps it as a column of its own
    hashes = F.expr(f"transform(slice(_words, 1, greatest(size(_words) - {WINDOW - 1}, 0)), (w, i) -> xxhash64(w, {', '.join(f'get(_words, i + {k})' for k in range(1, WINDOW))}))")
    df = df.withColumns({"_hashes": hashes, "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))})
    # only texts with some repeated window are sorted: struct(hash, position), equal neighbours are repeats
    ordered = F.expr("CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN array_sort(transform(_hashes, (h, i) -> struct(h AS h, i AS i))) END")
    df = df.withColumn("_ordered", ordered)
    positions = F.expr("array_sort(filter(transform(_ordered, (x, k) -> CASE WHEN x.h = get(_ordered, k - 1).h OR x.h = get(_ordered, k + 1).h THEN x.i END), p -> p IS NOT NULL))")
    df = df.withColumn("_positions", positions)
    repeated = F.expr(f"aggregate(transform(_positions, (p, k) -> least({WINDOW}, coalesce(get(_positions, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)")
    n_words, n_lines = F.size("_words").cast("long"), F.size("_lines").cast("long")
    dup = n_lines - F.size(F.array_distinct("_lines"))
    per = lambda a, b: F.when(b > 0, a / b)
    df = df.withColumns(
        {"n_words": n_words, "word_chars": F.col("_word_chars").cast("long"), "n_symbols": F.col("_symbols").cast("long"), "n_dup_lines": dup.cast("long"), "n_repeat_words": F.coalesce(repeated, F.lit(0)).cast("long"), "symbol_ratio": per(F.col("_symbols"), n_words), "mean_word_chars": per(F.col("_word_chars"), n_words), "dup_line_ratio": per(dup, n_lines), "stop_word_ratio": per(F.col("_stops"), n_words)}
    )
    return df.drop("_words", "_word_chars", "_symbols", "_lines", "_hashes", "_stops", "_ordered", "_positions")


def verdict(rules=RULES):
    """The table as one boolean expression over the columns of `measure`."""
    failed = F.lit(False)
    for r in rules:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.metric) < r.low)
        if r.high is not None:
            out = out | (F.col(r.metric) > r.high)
        failed = failed | ((F.col("n_words") >= r.min_words) & F.coalesce(out, F.lit(False)))
    return ~failed


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The input with metrics, `base_failed` and `kept`."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the input's columns."""
    # metrics are taken from a copy of the text, so that columns of the same names survive
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return fenced_where(judge(boxed, rules, "_text"), "kept").select("_row.*")
