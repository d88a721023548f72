"""Quality rules: one Spark projection compiled from a table of thresholds.

``RULES`` names a ratio and the band it must lie in; ``verdict`` turns the
table into a single boolean column over built-in functions, so a document is
read, measured and judged in one scan without a shuffle or a user function.

Words are runs of anything but ASCII white space. ``n_repeat_words`` counts the
words in three-word windows that the text has twice or more: 64-bit window
hashes are sorted with their places, and only in texts that have a repeat at
all. Work per document is n log n at most, so very long texts are no trouble.

A null text has no words and fails; so does an empty one. Repeated rows get
equal rows, an empty table gives none, extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the be to of and that have with in is for it as was on are by this at or "
    "le la les de des du un une et en que qui dans pour par pas sur est au "
    "der die das und ist ein eine zu den von mit auf für im nicht dem sich auch "
    "el los las del y a por con no una su para es al lo como más".split()
)


@dataclass(frozen=True)
class Rule:
    """The ratio must be at least ``least`` and at most ``most``; a ratio over zero holds."""

    ratio: str
    least: float = 0.0
    most: float = float("inf")


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", most=0.25),
    Rule("digits_per_char", most=0.35),
    Rule("stop_words", least=2),
    Rule("dup_line_share", most=0.5),
    Rule("bullet_line_share", most=0.9),
    Rule("ellipsis_line_share", most=0.3),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_of(text: Column, kinds: str) -> Column:
    """How many characters of text are in the class."""
    return F.regexp_count(text, F.lit(kinds)).cast("long")


def without(text: Column, chars: str) -> Column:
    """How many characters of text are not among the few chars."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words in windows that occur twice or more."""
    # The last, short windows hash to values of their own: each is shorter than those before.
    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, window))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(s: Column) -> Column:
        pairs = F.transform(s, lambda x, j: F.when(F.get(s, j + 1)["h"] == x["h"], F.array(x["i"], F.get(s, j + 1)["i"])))
        return let(F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs)))), covered)

    def judged(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, places))

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(let(hashes, judged)).cast("long")


def measured(docs: DataFrame, text: Column, keep: Sequence[Column]) -> DataFrame:
    """keep and the base measures and ratios of text."""
    base = docs.select(
        *keep,
        text.alias("_text"),
        F.array_remove(F.split(text, GAP), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_lines"),
    )
    names = [c for c in base.columns if c not in ("_text", "_words", "_lines")]
    counts = base.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        without(F.col("_text"), WHITE).alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        count_of(F.col("_text"), "[0-9]").alias("_digits"),
        F.size(F.array_intersect("_words", F.array(*(F.lit(w) for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))))).alias("_stops"),
        F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias("_bullets"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("_ellipses"),
    )
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return counts.select(
        *names,
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("_digits", "word_chars").alias("digits_per_char"),
        F.col("_stops").cast("double").alias("stop_words"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("_bullets", "_n_lines").alias("bullet_line_share"),
        share("_ellipses", "_n_lines").alias("ellipsis_line_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """Whether all rules hold."""
    out = F.lit(True)
    for r in rules:
        x = F.col(r.ratio)
        if r.least > 0:
            out &= F.coalesce(x >= r.least, F.lit(True))
        if r.most != float("inf"):
            out &= F.coalesce(x <= r.most, F.lit(True))
    return out


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """id_col, the base measures, base_failed and kept of each row."""
    m = measured(docs, F.coalesce(F.col(text_col), F.lit("")), [F.col(id_col).alias("_id")])
    return m.select(
        F.col("_id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs, whole, that fail neither the base nor a rule."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    m = measured(docs, F.coalesce(F.col(text_col), F.lit("")), [whole])
    # A place number in the same projection keeps Catalyst from pushing the filter below it, where each
    # measure would be computed anew wherever another one uses it.
    judged = m.select("_row", (~base_failed() & verdict(rules)).alias("_kept"), F.monotonically_increasing_id().alias("_place"))
    return judged.where(F.col("_kept") & (F.col("_place") >= 0)).select("_row.*")
