"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Measures are native expressions over each whole text, without a shuffle. Null and empty texts have no words and fail the length rule. Each
row is judged by itself; ties, repeated rows and other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import count_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of four languages (fixed values).
STOP_WORDS = (
    "the be to of and that have with is in it for on are as was by this from or an at "
    "le la les de des du et un une en que qui dans pour par sur au aux "
    "der die das und den dem von zu mit ein eine ist nicht auf im sich "
    "el los las y del que con una por para se su al"
).split()
#: Measure, smallest and largest value that pass (None: no limit), and the number of words from which the rule holds.
RULES = (
    ("n_words", 10, None, 0),
    ("repeated_share", None, 0.2, 0),
    ("mean_word_chars", 2.0, 15.0, 0),
    ("symbols_per_word", None, 0.1, 0),
    ("duplicate_line_share", None, 0.3, 0),
    ("stop_words", 2, None, 50),
)
WINDOW = 5


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the array of windows' hashes; arrays without repeats end early."""

    def same_hash(s: Column, i: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

    def covered(s: Column) -> Column:
        starts = F.sort_array(F.transform(F.filter(s, lambda x, i: same_hash(s, i - 1, x) | same_hash(s, i + 1, x)), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("long").alias("n"), x.alias("last")), lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a one-element array binds the sorted array to a name, so that it's made once
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(ordered), covered), F.lit(0)))


def measures(docs: DataFrame) -> DataFrame:
    """The columns of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, stop_words under ``_m``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = split.withColumn("_hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    return hashed.withColumn("_m", F.struct(
        n.cast("long").alias("n_words"),
        (F.length(text) - count_of(text, SPACES)).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        F.size(F.array_intersect("_words", F.array(*map(F.lit, STOP_WORDS)))).alias("stop_words"),
    )).drop("_words", "_lines", "_hashes")


def verdict(rules: tuple = RULES) -> Column:
    """One condition over ``_m`` from the table of thresholds."""
    m = F.col("_m")
    n = F.greatest(m["n_words"], F.lit(1))
    of = {
        "n_words": m["n_words"], "stop_words": m["stop_words"], "mean_word_chars": m["word_chars"] / n, "symbols_per_word": m["n_symbols"] / n,
        "duplicate_line_share": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), "repeated_share": m["n_repeat_words"] / n,
    }
    passed = F.lit(True)
    for name, low, high, least_words in rules:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (of[name] >= low)
        if high is not None:
            inside = inside & (of[name] <= high)
        passed = passed & ((m["n_words"] < least_words) | inside)
    return passed


def judged(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The columns of docs, the measures under ``_m``, and ``_failed`` (the base rules) and ``_kept``."""
    m = F.col("_m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return measures(docs).withColumn("_failed", failed).withColumn("_kept", ~F.col("_failed") & verdict(rules))
