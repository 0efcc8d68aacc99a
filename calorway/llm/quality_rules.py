"""Quality verdicts for route texts from one table of thresholds, evaluated in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it with for as was on be at by this are from or an a "
    "der die das und ist in den von zu mit sich auf für nicht ein eine im dem des "
    "le la les de des et un une en est que dans pour pas sur par au du avec "
    "el los las del y que se por con una para al lo"
).split()
#: (rule, measure, lowest, highest): a text fails a rule when its measure lies outside; None is open.
THRESHOLDS = (
    ("length", "n_words", 10, None),
    ("word_length", "word_chars / n_words", 2.0, 25.0),
    ("symbols", "n_symbols / n_words", None, 0.3),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words / n_words", None, 0.2),
)


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows of `window` words that occur twice or more in the text, the first included.

    A hash set settles texts without repeats; only the others sort (hash, position) and
    add up the covered stretch between one repeated start and the next.
    """
    def starts(hashes):
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window),
                           lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def covered(keys):
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # get() beyond either end is null, and null is no match
        twice = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                                   | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        places = let(pairs, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    some = F.when(F.size(words) >= window, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(
        starts(h), lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("long")))))
    return F.coalesce(some, F.lit(0).cast("long"))


def measure_texts(routes: DataFrame, window: int = 5) -> DataFrame:
    """The measures of `THRESHOLDS` for every row of `routes` (route_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeat_words(w, window).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (routes.select("route_id", words.alias("_w"), lines.alias("_l"),
                          F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
                          (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
            .select("route_id", "_w.n_words", "word_chars", "n_symbols", "_w.n_stop_words", "_l.n_lines", "_l.n_dup_lines",
                    "_w.n_repeat_words"))


def quality_rules(routes: DataFrame, thresholds=THRESHOLDS, window: int = 5) -> DataFrame:
    """One row per row of `routes` (route_id, text): measures, failed rules and `kept`.

    The table of thresholds is compiled into one array of checks over the measures; there
    is no user function and no shuffle. A ratio over zero words or lines is zero. A null
    text counts as empty, which fails `length`. Repeated rows and null ids stay, other
    columns are ignored.
    """
    checks = []
    for rule, measure, low, high in thresholds:
        top, _, bottom = measure.partition(" / ")
        value = F.col(top).cast("double")
        if bottom:
            value = F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(0.0)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < low)
        if high is not None:
            bad = bad | (value > high)
        checks.append(F.when(bad, F.lit(rule)))
    failed = F.filter(F.array(*checks), lambda r: r.isNotNull())
    return measure_texts(routes, window).withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)
