"""How the spoken wording of route labels differs within a borough, term by term and label by label.

Every kept term is a row of nonzero counts, one per label that uses it, in the order of the labels. The rows form a
frequent-pattern tree: a node is a prefix of such a row with the number of rows that run through it. Summed over all
terms, a divergence of two labels is

    terms * f(0, 0)  +  corrections of single counts  +  corrections of pairs of counts,

and a pair correction belongs to a node and one of its ancestors, so it is computed once for all rows that share the
path, however many terms these are. Zero counts never become rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, write_table

_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: a probability of 1 in whole units, and what is added to every count
UNIT, PRIOR = 1_000_000_000, 2
#: distinct (borough, label, term) that a task holds before it hands them on
FOLD = 200_000


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms of texts with their counts and the number of texts that have them, folded within the task."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def folded() -> pd.DataFrame:
        return pd.concat([pd.DataFrame({
            "borough": borough, "label": label, "term": [t.decode("utf-8", "replace") for t in counts],
            "n": pd.Series(list(counts.values()), dtype="int64"), "n_texts": pd.Series([texts[t] for t in counts], dtype="int64")})
            for (borough, label), (counts, texts) in groups.items()])

    for batch in batches:
        for borough, label, text in zip(batch["borough"], batch["label"], batch["text"]):
            if (borough, label) not in groups:
                groups[borough, label] = (Counter(), Counter())
            counts, texts = groups[borough, label]
            terms, before = _TERM.findall(text.encode("utf-8", "replace").lower()), len(texts)
            counts.update(terms)
            texts.update(set(terms))
            size += len(texts) - before
            if size >= FOLD:
                yield folded()
                groups, size = {}, 0
    if size:
        yield folded()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), exact for counts of any size."""
    top = (n.cast("decimal(20,0)") + F.lit(PRIOR)) * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, total.cast("decimal(20,0)") + F.lit(PRIOR) * terms.cast("decimal(20,0)")).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so all fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def label_divergence(routes: DataFrame, least_texts: int = 10, top: int = 10) -> DataFrame:
    """Divergence of the wording of route labels within each borough.

    Parameters
    ----------
    routes : (borough, label, text), one spoken route each; further columns are not read.
    least_texts : texts of a borough that must hold a term for it to be kept.
    top : ranks of terms that are returned for a (borough, label).

    Returns (borough, label, part, item, value, rank). Part `pair`: item is each other label of the borough, value the sum
    over all kept terms of f(p, q) with the shares p of the label and q of the other one. Part `term`: item is a kept term
    that the label uses and whose share p exceeds the borough's q, value f(p, q), the `top` largest. A share is
    1 + floor(10^9 (n + 2) / (N + 2 V)) for n occurrences of N over V kept terms, f is floor((p - q)^2 / (p + q)).
    Ranks start at 1, by value descending, then by item in UTF-8 order.

    Terms are runs of a-z and characters beyond ASCII after A-Z is lower-cased. A null borough, label or text counts as
    the empty string; every row is a text of its own, so repeated rows count as often as they stand; a label without terms
    has its pairs and no terms, and without kept terms every pair is 0; an empty table gives an empty table. The row of a
    term is as long as the number of labels that use it: labels are categories, and their pairs are the result.
    """
    empty = F.lit("")
    texts = routes.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("borough", "label", "text")])
    groups = write_table(texts.groupBy("borough", "label").agg(F.count(F.lit(1)).alias("n_texts")).drop("n_texts"), "groups")
    counted = texts.mapInPandas(_counted, "borough string, label string, term string, n long, n_texts long")
    # folded rows are dealt by term once, which serves the sums by label and the rows of terms alike
    dealt = counted.repartition("borough", "term")
    by_label = dealt.groupBy("borough", "label", "term").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))
    # one row per kept term: its counts in the order of the labels
    rows = by_label.groupBy("borough", "term").agg(
        F.sort_array(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("n").alias("total"), F.sum("n_texts").alias("n_texts"))
    rows = write_table(rows.filter(F.col("n_texts") >= least_texts).drop("n_texts"), "term_rows")

    boroughs = rows.groupBy("borough").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("borough_total"))
    used = rows.select("borough", F.explode("counts").alias("c")).groupBy("borough", F.col("c.label").alias("label")).agg(F.sum("c.n").alias("total"))
    stats = groups.join(used, ["borough", "label"], "left").join(boroughs, "borough", "left")
    stats = write_table(stats.select("borough", "label", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "borough_total")]), "label_totals")

    out = _pairs(rows, stats).unionByName(_terms(rows, stats, top))
    result = write_table(out, "divergence")
    for table in (groups, rows, stats):
        drop_table(table)
    return result


def _tree(rows: DataFrame) -> DataFrame:
    """(borough, path, n_terms): the nodes of the tree, each with the number of term rows that run through it."""
    same = rows.groupBy("borough", "counts").agg(F.count(F.lit(1)).alias("n_terms"))
    depth = F.explode(F.sequence(F.lit(1), F.size("counts"))).alias("depth")
    prefixes = same.select("borough", "counts", "n_terms", depth).select("borough", F.slice("counts", F.lit(1), F.col("depth")).alias("path"), "n_terms")
    return prefixes.groupBy("borough", "path").agg(F.sum("n_terms").alias("n_terms"))


def _named(stats: DataFrame, suffix: str) -> DataFrame:
    return stats.filter("terms > 0").select("borough", F.col("label").alias(f"label_{suffix}"), F.col("total").alias(f"total_{suffix}"), F.col("terms").alias(f"terms_{suffix}"))


def _pairs(rows: DataFrame, stats: DataFrame) -> DataFrame:
    nodes = write_table(_tree(rows), "tree")
    a, b = _named(stats, "a"), _named(stats, "b")
    zero = F.lit(0).cast("long")

    def share(n: Column, side: str) -> Column:
        return _share(n, F.col(f"total_{side}"), F.col(f"terms_{side}"))

    # every pair of labels with all terms at zero
    both = a.join(b, "borough").filter("label_a < label_b")
    base = both.select("borough", "label_a", "label_b", (F.col("terms_a") * _gap(share(zero, "a"), share(zero, "b"))).alias("value"))
    # single counts: a node's own count against zero of every other label
    last = F.element_at("path", -1)
    ones = nodes.groupBy("borough", last["label"].alias("label_a"), last["n"].alias("n")).agg(F.sum("n_terms").alias("n_terms"))
    ones = ones.join(a, ["borough", "label_a"]).withColumns({"p": share(F.col("n"), "a"), "p0": share(zero, "a")})
    ones = ones.join(b, "borough").filter("label_a <> label_b").withColumn("q0", share(zero, "b"))
    moved = F.col("n_terms") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))
    singles = ones.groupBy(F.col("borough"), F.least("label_a", "label_b").alias("label_a"), F.greatest("label_a", "label_b").alias("label_b")).agg(F.sum(moved).alias("value"))
    # pairs of counts: a node and each of its ancestors
    above = F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("above")
    meets = nodes.filter(F.size("path") > 1).select("borough", "n_terms", last.alias("own"), above)
    meets = meets.groupBy("borough", F.col("above.label").alias("label_a"), F.col("above.n").alias("n"), F.col("own.label").alias("label_b"), F.col("own.n").alias("m")).agg(F.sum("n_terms").alias("n_terms"))
    meets = meets.join(a, ["borough", "label_a"]).join(b, ["borough", "label_b"])
    meets = meets.withColumns({"p": share(F.col("n"), "a"), "p0": share(zero, "a"), "q": share(F.col("m"), "b"), "q0": share(zero, "b")})
    joint = _gap(F.col("p"), F.col("q")) - _gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q")) + _gap(F.col("p0"), F.col("q0"))
    shared = meets.groupBy("borough", "label_a", "label_b").agg(F.sum(F.col("n_terms") * joint).alias("value"))
    summed = base.unionByName(singles).unionByName(shared).groupBy("borough", "label_a", "label_b").agg(F.sum("value").alias("value"))
    # f is symmetric, so a pair of labels is summed once and told from both ends
    ends = F.explode(F.array(F.struct(F.col("label_a").alias("label"), F.col("label_b").alias("item")),
                             F.struct(F.col("label_b").alias("label"), F.col("label_a").alias("item")))).alias("e")
    valued = summed.select("borough", ends, "value").select("borough", "e.label", "e.item", "value")
    # boroughs without a kept term have pairs of value 0
    bare = stats.filter("terms = 0").select("borough", "label")
    none = bare.join(bare.select("borough", F.col("label").alias("item")), "borough").filter("label <> item").withColumn("value", zero)
    order = W.partitionBy("borough", "label").orderBy(F.desc("value"), "item")
    found = write_table(valued.unionByName(none), "label_pairs")
    drop_table(nodes)
    return found.select("borough", "label", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(rows: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    used = rows.select("borough", "term", F.col("total").alias("in_borough"), F.explode("counts").alias("c"))
    used = used.select("borough", F.col("c.label").alias("label"), F.col("term").alias("item"), F.col("c.n").alias("n"), "in_borough")
    used = used.join(stats, ["borough", "label"])
    used = used.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("in_borough"), F.col("borough_total"), F.col("terms"))})
    above = used.filter("p > q").select("borough", "label", F.lit("term").alias("part"), "item", _gap(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("borough", "label").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
