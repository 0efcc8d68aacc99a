"""Benchmark phrases inside route texts, found through a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, rows_in, words_of, write_table

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: term and window tables up to this many rows are broadcast; larger ones are joined by a shuffle
BROADCAST_ROWS = 200_000


def terms_of(text: Column) -> Column:
    """Lower-case words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; null has none."""
    return words_of(lower_ascii(F.coalesce(text, F.lit(""))), GAPS)


def _small(df: DataFrame, most: int) -> DataFrame:
    """`df` marked for a broadcast if its size is within the bound."""
    return F.broadcast(df) if rows_in(df) <= most else df


def _postings(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(key, pos, term): every position of the listed terms in the texts."""
    words = texts.select("key", terms_of(F.col("text")).alias("_words")).select("key", F.posexplode("_words").alias("pos", "term"))
    return words.join(_small(terms.select(F.col("term").alias("_term")), most), F.col("term") == F.col("_term")).drop("_term")


def test_windows(items: DataFrame, texts: DataFrame, window: int, most: int) -> DataFrame:
    """(item, body, at, len, phrase, probes): windows of the items whose terms all occur in the texts.

    `body` is a hash of the item's id and text, `probes` are the (q, term) of the window's two rarest terms, q the place in the item;
    frequencies are counted over all texts.
    """
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.xxhash64("item_id", "text").alias("body"), terms_of(F.col("text")).alias("words")).distinct()
    placed = write_table(asked.select("item", "body", F.posexplode("words").alias("q", "term")), "item_terms")
    found = (_postings(texts, placed.select("term").distinct(), most).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("term").alias("_term"), "n"))
    counted = placed.join(found, F.col("term") == F.col("_term"), "left").select("item", "body", F.struct("q", "term", F.coalesce("n", F.lit(0)).alias("n")).alias("t"))
    # an item's terms in order; bounded by the item
    rows = counted.groupBy("item", "body").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ts") - window, F.lit(0)))))
    rows = rows.withColumn("part", F.slice("ts", F.col("at") + 1, F.lit(window))).filter(F.forall("part", lambda t: t["n"] > 0))
    rarest = F.array_sort(F.transform("part", lambda t: F.struct(t["n"], t["q"].alias("q"), t["term"].alias("term"))))
    return write_table(rows.select("item", "body", "at", F.size("part").alias("len"), F.array_join(F.transform("part", lambda t: t["term"]), " ").alias("phrase"),
                                   F.transform(F.slice(rarest, 1, 2), lambda t: F.struct(t["q"].alias("q"), t["term"].alias("term"))).alias("probes")).distinct(), "windows")


def candidates(texts: DataFrame, windows: DataFrame, slop: int, most: int) -> DataFrame:
    """(key, found): per text, the places (start, len, phrase, item) where a window's rarest terms stand right.

    Postings of the probe terms, less their place in the item, are item starts. Starts
    within `slop` of each other meet in one of two overlapping buckets; a window is a
    candidate when all its probes are there. A bucket with fewer probes than any
    window of the item has is dropped before windows are looked up.
    """
    needed = windows.groupBy("body").agg(F.min(F.size("probes")).alias("need"))
    probes = write_table(windows.select("body", F.explode("probes").alias("p")).select("body", "p.q", "p.term").distinct().join(needed, "body"), "probes")
    index = write_table(_postings(texts, probes.select("term").distinct(), most), "postings")
    named = probes.select("body", "q", "need", F.col("term").alias("_term"))
    width = slop + 1
    starts = (index.join(_small(named, most), F.col("term") == F.col("_term")).select("key", "body", "need", "q", (F.col("pos") - F.col("q")).alias("shift"))
              .withColumn("bucket", F.explode(F.array(*[F.floor(F.col("shift") / width) + k for k in range(2 if slop else 1)]))))
    seen = (starts.groupBy("key", "body", "bucket").agg(F.collect_set(F.struct("q", "shift")).alias("seen"), F.min("need").alias("need"))
            .filter(F.size("seen") >= F.col("need")))
    asked = windows.select(F.col("body").alias("_body"), "item", "at", "len", "phrase", F.transform("probes", lambda p: p["q"]).alias("qs"))
    met = seen.join(_small(asked, most), F.col("body") == F.col("_body"))
    first, last = F.element_at("qs", 1), F.element_at("qs", -1)
    # shifts at which the rarest probe stands and every other is within the slop
    shifts = F.transform(F.filter("seen", lambda s: (s["q"] == first) & F.exists(
        "seen", lambda o: (o["q"] == last) & (F.abs(o["shift"] - s["shift"]) <= slop))), lambda s: s["shift"])
    places = (met.select("key", "item", "at", "len", "phrase", F.explode(shifts).alias("shift")).withColumn("start", F.col("at") + F.col("shift"))
              .select("key", F.struct("start", "len", "phrase", "item").alias("place")))
    return places.groupBy(F.col("key").alias("_key")).agg(F.collect_set("place").alias("found"))


def phrase_matches(routes: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, broadcast_rows: int = BROADCAST_ROWS,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, text, n_words, n_hit, item_ids, near_item_ids, hits, carried) for every row of `routes` (route_id, text).

    `items` (item_id, text) are held-out texts. Their windows are `window` consecutive
    terms; an item of fewer terms, but not none, is one window. A window matches exactly
    where its terms stand in the text in order, and nearly where the window's place,
    widened by `slop` words on both sides, holds all its terms in any order. `hits` are the
    exact places (start, len, item), n_hit the words inside any of them; item_ids and
    near_item_ids are the items as strings, sorted; `carried` is a struct of the columns that
    `carry` names.

    Equal texts share their candidates, by a hash of the text. The texts are tokenised into postings of the windows' two rarest terms only; lists of
    two terms are intersected after subtracting their place in the item; what is left is
    compared word by word. Null texts and items have no words, a null item id is the empty
    string, null and repeated ids and rows stay, columns not carried are ignored. Without items
    nothing is hit; an empty table gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")
    texts = routes.select("route_id", "text", carried, F.xxhash64(text).alias("key"))
    windows = test_windows(items, texts, window, broadcast_rows)
    found = candidates(texts, windows, slop, broadcast_rows)
    ids = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda c: c["item"])))

    def judged(x):
        """Counts and matches of one text; x has its words and candidates, each made once."""
        def stretch(c, more: int):
            low = F.greatest(c["start"] - more, F.lit(0))
            return F.slice(x["words"], low + 1, F.greatest(c["start"] + c["len"] + more - low, F.lit(0)))

        exact = F.filter(x["found"], lambda c: (c["start"] >= 0) & (F.array_join(stretch(c, 0), " ") == c["phrase"]))
        near = F.filter(x["found"], lambda c: F.size(F.array_except(F.split(c["phrase"], " "), stretch(c, slop))) == 0)
        hits = F.transform(exact, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["item"].alias("item")))
        return F.struct(F.size(x["words"]).cast("long").alias("n_words"), F.array_sort(hits).alias("hits"), ids(near).alias("near_item_ids"))

    none = F.array().cast(found.schema["found"].dataType)
    rows = (texts.join(found, F.col("key") == F.col("_key"), "left")
            .select("route_id", "text", "carried", let(F.struct(terms_of(F.col("text")).alias("words"), F.coalesce("found", none).alias("found")), judged).alias("_j"))
            .select("route_id", "text", "carried", "_j.*"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("hits", zero, lambda a, c: F.struct(
        F.greatest(a["end"], (c["start"] + c["len"]).cast("long")).alias("end"),
        (a["n"] + F.greatest(F.lit(0), c["start"] + c["len"] - F.greatest(a["end"], c["start"]))).cast("long").alias("n")))
    return rows.select("route_id", "text", "n_words", covered["n"].alias("n_hit"), ids(F.col("hits")).alias("item_ids"), "near_item_ids", "hits", "carried")
