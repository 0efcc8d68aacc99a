"""Near-duplicate texts by SimHash fingerprints, found by the general pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table
from .links import linked_roots

BITS = 64
#: words hashed at a time, so that a very long text needs bounded memory
WORDS_AT_ONCE = 1 << 16
#: cost of one probe row and of one compared pair, in the same unit
ROW_COST, PAIR_COST = 100.0, 1.0
#: values of a text's shingle set and least hashes in each
BANDS, BAND_ROWS = 24, 5
#: rounds that compare the members of a value with one of them, before those still apart meet by rare shingles
PIVOTS = 3
#: sets that one salt of a shingle compares
SALT_ROWS = 2000


def _digests(text: str | None, shingle: int, seed: int, wide: bool = False) -> Iterator[np.ndarray]:
    """Rows of digest bytes, one per word shingle, some at a time; A-Z are lower-cased, a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size, digest = min(shingle, len(words)), xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    for first in range(0, len(words) - size + 1 if words else 0, WORDS_AT_ONCE):
        part = words[first:first + WORDS_AT_ONCE + size - 1]
        joined, lengths = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[:len(part) - size + 1].tolist(), ends[size - 1:].tolist())
        yield np.frombuffer(b"".join([digest(joined[i:j], seed) for i, j in spans]), np.uint8).reshape(-1, 16 if wide else 8)


def _bit_sums(digests: np.ndarray) -> np.ndarray:
    """How many of the digests have each bit set."""
    return sum(np.unpackbits(digests[at:at + 4096], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(digests), 4096))


def _majority(set_bits: np.ndarray, total: int) -> np.ndarray:
    """64-bit parts of the fingerprint of `total` digests."""
    return np.packbits(set_bits * 2 > total).view(">i8")


def text_fingerprint(text: str | None, shingle: int, seed: int = 42, wide: bool = False) -> tuple[int, int]:
    """(fingerprint, more): majority bits of the hashes of all word shingles as signed 64-bit numbers; 0 without words.

    The hash is XXH64, or XXH3-128 when `wide`, whose second half gives `more`.
    """
    total, set_bits = 0, np.zeros(2 * BITS if wide else BITS, np.int64)
    for digests in _digests(text, shingle, seed, wide):
        total, set_bits = total + len(digests), set_bits + _bit_sums(digests)
    halves = _majority(set_bits, total)
    return int(halves[0]), int(halves[1]) if wide else 0


def fingerprints(routes: DataFrame, keys: list[str], shingle: int = 4, seed: int = 42, wide: bool = False) -> DataFrame:
    """`keys`, fingerprint and more for every row of `routes` (the keys and text); A-Z are lower-cased."""
    @F.pandas_udf("fingerprint long, more long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame(np.array([text_fingerprint(t, shingle, seed, wide) for t in part], np.int64).reshape(-1, 2), columns=["fingerprint", "more"])

    return routes.select(*keys, prints("text").alias("_p")).select(*keys, "_p.fingerprint", "_p.more")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits set; a table of fixed size, from all rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch["fingerprint"].to_numpy().astype("<i8")
            for at in range(0, len(values), 8192):
                bits = np.unpackbits(values[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pd.DataFrame({"i": np.repeat(np.arange(BITS), BITS), "j": np.tile(np.arange(BITS), BITS), "n": total.ravel()})

    rows = prints.select("fingerprint").mapInPandas(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n")).collect()
    out = np.zeros((BITS, BITS))
    for i, j, n in rows:
        out[i, j] = n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of near equal size, correlated bits together."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def part_count(n: int, max_bits: int) -> int:
    """How many groups are cheapest for n fingerprints, if bits were independent."""
    def cost(parts: int) -> float:
        width, extra = BITS / parts, max_bits - parts + 1
        radii = [extra // parts + (k < extra % parts) for k in range(parts)]
        return sum(_ball(int(width), r) * (ROW_COST + PAIR_COST * n / 2 ** width) for r in radii if r >= 0)
    return min(range(2, max_bits + 2), key=cost)


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Radii, -1 for an unused group, with sum(radius + 1) = budget and the least total cost.

    costs[i][r + 1] is the cost of radius r in group i. Any two fingerprints within
    budget - 1 bits then agree within the radius of some group.
    """
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * budget
    for row in costs:
        best = [min(((best[b - t][0] + row[t], best[b - t][1] + [t - 1]) for t in range(min(b, len(row) - 1) + 1)), key=lambda x: x[0])
                for b in range(budget + 1)]
    return best[budget][1]


def _flips(bits: list[int], radius: int) -> list[int]:
    from itertools import combinations
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [_signed(m) for m in masks]


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def plan_probes(prints: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """[(bits, radius)]: correlated bits grouped, radii by dynamic programming on candidate counts of all rows.

    Candidates at radius 0 and 1 are counted exactly from value frequencies; larger radii
    are estimated from those two as independent flips.
    """
    n = prints.count()
    groups = group_bits(bit_counts(prints), n, part_count(n, max_bits))
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    value = lambda i: F.col("fingerprint").bitwiseAND(F.lit(masks[i]))
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), value(i).alias("v")) for i in range(len(groups))])).alias("k"))
    freq = write_table(keyed.groupBy("k.part", "k.v").agg(F.count(F.lit(1)).alias("c")), "frequencies")
    drops = F.array(*[F.array(*[F.lit(_signed(~(1 << b))) for b in g]) for g in groups])
    near = (freq.withColumn("drop", F.explode(F.get(drops, F.col("part")))).withColumn("v", F.col("v").bitwiseAND(F.col("drop")))
            .groupBy("part", "drop", "v").agg(F.sum("c").alias("c")))
    square = F.sum(F.col("c").cast("double") * F.col("c"))
    same = {r[0]: r[1] for r in freq.groupBy("part").agg(square).collect()}
    one = {r[0]: r[1] for r in near.groupBy("part").agg(square).collect()}
    costs = []
    for i, g in enumerate(groups):
        base = same.get(i, 0.0)
        rate = max(0.0, one.get(i, 0.0) - len(g) * base) / (len(g) * base) if base else 0.0
        row = [0.0]
        for r in range(max_bits + 1):
            pairs = base * sum(comb(len(g), j) * rate ** j for j in range(r + 1))
            row.append(ROW_COST * n * _ball(len(g), r) + PAIR_COST * pairs / 2)
        costs.append(row)
    radii = allocate(costs, max_bits + 1)
    return [(g, r) for g, r in zip(groups, radii) if r >= 0]


def close_pairs(prints: DataFrame, probes: list[tuple[list[int], int]], max_bits: int, max_wide: int, nodes: bool = False) -> DataFrame:
    """(a, b): roots of prints that differ in at most `max_bits` bits, and in `max_wide` of all 128; with `nodes` also such a pair of each (node1, node2).

    `prints` has (fingerprint, more, root), and node if asked for. One side is indexed by the value of each group,
    the other probes all values within the group's radius; the join itself verifies the
    distance, so unverified candidates are never written.
    """
    masks = [F.lit(_signed(sum(1 << b for b in bits))) for bits, _ in probes]
    fp, own = F.col("fingerprint"), ["fingerprint", "more", "root", *["node"] * nodes]

    def around(i: int, bits: list[int], radius: int):
        flips = F.array(*[F.lit(x) for x in _flips(bits, radius)])
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("part"), fp.bitwiseAND(masks[i]).bitwiseXOR(x).alias("v")))

    def side(keys, tag: str):
        return prints.select(*own, F.explode(keys).alias("k")).select(*[F.col(c).alias(c.split(".")[-1] + tag) for c in ("k.part", "k.v", *own)])

    index = side(F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(m).alias("v")) for i, m in enumerate(masks)]), "1")
    probe = side(F.flatten(F.array(*[around(i, bits, r) for i, (bits, r) in enumerate(probes)])), "2")
    bits = F.bit_count(F.col("fingerprint1").bitwiseXOR(F.col("fingerprint2")))
    wide = bits + F.bit_count(F.col("more1").bitwiseXOR(F.col("more2")))
    close = index.join(probe, (F.col("part1") == F.col("part2")) & (F.col("v1") == F.col("v2")) & (F.col("root1") < F.col("root2"))
                       & (bits <= max_bits) & (wide <= max_wide)).withColumnsRenamed({"root1": "a", "root2": "b"})
    if not nodes:
        return close.select("a", "b").distinct()
    return close.groupBy("a", "b").agg(F.min(F.struct("node1", "node2")).alias("_w")).select("a", "b", "_w.node1", "_w.node2")


def print_roots(prints: DataFrame, max_bits: int = 4, max_wide: int = 2 * BITS, steps: tuple[int, ...] = (1, 2), found: list[DataFrame] | None = None) -> DataFrame:
    """`prints` (node, fingerprint, more), one row per node, with `root`; linked ones share the least node as root.

    The links of each step (node1, node2) that made the roots are put into `found`, if given.

    Distances grow in `steps` up to `max_bits` and each step asks only for pairs that no
    earlier step has joined. A dense group of n copies thus gives its nearest links, not
    n * n of them. Small radii share the last step's probes; where that step is wide, each
    has its own, cheaper ones.
    """
    values, wide = prints.select("fingerprint").distinct(), max_bits > 6
    probes = None if wide else plan_probes(values, max_bits)
    roots = prints.select("node", "fingerprint", "more", F.col("node").alias("root"))
    for step in (*[s for s in steps if s < max_bits], max_bits):
        if wide:
            probes = plan_probes(values, step)
        links = close_pairs(roots, probes, step, max_wide, found is not None)
        if found is not None:
            found.append(links := write_table(links, "print_links"))
        merged = linked_roots(links.select("a", "b")).select(F.col("node").alias("_node"), F.col("root").alias("_low"))
        old, roots = roots, write_table(roots.join(merged, F.col("root") == F.col("_node"), "left")
                                        .select("node", "fingerprint", "more", F.coalesce("_low", "root").alias("root")), "print_roots")
    return roots


def near_routes(routes: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(route_id, fingerprint, component_id) for every row of `routes` (route_id, text).

    A fingerprint bit is set if it is set in more than half of the XXH64 of the text's
    word shingles, repeats included, A-Z lower-cased; a text with fewer words is one
    shingle, one without words (null, empty) has fingerprint zero and is linked like any
    other. Fingerprints at `max_bits` or fewer differing bits are linked; component_id is
    the smallest route_id reachable. Equal texts share a fingerprint and are folded before
    any pair is sought. Repeated rows stay, null ids belong to components but never name
    one, other columns are ignored, an empty table gives no row.
    """
    prints = write_table(fingerprints(routes, ["route_id"], shingle, seed), "fingerprints")
    distinct = write_table(prints.groupBy("fingerprint").agg(F.min("route_id").alias("low_id")), "prints")
    roots = print_roots(distinct.select(F.col("fingerprint").alias("node"), "fingerprint", F.lit(0).cast("long").alias("more")), max_bits)
    least = distinct.join(roots.select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = roots.join(least, "root").select(F.col("fingerprint").alias("_f"), "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("_f")).select("route_id", "fingerprint", "component_id")


def bit_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(node1, node2): links that join the `nodes` (node, fingerprint) whose fingerprints are joined at `max_bits` or fewer bits.

    Of a fingerprint the least node stands for the others. The links grow with the nodes
    and not with the pairs of a dense group, as in `print_roots`.
    """
    found: list[DataFrame] = []
    least = write_table(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")), "prints")
    drop_table(print_roots(least.select(F.col("least").alias("node"), "fingerprint", F.lit(0).cast("long").alias("more")), max_bits, found=found))
    links = (nodes.join(least.withColumnRenamed("fingerprint", "_f"), F.col("fingerprint") == F.col("_f")).filter("node <> least")
             .select(F.col("least").alias("node1"), F.col("node").alias("node2")))
    for more in found:
        links = links.union(more.select("node1", "node2"))
    out = write_table(links, "bit_links")
    for table in (least, *found):
        drop_table(table)
    return out


def shingle_set(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles, A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    return set_and_print(text, shingle, seed)[0]


def set_and_print(text: str | None, shingle: int, seed: int) -> tuple[np.ndarray, int]:
    """The `shingle_set` of a text and its fingerprint, of the same digests."""
    parts, total, set_bits = [np.zeros(0, np.uint64)], 0, np.zeros(BITS, np.int64)
    for digests in _digests(text, shingle, seed):
        parts.append(np.unique(digests.view(">u8").ravel().astype(np.uint64)))
        total, set_bits = total + len(digests), set_bits + _bit_sums(digests)
    return np.unique(np.concatenate(parts)), int(_majority(set_bits, total)[0])


def band_values(hashes: np.ndarray) -> np.ndarray:
    """BANDS values, each of BAND_ROWS least hashes of a set under permutations of their own; sets of Jaccard j share one with 1 - (1 - j ** BAND_ROWS) ** BANDS."""
    import xxhash

    rng = np.random.default_rng(17)
    flip, odd = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            mixed = (hashes[at:at + 2048, None] ^ flip) * (odd | np.uint64(1))
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum(least, (mixed * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k * 8 * BAND_ROWS:(k + 1) * 8 * BAND_ROWS], k) for k in range(BANDS)], np.uint64).view(np.int64)


def _set_rows(shingle: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        for batch in batches:
            found = [set_and_print(t, shingle, seed) for t in batch["text"]]
            sets = [s for s, _ in found]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets]
            yield pd.DataFrame({"order": batch["order"], "key": batch["key"], "node": np.array(nodes, np.uint64).view(np.int64),
                                "fingerprint": np.array([f for _, f in found], np.int64), "n": np.array([len(s) for s in sets], np.int64), "bands": [band_values(s) for s in sets]})
    return run


def near_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of the `pairs` (node1, root1, node2, root2) whose shingle `sets` (node, hashes) have a Jaccard of `similarity` or more."""
    one, two = (sets.select(F.col("node").alias(f"_n{k}"), F.col("hashes").alias(f"_h{k}")) for k in (1, 2))
    both = pairs.join(one, F.col("node1") == F.col("_n1")).join(two, F.col("node2") == F.col("_n2"))
    shared = F.size(F.array_intersect("_h1", "_h2"))
    return (both.select("root1", "root2", shared.alias("_s"), (F.size("_h1") + F.size("_h2")).alias("_t"))
            .filter(F.col("_s") / (F.col("_t") - F.col("_s")) >= similarity).select(F.col("root1").alias("a"), F.col("root2").alias("b")).distinct())


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node1, root1, node2, root2): pairs of `nodes` (node, root) with unlike roots whose `sets` (node, hashes) can have a Jaccard of `similarity`.

    Shingles are ordered rare first, by the number of these sets that hold them. Sets of n
    and m shingles at `similarity` s share at least t = s (n + m) / (1 + s), so the first
    one they share lies at or before n - t in one and m - t in the other, counted from
    zero; pairs are those that hold a shingle at such places. No pair at s or more is
    missing, and a common shingle is a key only for sets that hardly have rarer ones.
    Keys of many sets are split by salts. Empty sets are in no pair.
    """
    held = nodes.join(sets.select(F.col("node").alias("_s"), "hashes"), F.col("node") == F.col("_s"))
    each = write_table(held.select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "shingles")
    many = each.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # shingles of one set alone come first and are never shared, so they only move the others back
    ordered = (each.join(many, F.col("h") == F.col("_h")).groupBy("node", "root", "n")
               .agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("common"))
               .withColumn("alone", F.col("n") - F.size("common")))
    reach = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - F.col("alone")
    prefix = (ordered.filter(reach > 0).select("node", "root", "n", "alone", F.posexplode(F.slice("common", F.lit(1), reach.cast("int"))).alias("k", "e"))
              .select("node", "root", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("rest"), "e.c", "e.h"))
    prefix = write_table(prefix.withColumn("salts", (F.col("c") / SALT_ROWS).cast("int") + 1).drop("c"), "prefixes")
    drop_table(each)
    one, two = (prefix.select("h", "salts", *[F.col(c).alias(f"{c}{k}") for c in ("node", "root", "n", "rest")]) for k in (1, 2))
    one = one.withColumn("salt", F.pmod(F.xxhash64("node1"), F.col("salts")).cast("int")).drop("salts")
    two = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    needed = F.col("n1") + F.col("n2")
    fits = F.least("rest1", "rest2") >= needed * (similarity / (1 + similarity)) - 1e-9
    return (one.withColumnsRenamed({"h": "_h", "salt": "_salt"})
            .join(two, (F.col("_h") == F.col("h")) & (F.col("_salt") == F.col("salt")) & (F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & fits)
            .select("node1", "root1", "node2", "root2"))


def first_of_near(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(order, key): the first text of each group of near copies in `texts` (order, key, text).

    Near means that the sets of word shingles have a Jaccard similarity of `similarity`
    or more; every candidate is verified on the sets. Equal sets fold first, and texts
    without words are copies of each other. Near copies of near copies belong to one group.

    Candidates are first the links of the SimHash fingerprints of the texts at `max_bits`
    or fewer bits, found as in `near_routes`. At this distance bits alone show only the
    closest copies, and a wider one would link strangers, so texts still apart meet again
    if they share one of BANDS values of least hashes, which a pair at 0.8 does with
    0.99993 and a closer one more surely.

    The members of a value are first compared with a few of them only, so that a dense
    group is joined by links in proportion to its size; members of values that are still
    apart are then joined on the rare ends of their sets (`prefix_pairs`).
    """
    rows = write_table(texts.select("order", "key", "text").mapInPandas(_set_rows(shingle, seed), "order long, key long, node long, fingerprint long, n long, bands array<long>"), "bands")
    distinct = write_table(rows.groupBy("node").agg(F.min(F.struct("order", "key", "fingerprint")).alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands")), "prints")
    drop_table(rows)
    links = bit_links(distinct.filter("n > 0").select("node", "low.fingerprint"), max_bits)
    listed = distinct.filter("n > 0").select("node", "n", F.explode("bands").alias("value"))
    shared = listed.groupBy(F.col("value").alias("_value")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = write_table(listed.join(shared, F.col("value") == F.col("_value"), "left_semi"), "members")
    nodes = members.select(F.col("node").alias("_node")).union(links.select("node1")).union(links.select("node2")).distinct()
    wanted = distinct.join(nodes, F.col("node") == F.col("_node"), "left_semi").select("node", F.col("low.order").alias("_order"), F.col("low.key").alias("_key"))
    hashes = F.pandas_udf(lambda part: part.map(lambda t: shingle_set(t, shingle, seed).view(np.int64)), "array<long>")
    sets = write_table(texts.select("order", "key", "text").join(wanted, (F.col("order") == F.col("_order")) & (F.col("key") == F.col("_key")))
                       .groupBy("node").agg(F.first("text").alias("text")).select("node", hashes("text").alias("hashes")), "sets")
    linked = links.select("node1", F.col("node1").alias("root1"), "node2", F.col("node2").alias("root2"))
    merged = linked_roots(near_links(linked, sets, similarity)).select(F.col("node").alias("_old"), F.col("root").alias("_low"))
    roots = write_table(sets.join(merged, F.col("node") == F.col("_old"), "left").select("node", F.coalesce("_low", "node").alias("root")), "near_roots")
    drop_table(links)
    alike = (F.col("n1") >= similarity * F.col("n2")) & (F.col("n2") >= similarity * F.col("n1"))
    for step in range(PIVOTS + 1):
        placed = members.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
        apart = placed.groupBy(F.col("value").alias("_value")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min_by(
            F.struct("node", "root", "n"), F.xxhash64("node", F.lit(step))).alias("pivot")).filter("_lo < _hi")
        if step < PIVOTS:
            left = placed.select(F.col("value").alias("_v"), *[F.col(c).alias(c + "1") for c in ("node", "root", "n")])
            right = apart.select("_value", *[F.col("pivot")[c].alias(c + "2") for c in ("node", "root", "n")])
            pairs = left.join(right, (F.col("_v") == F.col("_value")) & (F.col("root1") != F.col("root2")) & alike)
        else:
            open_nodes = placed.join(apart.select("_value"), F.col("value") == F.col("_value"), "left_semi").select("node", "root").distinct()
            pairs = prefix_pairs(open_nodes, sets, similarity)
        pairs = write_table(pairs.select("node1", "root1", "node2", "root2").distinct(), "candidates")
        merged = linked_roots(near_links(pairs, sets, similarity)).select(F.col("node").alias("_old"), F.col("root").alias("_low"))
        before, roots = roots, write_table(roots.join(merged, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_low", "root").alias("root")), "near_roots")
        drop_table(before)
        drop_table(pairs)
    drop_table(members)
    drop_table(sets)
    named = roots.select(F.col("node").alias("_node"), "root")
    return (distinct.join(named, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("low").alias("low")).select("low.order", "low.key"))
