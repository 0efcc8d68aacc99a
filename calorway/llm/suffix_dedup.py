"""Byte strings that occur earlier, found with suffix arrays built by two-stage sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .anchors import byte_units
from .common import write_table

GRAM = 32
#: stands between segments; no byte of UTF-8 has this value
GAP = 0xFF
#: contents of one anchor that are sorted together; larger groups are split and their results merged
GROUP = 1000
BLOCK_BYTES = 1 << 20


def _words8(data: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number; `extra` gaps follow the data."""
    longer = np.concatenate([data, np.full(extra + 8, GAP, np.uint8)])
    out, n = np.zeros(len(data) + extra, np.uint64), len(data) + extra
    for k in range(8):
        out |= longer[k:k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def ascending(data: np.ndarray) -> np.ndarray:
    """Flags of suffixes that are smaller than their successor; the last one is not."""
    n = len(data)
    step = np.flatnonzero(data[1:] != data[:-1])
    # where the run of equal bytes at i ends; the byte behind decides for the whole run
    run_end = np.append(step, n - 1)[np.searchsorted(step, np.arange(n))]
    behind = np.append(data, 0).astype(np.int16)[run_end + 1]
    return (data < behind) & (run_end < n - 1)


def _direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `at` in order of their first `depth` bytes: sort by eight bytes, then only what is tied by the next eight."""
    at = at[np.argsort(words[at], kind="stable")]
    group = np.concatenate([[0], np.cumsum(words[at][1:] != words[at][:-1])]) if len(at) else np.zeros(0, np.int64)
    slots = np.arange(len(at))
    for d in range(8, depth, 8):
        size = np.bincount(group)[group] if len(group) else np.zeros(0, np.int64)
        tied = size > 1
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        part = at[slots]
        key = words[part + d]
        order = np.lexsort((key, group))
        at[slots], key, group = part[order], key[order], group[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
    return at


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array in order of the first `depth` bytes, eight-byte words of all positions).

    Only suffixes smaller than their successor are sorted directly. The others are larger
    than their successor, so one scan of the buckets in byte order places each behind its
    already placed successor; a bucket's own run of equal bytes is scanned in rounds.
    """
    words, n = _words8(data, depth + 8), len(data)
    if not n:
        return np.zeros(0, np.int64), words
    up = ascending(data)
    small = _direct_sort(np.flatnonzero(up), words, depth)
    cut = np.searchsorted(data[small], np.arange(257)) if len(small) else np.zeros(257, np.int64)
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[data[n - 1]].append(np.array([n - 1]))
    out = []

    def deal(placed: np.ndarray, bucket: int) -> np.ndarray:
        """Predecessors of `placed` that are larger than it: those of other buckets are queued, the bucket's own returned."""
        before = placed[placed > 0] - 1
        before = before[~up[before]]
        letters = data[before]
        own, away = before[letters == bucket], before[letters != bucket]
        letters = data[away]
        order = np.argsort(letters, kind="stable")
        away, letters = away[order], letters[order]
        edges = np.flatnonzero(np.diff(letters)) + 1
        for part in np.split(away, edges) if len(away) else []:
            queues[data[part[0]]].append(part)
        return own

    for bucket in range(256):
        placed = np.concatenate(queues[bucket]) if queues[bucket] else np.zeros(0, np.int64)
        while len(placed):
            out.append(placed)
            placed = deal(placed, bucket)
        direct = small[cut[bucket]:cut[bucket + 1]]
        if len(direct):
            out.append(direct)
            deal(direct, bucket)
    return np.concatenate(out), words


def common_prefixes(at: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths, up to `most`, of each suffix of `at` and the one before it."""
    lcp = np.zeros(len(at), np.int64)
    active = np.arange(1, len(at))
    for d in range(0, most, 8):
        differ = words[at[active] + d] ^ words[at[active - 1] + d]
        # whole equal bytes in front of the first different one
        same = np.zeros(len(active), np.int64)
        for k in range(1, 9):
            same += (differ >> np.uint64(64 - 8 * k)) == 0
        lcp[active] += same
        active = active[same == 8]
        if not len(active):
            break
    return np.minimum(lcp, most)


def repeated_windows(segments: list[bytes], counts: np.ndarray, window: int, places: list[np.ndarray]
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(segment, offset, whether an earlier place of the block has the window, bytes) of all windows of the segments.

    Segment k has counts[k] windows; places are columns (order, key, start) that rank them.
    """
    data = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    at, words = suffix_array(data, window)
    segment = np.searchsorted(begin, at, side="right") - 1
    offset = at - begin[segment]
    real = offset < counts[segment]
    at, segment, offset = at[real], segment[real], offset[real]
    group = np.cumsum(common_prefixes(at, words, window) < window)
    order = np.lexsort((places[2][segment] + offset, places[1][segment], places[0][segment], group))
    segment, offset, group = segment[order], offset[order], group[order]
    repeat = np.zeros(len(group), bool)
    repeat[1:] = group[1:] == group[:-1]
    return segment, offset, repeat, data.tobytes()


def _segment_rows(window: int):
    """The bytes of every listed run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["start", "count", "anchor", "salt", "split"]
        for batch in batches:
            sizes = [len(s) for s in batch["start"]]
            out = {c: np.concatenate([np.asarray(v) for v in batch[c]]) for c in names}
            out |= {c: np.repeat(batch[c].to_numpy(), sizes) for c in ("order", "key")}
            cuts = []
            for text, starts, counts in zip(batch["text"], batch["start"], batch["count"]):
                raw = text.encode("utf-8", "surrogatepass")
                cuts += [raw[s:s + n + window - 1] for s, n in zip(starts.tolist(), counts.tolist())]
            yield pd.DataFrame(out | {"bytes": cuts})
    return run


def _sorted_blocks(window: int, block_bytes: int):
    """Suffix-sort blocks of whole (anchor, salt) groups; rows arrive sorted by group."""
    import xxhash

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        places = [rows[c].to_numpy(np.int64) for c in ("order", "key", "start")]
        segment, offset, repeat, raw = repeated_windows(rows["bytes"].tolist(), rows["count"].to_numpy(), window, places)
        # repeats in text order, consecutive ones as one row
        place = np.lexsort((offset[repeat], segment[repeat]))
        s, o = segment[repeat][place], offset[repeat][place]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
        first = np.flatnonzero(new)
        done = pd.DataFrame({"order": places[0][s[first]], "key": places[1][s[first]], "start": places[2][s[first]] + o[first],
                             "count": np.diff(np.append(first, len(s))), "w1": 0, "w2": 0, "open": False})
        # the first place in the block of every window of a split group still has to meet the group's other blocks
        left = ~repeat & rows["split"].to_numpy()[segment]
        s, o, texts = segment[left], offset[left], rows["bytes"].tolist()
        half = np.frombuffer(b"".join([xxhash.xxh3_128_digest(texts[a][b:b + window]) for a, b in zip(s.tolist(), o.tolist())]), "<i8").reshape(-1, 2)
        more = pd.DataFrame({"order": places[0][s], "key": places[1][s], "start": places[2][s] + o, "count": 1,
                             "w1": half[:, 0], "w2": half[:, 1], "open": True})
        return pd.concat([done, more])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for batch in batches:
            if batch.empty:
                continue
            anchor, salt = batch["anchor"].to_numpy(), batch["salt"].to_numpy()
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            if (anchor[0], salt[0]) != last:
                edges = np.append(0, edges)
            taken, at = np.append(0, np.cumsum(batch["count"].to_numpy() + window)), 0
            # a block ends at the first border of groups past its size
            for edge in edges.tolist():
                if size + taken[edge] - taken[at] >= block_bytes:
                    yield settle(pd.concat([*held, batch.iloc[at:edge]], ignore_index=True))
                    held, size, at = [], 0, edge
            held.append(batch.iloc[at:])
            size, last = size + int(taken[-1] - taken[at]), (anchor[-1], salt[-1])
        if held:
            yield settle(pd.concat(held, ignore_index=True))
    return run


def earlier_strings(routes: DataFrame, window: int = 100, gram: int = GRAM, group: int = GROUP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(order, key, start, count): per text, starts of `window`-byte strings that also start earlier.

    Runs of windows that share an anchor are the unit. Runs of one content are folded to
    their first place, so a passage enters one sort however often it occurs; where an
    anchor has several contents, their bytes meet in one block, get a suffix array, and
    neighbours with a common prefix of `window` are one string. Anchors with more than
    `group` contents are split over blocks; the first places of their strings are then
    merged by digest, with map-side minima.
    """
    texts = R.keyed_texts(routes)
    runs = R.repeated_runs(texts, bytes, byte_units, window, gram, across=False)
    classes = R.run_classes(runs)
    later = R.later_members(runs, classes, F.col("first") < F.struct("order", "key", "start"))
    salt = F.when(F.col("n_classes") > group, F.pmod("d1", F.ceil(F.col("n_classes") / F.lit(group)))).otherwise(0).cast("long")
    open_runs = classes.filter("n_classes > 1").select("first.*", "count", "anchor", salt.alias("salt"), (F.col("n_classes") > group).alias("split"))
    fields = ["start", "count", "anchor", "salt", "split"]
    segments = (R.text_lists(open_runs, texts.select("order", "key", "text").dropDuplicates(["order", "key"]), fields, "inner")
                .select("order", "key", "text", *[R.column_of(c).alias(c) for c in fields]).mapInPandas(_segment_rows(window), "start long, count long, anchor long, salt long, split boolean, order long, key long, bytes binary"))
    blocks = segments.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = write_table(blocks.mapInPandas(_sorted_blocks(window, block_bytes), "order long, key long, start long, count long, w1 long, w2 long, open boolean"), "strings")
    heads = found.filter("open")
    least = (heads.groupBy(F.col("w1").alias("_1"), F.col("w2").alias("_2"))
             .agg(F.min(F.struct("order", "key", "start")).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    merged = heads.join(least, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2"))).filter(F.col("first") < F.struct("order", "key", "start"))
    cols = ["order", "key", "start", "count"]
    return later.select(cols).unionByName(found.filter("not open").select(cols)).unionByName(merged.select(cols))


def remove_strings(routes: DataFrame, window: int = 100, gram: int = GRAM, group: int = GROUP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(route_id, kept, n_bytes, n_removed, spans) for every row of `routes` (route_id, text).

    Texts are UTF-8 bytes. A byte goes if a string of `window` bytes over it also starts
    earlier: in a text with a smaller route_id, or further ahead in the same text, also
    overlapping; strings are judged on the input. `kept` is the remaining bytes as binary,
    since a cut may fall inside a character; `spans` the removed stretches (first_byte, n_bytes).

    Ids must be numbers; a null id comes after all others, texts of one id are ordered by
    a hash of the text, and repeated rows count as one text and get the same result. Null
    counts as empty. Other columns are ignored, an empty table gives no row.
    """
    @F.pandas_udf("kept binary, n_bytes long, n_removed long, spans array<struct<first_byte:long,n_bytes:long>>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, counts in parts:
            rows = []
            for text, s, n in zip(texts, starts, counts):
                raw = text.encode("utf-8", "surrogatepass")
                gone = R.covered(s, n, len(raw), window)
                rows.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()),
                             [{"first_byte": int(a), "n_bytes": int(b - a)} for a, b in R.stretches(gone)]))
            yield pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "spans"])

    strings = write_table(earlier_strings(routes, window, gram, group, block_bytes), "repeats")
    listed = R.text_lists(strings, R.keyed_texts(routes), ["start", "count"], "left")
    return listed.select("route_id", cut("text", R.column_of("start"), R.column_of("count")).alias("_c")).select("route_id", "_c.*")
