"""Token counts by a compiled finite-state transducer whose chunk maps compose."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: characters of a text that one chunk row holds, and of a lane inside a chunk
CHUNK, LANE = 1 << 18, 256
# Character classes; a class is what a transition reads.
LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER, C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D, END = range(15)
N_CLASSES = 15
# The endings of the contractions that the tokenizer splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# States: what kind of piece is open. ANY is the state before a text.
S_ANY, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANK, S_CUT1, S_CUT2 = range(8)
N_STATES = 8


@lru_cache(maxsize=4)
def _class_table(path: str) -> np.ndarray:
    """Class of every code point as the tokenizer's own splitter sees it.

    Letters and numbers differ between Unicode versions, so the splitter itself is asked:
    in "!a" + c + "!" a letter stays with the a, a number stands alone, any other
    character joins the mark behind it.
    """
    import sys
    import unicodedata

    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    asked = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LNM"]
    for at in range(0, len(asked), 50_000):
        part = asked[at:at + 50_000]
        starts = {p[1][0] for p in split("".join("!a" + chr(c) + "!" for c in part))}
        for k, c in enumerate(part):
            if 4 * k + 2 not in starts:
                table[c] = LETTER
            elif 4 * k + 3 in starts:
                table[c] = NUMBER
    # The characters of Unicode's White_Space property.
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for letter, cls in zip("strevmld", (C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D)):
        table[ord(letter)] = cls
    table[-1] = END
    return table


def _kind(c: int) -> int:
    """0 letter, 1 number, 2 white space, 3 other, 4 end."""
    return {LETTER: 0, NUMBER: 1, BLANK: 2, SPACE: 2, QUOTE: 3, OTHER: 3, END: 4}.get(c, 0)


@lru_cache(maxsize=1)
def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts here) by [state, class, class after, class after that].

    The rules: a quote and a contraction ending that starts a piece is a piece; else a
    run of letters, numbers or other marks is one, with one blank before it; white space
    is one piece but for its last character when something follows, which stands alone
    or, as a blank, joins what follows.
    """
    go = np.zeros((N_STATES, N_CLASSES, N_CLASSES, N_CLASSES), np.uint8)
    cut = np.zeros_like(go)
    two = {(C_R, C_E), (C_V, C_E), (C_L, C_L)}
    run = {0: S_LETTER, 1: S_NUMBER, 3: S_OTHER}
    for s in range(N_STATES):
        for c in range(N_CLASSES - 1):
            for d in range(N_CLASSES):
                for e in range(N_CLASSES):
                    kind = _kind(c)
                    if s == S_CUT2:  # inside a contraction of two letters
                        go[s, c, d, e] = S_CUT1
                        continue
                    if s == S_CUT1:  # its last letter: what follows starts anew
                        go[s, c, d, e] = S_ANY
                        continue
                    if kind == 2:
                        # the last blank before a mark, letter or number opens the next piece
                        last = _kind(d) not in (2, 4)
                        start = s != S_SPACE or last
                        go[s, c, d, e] = (S_BLANK if c == BLANK else S_ANY) if last else S_SPACE
                    else:
                        joins = s == S_BLANK or s == run[kind]
                        start = not joins
                        short = start and c == QUOTE and (d in (C_S, C_T, C_M, C_D) or (d, e) in two)
                        go[s, c, d, e] = (S_CUT2 if (d, e) in two else S_CUT1) if short else run[kind]
                    cut[s, c, d, e] = start
    flat = (N_STATES, N_CLASSES ** 3)
    return go.reshape(flat), cut.reshape(flat)


def lane_maps(symbols: np.ndarray, lane: int = LANE) -> np.ndarray:
    """States x lanes: where each lane of `symbols` leads from every state it may be entered in."""
    go, _ = _transitions()
    lanes = -(-len(symbols) // lane)
    wide = np.full(lanes * lane, -1, np.int32)
    wide[:len(symbols)] = symbols
    wide = np.ascontiguousarray(wide.reshape(lanes, lane).T)
    now = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for t in range(lane):
        step = go[now, wide[t][None, :]]
        now = np.where(wide[t][None, :] >= 0, step, now) if wide[t, -1] < 0 else step
        if t % 4 == 3 and (now == now[0]).all() and t + 1 < lane:
            # every entry state has met: one row of states is enough for the rest
            one = now[0]
            for u in range(t + 1, lane):
                nxt = go[one, wide[u]]
                one = np.where(wide[u] >= 0, nxt, one) if wide[u, -1] < 0 else nxt
            return np.repeat(one[None, :], N_STATES, axis=0)
    return now


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the lane maps: column k leads from the first lane's entry to lane k's exit."""
    out, gap = maps.copy(), 1
    while gap < out.shape[1]:
        out[:, gap:] = np.take_along_axis(out[:, gap:], out[:, :-gap].astype(np.intp), axis=0)
        gap *= 2
    return out


def piece_starts(symbols: np.ndarray, entry: int = S_ANY, lane: int = LANE) -> tuple[np.ndarray, int]:
    """(flags of positions that start a piece, state after the last) when entered in `entry`."""
    go, cut = _transitions()
    if not len(symbols):
        return np.zeros(0, bool), entry
    lane = min(lane, len(symbols))
    exits = scan_maps(lane_maps(symbols, lane))[entry]
    lanes = len(exits)
    now = np.concatenate([[entry], exits[:-1]]).astype(np.uint8)
    wide = np.zeros(lanes * lane, np.int32)
    wide[:len(symbols)] = symbols
    wide = np.ascontiguousarray(wide.reshape(lanes, lane).T)
    flags = np.empty((lane, lanes), bool)
    for t in range(lane):
        flags[t] = cut[now, wide[t]]
        now = go[now, wide[t]]
    return flags.T.ravel()[:len(symbols)], int(exits[-1])


class PieceCounter:
    """Tokens of a piece: the merges of the tokenizer file, run once per distinct piece."""

    def __init__(self, path: str, memo: int = 1 << 20):
        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memo, self.most = {}, memo

    def __call__(self, piece: bytes) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = self._merge([self.letters[b] for b in piece])
            if len(piece) <= 64:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def _merge(self, parts: list) -> int:
        """Merge the best ranked pair, leftmost first, until none is left: a heap over a linked list."""
        left, right, rank = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1)), self.rank
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapify(heap)
        count, end = len(parts), len(parts)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i] if parts[i] == a else end
            if j >= end or parts[j] != b:
                continue
            parts[i], parts[j], count = a + b, None, count - 1
            right[i] = right[j]
            if right[j] < end:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < end and (pair := (parts[x], parts[y])) in rank:
                    heappush(heap, (rank[pair], x, *pair))
        return count


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the tokenizer file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in set(plain):
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


@lru_cache(maxsize=4)
def compiled(path: str) -> tuple[np.ndarray, PieceCounter]:
    return _class_table(path), PieceCounter(path)


def _symbols(codes: np.ndarray, table: np.ndarray, after: tuple[int, int] = (END, END)) -> np.ndarray:
    cls = table[codes]
    longer = np.concatenate([cls, np.array(after, np.uint8)]).astype(np.int32)
    return (longer[:-2] * N_CLASSES + longer[1:-1]) * N_CLASSES + longer[2:]


def count_pieces(texts: list[str], table: np.ndarray, counter: PieceCounter) -> np.ndarray:
    """Tokens of every text, each taken as a whole, for many texts in one run of the transducer.

    The texts are laid end to end with an END behind each, so a lane may hold parts of
    several. Pieces are cut at the flags; equal pieces of the run are counted once.
    """
    if not texts:
        return np.zeros(0, np.int64)
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    codes = np.zeros(int(lengths.sum()) + len(raw), np.uint32)
    ends = np.cumsum(lengths + 1) - 1
    keep = np.ones(len(codes), bool)
    keep[ends] = False
    codes[keep] = np.frombuffer(b"".join(raw), np.uint32)
    codes[ends] = len(table) - 1
    flags, _ = piece_starts(_symbols(codes, table))
    flags[ends] = True
    starts = np.flatnonzero(flags)
    bounds = np.append(starts[1:], len(codes))
    owner = np.searchsorted(ends, starts)
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, ends)] = False
    starts, bounds, owner = starts[real], bounds[real], owner[real]
    out = np.zeros(len(texts), np.int64)
    if not len(starts):
        return out
    # a 64-bit sum over random powers finds equal pieces inside this run
    codes64 = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (codes64 + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        step = np.uint64(0x2545F4914F6CDD1D)
        power = np.multiply.accumulate(np.full(int((bounds - starts).max()) + 1, step, np.uint64))
        base = np.zeros(len(codes), np.int64)
        base[starts] = starts
        within = np.minimum(np.arange(len(codes)) - np.maximum.accumulate(base), len(power) - 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[within])])
        keys = sums[bounds] - sums[starts]
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    found = np.fromiter((counter(codes[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
                         for a, b in zip(starts[first].tolist(), bounds[first].tolist())), np.int64, len(first))
    return np.bincount(owner, weights=found[inverse], minlength=len(texts)).astype(np.int64)


def chunk_map(text: str, after: str, table: np.ndarray, counter: PieceCounter) -> list[tuple[int, int, int, int]]:
    """For every entry state: (exit state, length of the head, tokens of whole pieces, length of the tail).

    The head continues the piece that is open before the chunk; the tail is the piece that
    is open behind it. Without a start inside, the whole chunk is head and the tail is -1.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ahead = [int(table[ord(c)]) for c in after[:2]] + [END, END]
    symbols, out = _symbols(codes, table, (ahead[0], ahead[1])), []
    for entry in range(N_STATES):
        flags, leave = piece_starts(symbols, entry)
        starts = np.flatnonzero(flags)
        if not len(starts):
            out.append((leave, len(text), 0, -1))
            continue
        pieces = [text[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        out.append((leave, int(starts[0]), sum(counter(p.encode("utf-8", "surrogatepass")) for p in pieces), len(text) - int(starts[-1])))
    return out


def compose_chunks(chunks: list[tuple[str, str, list]], counter: PieceCounter) -> int:
    """Tokens of a text from its chunks' (text, _, map), left to right."""
    state, open_piece, total = S_ANY, [], 0
    for text, moves in chunks:
        leave, head, inner, tail = moves[state]
        open_piece.append(text[:head])
        if tail >= 0:
            total += counter("".join(open_piece).encode("utf-8", "surrogatepass")) if any(open_piece) else 0
            total += inner
            open_piece = [text[len(text) - tail:]]
        state = leave
    return total + (counter("".join(open_piece).encode("utf-8", "surrogatepass")) if any(open_piece) else 0)


def _chunk_rows(tokenizer: str, many_chars: int = 1 << 20):
    """mapInPandas body: tokens of single-chunk rows; text and map, as JSON, of the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, counter = compiled(tokenizer)
        for batch in batches:
            out = batch[["row", "segment", "chunk", "chunks"]].copy()
            tokens, maps = np.zeros(len(batch), np.int64), [None] * len(batch)
            texts, single = batch["text"].tolist(), (batch["chunks"] <= 1).to_numpy()
            group, size = [], 0
            for k in range(len(batch)):
                if single[k]:
                    group.append(k)
                    size += len(texts[k])
                else:
                    maps[k] = json.dumps([texts[k], chunk_map(texts[k], batch["after"].iat[k], table, counter)])
                if group and (size >= many_chars or k == len(batch) - 1):
                    tokens[group] = count_pieces([texts[g] for g in group], table, counter)
                    group, size = [], 0
            if group:
                tokens[group] = count_pieces([texts[g] for g in group], table, counter)
            out["tokens"], out["map"] = tokens, maps
            yield out
    return run


def _compose_rows(tokenizer: str):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, counter = compiled(tokenizer)
        chunks = [tuple(json.loads(m)) for m in rows.sort_values("chunk")["map"]]
        return pd.DataFrame({"row": [key[0]], "tokens": [compose_chunks(chunks, counter)]})
    return run


def count_tokens(routes: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """(route_id, n_bytes, n_tokens, over_limit) for every row of `routes` (route_id, text).

    `tokenizer` is the path of a byte-level BPE tokenizer file, the same on all machines.
    Its splitting rules are compiled into a deterministic transducer over character
    classes; pieces are annotated with the tokens that the file's merges emit for them.
    Texts run in lanes: every lane gets a map from entry to exit state, a prefix scan
    composes the maps, and a second pass emits. Texts of more than `chunk` characters are
    cut into chunk rows whose maps are composed per text, so no task holds a whole long
    text's working arrays. Special strings of the file count one token and part the text.

    Null counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay, other columns
    are ignored, an empty table gives no row.
    """
    from .common import write_table

    special = json.load(open(tokenizer, encoding="utf-8"))["added_tokens"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = routes.select("route_id", text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    segments = F.array("text")
    if special:
        found, pattern = F.lit(False), "|".join("\\Q" + t["content"] + "\\E" for t in special)
        for t in special:
            found = found | F.contains(F.col("text"), F.lit(t["content"]))
        segments = F.when(found, F.split("text", pattern)).otherwise(segments)
    # the first row of a text carries its id and size; others only their chunk
    parts = (rows.select("row", "route_id", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(segments).alias("segment", "text"))
             .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(chunk))).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("after", F.when(F.col("chunks") > 1, F.substring("text", (F.col("chunk") + 1) * chunk + 1, F.lit(2))))
             .withColumn("text", F.when(F.col("chunks") > 1, F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.col("text"))))
    kind = routes.schema["route_id"].dataType.simpleString()
    body = _chunk_rows(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = next(body(iter([batch])))
            out["route_id"], out["n_bytes"] = batch["route_id"], batch["n_bytes"]
            yield out

    done = write_table(parts.mapInPandas(run, f"row long, segment int, chunk int, chunks int, tokens long, map string, route_id {kind}, n_bytes long"), "tokens")
    long_ones = done.filter("chunks > 1").groupBy("row", "segment").applyInPandas(_compose_rows(tokenizer), "row long, tokens long")
    # a special string stands between two segments of a text
    short = done.select("row", (F.when(F.col("chunks") == 1, F.col("tokens")).otherwise(0) + F.when((F.col("segment") > 0) & (F.col("chunk") == 0), 1).otherwise(0)).alias("tokens"),
                        F.when((F.col("segment") == 0) & (F.col("chunk") == 0), F.struct("route_id", "n_bytes")).alias("own"))
    total = (short.unionByName(long_ones.withColumn("own", F.lit(None).cast(short.schema["own"].dataType))).groupBy("row")
             .agg(F.sum("tokens").alias("n_tokens"), F.max("own").alias("own")))
    return total.select("own.route_id", "own.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
