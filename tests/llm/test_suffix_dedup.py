import random

import numpy as np

from calorway.llm import suffix_dedup as S


def brute(rows, window):
    raw = {i: (t or "").encode() for i, t in rows}
    first, out = {}, {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - window + 1):
            first.setdefault(raw[i][s:s + window], (i, s))
    for i, b in raw.items():
        gone = set()
        for s in range(len(b) - window + 1):
            if first[b[s:s + window]] < (i, s):
                gone.update(range(s, s + window))
        spans = sum(1 for p in gone if p - 1 not in gone)
        out[i] = (bytes(x for p, x in enumerate(b) if p not in gone), len(b), len(gone), spans)
    return out


def texts(rng, n):
    words = ["the ", "of ", "straße ", "é", "aaaaaaa", "\n", "shade ", "x"]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(5)]
    for i in range(n):
        body = "".join(rng.choice(passages)[rng.randint(0, 4):] if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
                       for _ in range(rng.randint(1, 5)))
        yield i, body


def test_equals_brute_force(spark):
    rows = list(texts(random.Random(7), 50)) + [(50, ""), (51, None), (52, "a" * 300), (53, "ab" * 200), (54, "short")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "route_id long, text string, anchor long, bytes binary")
    want = brute(rows, 30)
    for group in (1000, 2):
        got = {r[0]: (bytes(r[1]), r[2], r[3], len(r[4])) for r in S.remove_strings(df, window=30, gram=10, group=group, block_bytes=500).collect()}
        assert got == want


def test_two_stage_order_and_prefixes():
    rng = random.Random(3)
    for size in (1, 2, 50, 400):
        for alphabet in (1, 2, 5, 200):
            raw = bytes(rng.randrange(alphabet) for _ in range(size))
            data = np.frombuffer(raw, np.uint8)
            at, words = S.suffix_array(data, 40)
            padded = raw + b"\xff" * 60
            cut = [padded[p:p + 40] for p in at]
            assert sorted(at.tolist()) == list(range(size))
            up = S.ascending(data)
            assert all(up[i] == (raw[i:] < raw[i + 1:]) for i in range(size))
            # bytes past the end count as gaps, so compare only where both are inside
            assert all(a <= b or min(size - p, size - q) < 40 for a, b, p, q in zip(cut, cut[1:], at, at[1:]))
            lcp = S.common_prefixes(at, words, 40)
            for k in range(1, size):
                n = next((j for j in range(40) if cut[k][j] != cut[k - 1][j]), 40)
                assert lcp[k] == n


def test_repeated_rows_null_ids_and_empty(spark):
    same = "".join(chr(97 + k % 26) + str(k) for k in range(80))
    df = spark.createDataFrame([(None, same), (3, same), (3, same)], "route_id long, text string")
    got = sorted((r[0] is None, r[3]) for r in S.remove_strings(df).collect())
    assert got == [(False, 0), (False, 0), (True, len(same))]
    assert S.remove_strings(df.limit(0)).count() == 0
