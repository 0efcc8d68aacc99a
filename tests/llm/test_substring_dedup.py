import random

from calorway.llm.substring_dedup import remove_repeats


def brute(rows, window):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, words in split.items():
        for s in range(len(words) - window + 1):
            k = tuple(words[s:s + window])
            first[k] = min(first.get(k, i), i)
    for i, words in split.items():
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s:s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (b" ".join(w for p, w in enumerate(words) if p not in gone).decode(), len(words), len(gone))
    return out


def texts(rng, n):
    words = [f"w{k}" for k in range(40)] + ["é", "ß"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 90))] for _ in range(5)]
    for i in range(n):
        body = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = "edit"
                body += p[rng.randint(0, 10):]
            else:
                body += [rng.choice(words) for _ in range(rng.randint(1, 40))]
        yield i, rng.choice([" ", "  ", "\n"]).join(body)


def test_equals_brute_force(spark):
    rows = list(texts(random.Random(4), 60)) + [(60, ""), (61, None), (62, "a b c"), (63, "x " * 200), (64, "x " * 60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "route_id long, text string, key long, start long")
    got = {r["route_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in remove_repeats(df, window=20, gram=6).collect()}
    assert got == brute(rows, 20)


def test_null_ids_repeats_and_empty(spark):
    same = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, same), (3, same), (3, same), (9, same + " end")], "route_id long, text string")
    got = sorted((r["route_id"] is None, r["route_id"] or 0, r["n_removed"], r["text"]) for r in remove_repeats(df).collect())
    assert got == [(False, 3, 0, same), (False, 3, 0, same), (False, 9, 60, "end"), (True, 0, 60, "")]
    assert remove_repeats(df.limit(0)).count() == 0


def test_blocks_doubled_in_one_text_or_under_one_id_lose_the_same(spark):
    passage = [f"p{k}" for k in range(60)]
    block = [f"a{k}" for k in range(40)] + passage + [f"b{k}" for k in range(40)]
    rows = [(3, " ".join(passage)), (5, " ".join(block + block)), (7, " ".join(["c"] + block + ["d"] + block))]
    got = {r["route_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "route_id long, text string")).collect()}
    assert got == brute(rows, 50) and got[5][2] == 120

    # other texts under one id, and under null ids, lose the passage each
    rows = [(3, " ".join(passage))] + [(i, f"{c} " + " ".join(block) + f" {c}") for i in (5, None) for c in "xy"]
    got = remove_repeats(spark.createDataFrame(rows[:3], "route_id long, text string")).collect()
    assert sorted((r["route_id"], r["n_removed"]) for r in got) == [(3, 0), (5, 60), (5, 60)]
    got = remove_repeats(spark.createDataFrame(rows[:1] + rows[3:], "route_id long, text string")).collect()
    assert sorted((r["route_id"] or 0, r["n_removed"]) for r in got) == [(0, 60), (0, 60), (3, 0)]
