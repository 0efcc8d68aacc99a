import random
import re

from calorway.llm.decontaminate import phrase_matches


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, window):
    out = {}
    for i, text in texts:
        words, hit, ids = terms(text), set(), set()
        for item, body in items:
            w = terms(body)
            for a in range(max(1, len(w) - window + 1)) if w else []:
                p = w[a:a + window]
                for s in range(len(words) - len(p) + 1):
                    if words[s:s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        ids.add("" if item is None else str(item))
        out[i] = (len(words), len(hit), sorted(ids))
    return out


def data():
    rng = random.Random(8)
    vocabulary = ["the", "of", "Street", "shade", "Élan", "x1", "canopy", "walk", "sun", "tree"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([9, 5, 3, 1, 0, 12, 7, 6])] + [(None, "lost canopy"), (20, None), (0, "the of the")]
    texts = []
    for i in range(60):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += terms(rng.choice(items)[1]) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        texts.append((i, rng.choice([" ", ", ", "-"]).join(body).upper() if rng.random() < 0.2 else " ".join(body)))
    return texts + [(60, None), (61, ""), (62, "lost  CANOPY!"), (62, "lost  CANOPY!")], items


def test_equals_brute_force(spark):
    texts, items = data()
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in texts], "route_id long, text string, key long, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (100_000, 0):
        got = phrase_matches(df, bench, window=6, broadcast_rows=most).collect()
        assert len(got) == len(texts)
        assert {r["route_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == brute(texts, items, 6)
        assert all(set(r["item_ids"]) <= set(r["near_item_ids"]) for r in got)


def test_near_matches_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "walk along the shaded canopy street")], "item_id long, text string")
    df = spark.createDataFrame([(1, "we walk along the canopy shaded street today"), (2, "walk far away from the street")], "route_id long, text string")
    assert {r["route_id"]: (r["item_ids"], r["near_item_ids"]) for r in phrase_matches(df, items).collect()} == {1: ([], ["1"]), 2: ([], [])}
    assert phrase_matches(df.limit(0), items).count() == 0
    assert [r["n_hit"] for r in phrase_matches(df, items.limit(0)).collect()] == [0, 0]
