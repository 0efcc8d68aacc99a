import itertools
import random

import pytest
import xxhash

from calorway.llm import simhash as S


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    bits = sum((1 << b) for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def brute_components(prints, most):
    parent = dict(enumerate(range(len(prints))))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin((prints[i] ^ prints[j]) & (2 ** 64 - 1)).count("1") <= most:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", None, "one", "One", " \t\n", "Éa b", "éa b", "x " * 3000]
    rows = list(enumerate(texts))
    got = {r[0]: (r[1], r[2]) for r in S.near_routes(spark.createDataFrame(rows, "route_id long, text string")).collect()}
    prints = [brute(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == brute_components(prints, 4)


def test_dense_groups_and_far_ends_are_linked(spark):
    rng = random.Random(5)
    prints = {0, 0b1111, 0b11110000 | 0b1111, (1 << 63) | 7}
    for center in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p, p, 0) for p in signed], "node long, fingerprint long, more long")
    roots = {r["node"]: r["root"] for r in S.print_roots(nodes, 4).collect()}
    want = brute_components(signed, 4)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots[p])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_radii_cover_the_distance():
    costs = [[0, 5, 50, 500], [0, 1, 2, 3], [0, 9, 90, 900]]
    radii = S.allocate(costs, 3)
    assert sum(r + 1 for r in radii) == 3 and radii == [-1, 2, -1]


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty_and_null_tables(spark, rows):
    df = spark.createDataFrame(rows, "route_id long, text string")
    assert S.near_routes(df).count() == len(rows)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 9, 9), (1, "a b c d e", 8, 8), (0, "a b c d e", 7, 7)],
                               "route_id long, text string, fingerprint long, root long")
    assert sorted(r[2] for r in S.near_routes(df).collect()) == [0, 0, 0]


def test_first_of_near_copies(spark):
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(6)]
    rows, firsts = [], set()
    for b, base in enumerate(bases):
        firsts.add(len(rows))
        for k in range(5):
            copy = list(base)
            if k:
                copy[rng.randrange(150)] = "edit"
            rows.append((len(rows), b * 10 + k, " ".join(copy)))
    got = S.first_of_near(spark.createDataFrame(rows, "order long, key long, text string")).collect()
    assert {r["order"] for r in got} == firsts and len(got) == len(firsts)


def test_near_copies_are_those_of_similar_shingle_sets(spark):
    rng, texts = random.Random(12), []
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(60)]
        texts.append(base)
        texts.append(base[:30] + ["edit"] + base[31:])  # 51 of 61 shingles
        texts.append(base[:52] + [f"v{rng.randrange(4000)}" for _ in range(8)])  # 48 of 64
        texts.append(base[:20] + ["edit"] + base[21:40] + ["edit"] + base[41:])  # 46 of 66
    texts += [[], [], ["one"], ["One"], ["a", "b"]]
    sets = [{tuple(w.lower() for w in t[i:i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    rows = [(i, i, " ".join(t)) for i, t in enumerate(texts)]
    got = S.first_of_near(spark.createDataFrame(rows, "order long, key long, text string")).collect()
    assert sorted(r["order"] for r in got) == [i for i in range(len(texts)) if find(i) == i]


def word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def firsts_by_brute_force(texts, least=0.8):
    sets, parent = word_sets(texts), list(range(len(texts)))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    empty = [i for i, s in enumerate(sets) if not s]
    pairs = {(i, j) for listed in holders.values() for i, j in itertools.combinations(listed, 2)} | set(zip(empty, empty[1:]))
    for i, j in pairs:
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if find(i) == i]


def test_first_of_near_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    got = S.first_of_near(spark.createDataFrame(list(zip(range(len(texts)), range(len(texts)), texts)), "order long, key long, text string")).collect()
    assert sorted(r["order"] for r in got) == firsts_by_brute_force(texts)


@pytest.mark.parametrize("salt_rows", [2000, 3])
def test_prefix_pairs_miss_no_similar_pair(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(S, "SALT_ROWS", salt_rows)
    rng, sets = random.Random(21), [[], [7]]
    for size in (1, 5, 40, 90):
        base = rng.sample(range(10_000), size)
        for _ in range(25):  # a dense group whose members are alike between 0.5 and 1
            kept = [x for x in base if rng.random() > 0.09]
            sets.append(sorted(set(kept + rng.sample(range(10_000, 20_000), rng.randint(0, size // 8)))))
    rows = [(i, i, s) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame([r[:2] for r in rows], "node long, root long")
    held = spark.createDataFrame([(r[0], r[2]) for r in rows], "node long, hashes array<long>")
    got = {(r["node1"], r["node2"]) for r in S.prefix_pairs(nodes, held, 0.8).collect()}
    as_sets = [set(s) for s in sets]
    similar = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
               if as_sets[i] & as_sets[j] and len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j])}
    touching = sum(bool(a & b) for a, b in itertools.combinations(as_sets, 2))
    # of the pairs that share something but are not similar, most never meet
    assert similar <= got and len(similar) > 100 and len(got - similar) < (touching - len(similar)) / 2
    joined = spark.createDataFrame([(r[0], 0) for r in rows], "node long, root long")
    assert S.prefix_pairs(joined, held, 0.8).count() == 0 and S.prefix_pairs(nodes.limit(0), held, 0.8).count() == 0


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "band_values", lambda hashes: S.np.array([hash(hashes.tobytes())], S.np.int64))  # no two sets share one
    rng, rows, firsts = random.Random(14), [], []
    for _ in range(5):
        base = [f"w{rng.randrange(5000)}" for _ in range(900)]
        firsts.append(len(rows))
        for at in (0, 200, 500, 800):  # 890 of 900 shingles
            rows.append(base[:at] + (["edit"] if at else []) + base[at + bool(at):])
    for k in range(3):  # a word that outweighs all others: equal fingerprints, other sets
        firsts.append(len(rows))
        rows.append(["same"] * 2000 + [f"w{rng.randrange(5000)}" for _ in range(60)])
    texts = [" ".join(r) for r in rows]
    prints = [S.text_fingerprint(t, 5)[0] for t in texts]
    assert len(set(prints[-3:])) == 1 and firsts == firsts_by_brute_force(texts)
    by_bits = brute_components([p & (2 ** 64 - 1) for p in prints], 4)
    assert [S.set_and_print(t, 5, 42)[1] for t in texts] == prints
    got = S.first_of_near(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "order long, key long, text string")).collect()
    assert sorted(r["order"] for r in got) == sorted({*by_bits, *firsts})
    wider = S.first_of_near(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "order long, key long, text string"), max_bits=12).collect()
    assert sorted(r["order"] for r in wider) == firsts
