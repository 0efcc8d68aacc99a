import random
import re

from calorway.llm.quality_rules import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines, dup = {}, set(), 0
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeat = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "Ä", "#x", "of", "and|", "x" * 30]) for _ in range(rng.randint(0, 60))).replace("Ä the", "\n") for _ in range(80)]
    texts += [None, "", " \n\t", "a b c d e " * 400, "line\nline\n \nline", "same words here now then same words here now then"]
    df = spark.createDataFrame([(i if i % 7 else None, t, 0) for i, t in enumerate(texts)], "route_id long, text string, n_words int")
    got = quality_rules(df).collect()
    key = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(tuple(r[k] for k in key) for r in got) == sorted(brute(t) for t in texts)
    assert all(r["kept"] == (not r["failed_rules"]) for r in got)


def test_rules_name_what_fails(spark):
    clean = "walk along the shaded side of the avenue and turn left at the park where it is cool and quiet"
    df = spark.createDataFrame([(1, clean), (2, "too short"), (3, "### $$$ %%% " * 10), (4, clean), (4, clean)], "route_id long, text string")
    got = {r["route_id"]: r for r in quality_rules(df).collect()}
    assert got[1]["kept"] and "length" in got[2]["failed_rules"] and "symbols" in got[3]["failed_rules"]
    assert quality_rules(df).count() == 5 and quality_rules(df.limit(0)).count() == 0
