import math
import zlib

from calorway.llm import toxicity as T

GRAMMAR = T.Grammar({"moron": 5.0}, {"lowei": 4.0}, (1.0,) * T.N_FEATURES)


def features(text):
    return T.text_features(GRAMMAR, text, {}).tolist()


def test_channels_of_a_clause():
    plain, negated, reported, aimed = features("a moron walks"), features("not a moron walks"), features("they wrote: moron"), features("you moron")
    assert plain[0] > 0 and plain[1:4] == [0, 0, 0]
    assert negated[0] == 0 and negated[1] > 0
    assert features("he said moron")[2] > 0 and reported[2] == 0 and reported[0] > 0  # a stop ends the report
    assert aimed[0] > 0 and aimed[3] == aimed[0]
    assert features("I will kill you")[4] > 0 and features("I will kill you")[7] > 0
    assert features("Loweisch###")[0] > 0
    assert features(None) == features("") == features("calm words") == [0.0] * 10 + [1.0]


def test_learning_finds_planted_words_and_leaves_held_out_rows_aside(spark):
    calm = ["the shaded street is quiet", "walk along the canopy today", "cool route by the park"]
    rows = [(i, " ".join("w" + chr(97 + k) * 2 + "".join(chr(97 + int(c)) for c in str(i)) for k in range(25)) + f" {calm[i % 3]}"
             + (" grumbler you" if i % 4 == 0 else "")) for i in range(400)] + [(None, None), (1000, "")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "route_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "route_id long, toxic int")
    grammar = T.learn_grammar(docs, labels)
    assert "grumbler" in grammar.words
    got = {r["route_id"]: r for r in T.score_texts(docs, grammar).withColumn("held", T.held_out(docs["route_id"])).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = sum(got[i]["predicted"] != (i % 4 == 0) for i in range(400) if got[i]["held"])
    assert wrong == 0
    assert all(got[i]["held"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400)) and got[None]["held"] is False


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "route_id long, text string")
    none = spark.createDataFrame([], "route_id long, toxic int")
    assert T.score_texts(docs, T.learn_grammar(docs, none)).first()["score"] == 0.5
    assert T.score_texts(docs.limit(0), GRAMMAR).count() == 0


def test_texts_that_share_a_phrase_all_count(spark):
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(1000, 1200)]
    rows = [(f"the shaded street is quiet tonight {n}{' grumbler' if i % 4 == 0 else ' walker'} " + " ".join([n] * (i % 7)), int(i % 4 == 0)) for i, n in enumerate(names)]
    rows += rows[:40]  # copies count once
    words, _ = T.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert abs(words["grumbler"] - (math.log(50.5 / 51) - math.log(0.5 / 151))) < 1e-9
