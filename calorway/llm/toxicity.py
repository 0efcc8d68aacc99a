"""Toxicity of texts by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rows_in, write_table

# Closed word classes of the grammar in English, German, French and Spanish.
THREATS = ("kill hurt destroy beat stab shoot burn töten schlagen vernichten verletzen tuer frapper détruire blesser "
           "matar golpear destruir quemar").split()
TARGETS = ("you your yours he she they them him her du dich dir ihr euch sie tu toi vous vos ton il elle ils "
           "tú te ti ustedes ellos ella él").split()
NEGATIONS = "not no never nobody none nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORTS = ("said says told wrote quoted claims sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma").split()
NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n]+")
#: prefix lengths that a family of words may share
PREFIXES = (4, 5, 6)
#: words after a negation or a report that it still governs
REACH = 4
N_FEATURES = 11
#: labels up to this many rows, about 16 bytes each, are broadcast; more meet the texts by a shuffle
BROADCAST_LABELS = 2_000_000


def held_out(route_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by `folds`; null ids are not."""
    return F.coalesce(F.crc32(route_id.cast("string")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Grammar:
    """Learned insult weights by word and by prefix, and the weights of the clause features."""

    words: dict
    prefixes: dict
    coefficients: tuple

    def classify(self, word: str) -> tuple[int, float]:
        """(class, weight) of a word: the lexicon transducer, longest match first."""
        if word[0] in ".,;:!?\n":
            return STOP, 0.0
        for cls, listed in ((THREAT, _THREATS), (TARGET, _TARGETS), (NEGATION, _NEGATIONS), (REPORT, _REPORTS)):
            if word in listed:
                return cls, 1.0
        if word in self.words:
            return INSULT, self.words[word]
        for n in sorted(PREFIXES, reverse=True):
            if len(word) >= n and word[:n] in self.prefixes:
                return INSULT, self.prefixes[word[:n]]
        return NEUTRAL, 0.0


_THREATS, _TARGETS, _NEGATIONS, _REPORTS = map(frozenset, (THREATS, TARGETS, NEGATIONS, REPORTS))


def clause_features(classes: list[tuple[int, float]]) -> np.ndarray:
    """Weights that the clause transducers emit for one text.

    A clause is read left to right. Negation and reported speech open a state that lasts
    REACH words; an insult or threat is emitted into the channel of the state it is met
    in; at the end of the clause a target doubles as a channel of its own.
    """
    out = np.zeros(N_FEATURES)
    negated = reported = 0
    target, inside = False, []

    def close():
        nonlocal target, inside, negated, reported
        total = sum(w for _, w, _, _ in inside)
        if inside:
            out[8] += 1
            out[9] = max(out[9], total)
        for cls, weight, neg, rep in inside:
            base = 0 if cls == INSULT else 4
            out[base + (1 if neg else 2 if rep else 0)] += weight
            if target:
                out[base + 3] += weight
        target, inside, negated, reported = False, [], 0, 0

    for cls, weight in classes:
        if cls == STOP:
            close()
            continue
        if cls in (INSULT, THREAT):
            inside.append((cls, weight, negated > 0, reported > 0))
        target = target or cls == TARGET
        negated = REACH if cls == NEGATION else max(0, negated - 1)
        reported = REACH if cls == REPORT else max(0, reported - 1)
    close()
    out[:8] = np.log1p(out[:8])
    out[8] = math.log1p(out[8])
    out[10] = 1.0
    return out


def text_features(grammar: Grammar, text: str | None, memo: dict) -> np.ndarray:
    classes, hit = [], False
    for token in TOKEN.findall((text or "").lower()):
        found = memo.get(token)
        if found is None:
            found = grammar.classify(token)
            if len(memo) > 500_000:
                memo.clear()
            memo[token] = found
        classes.append(found)
        hit = hit or found[0] in (INSULT, THREAT)
    return clause_features(classes if hit else [])


def lexicon(labelled: DataFrame, evidence: float = 12.0, most: int = 5000) -> tuple[dict, dict]:
    """Insult words and prefixes from all rows of `labelled` (text, toxic).

    Every row counts; only rows with the same set of word triples, which are copies, count once. A
    feature enters if its toxic count times its log odds reaches `evidence`; at most
    `most` features, the strongest, make the model.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    triples = let(words, lambda w: F.struct(F.array_distinct(w).alias("words"), F.array_sort(F.array_distinct(F.transform(
        w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))).alias("triples")))
    rows = (labelled.select(F.col("toxic").cast("int").alias("toxic"), triples.alias("t")).filter("toxic in (0, 1)")
            .select("toxic", "t.words", F.xxhash64("t.triples").alias("d1"), F.xxhash64(F.lit(1), "t.triples").alias("d2")))
    rows = rows.groupBy("d1", "d2", "toxic").agg(F.first("words").alias("words"))
    rows = write_table(rows.select("toxic", "words"), "labelled_words")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, fine = totals.get(1, 0), totals.get(0, 0)
    features = F.array_distinct(F.concat("words", *[
        F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in PREFIXES]))
    counts = (rows.select("toxic", F.explode(features).alias("feature")).groupBy("feature")
              .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    odds = F.log((F.col("pos") + 0.5) / (bad + 1)) - F.log((F.col("neg") + 0.5) / (fine + 1))
    strong = (counts.withColumn("odds", odds).withColumn("strength", F.col("pos") * F.col("odds"))
              .filter((F.col("odds") > 2) & (F.col("strength") >= evidence)).orderBy(F.desc("strength"), "feature").limit(most).collect())
    words_, prefixes = {}, {}
    for r in strong:
        (prefixes if r["feature"][0] == "^" else words_)[r["feature"].lstrip("^")] = float(r["odds"])
    return words_, prefixes


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_grammar(routes: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 20_000) -> Grammar:
    """A grammar from `routes` (route_id, text) and `labels` (route_id, toxic), held-out ids left aside.

    The lexicon counts all labelled rows; the eleven weights of the clause features are
    fitted on at most `sample` of them, chosen by a hash of the id. Null or contradictory
    labels are dropped (contradictory ones keep the larger label); without any labelled
    row every score is one half.
    """
    marks = (labels.select(F.col("route_id").alias("_id"), "toxic").filter("toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
             .filter(~held_out(F.col("_id"), folds)))
    if rows_in(marks) <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    labelled = routes.select("route_id", "text").join(marks, F.col("route_id") == F.col("_id")).select("route_id", "text", "toxic")
    words, prefixes = lexicon(labelled)
    start = Grammar(words, prefixes, (0.0,) * N_FEATURES)
    n = labelled.count()
    if not n:
        return start
    part = 1 << 20
    chosen = labelled.filter(F.pmod(F.xxhash64("route_id", F.lit(11)), F.lit(part)) < math.ceil(part * min(1.0, 0.9 * sample / n)))
    rows = chosen.mapInPandas(_feature_rows(start), "features array<double>, toxic int").limit(sample).collect()
    if not rows:
        return start
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    return Grammar(words, prefixes, tuple(_fit(x, y).tolist()))


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            yield pd.DataFrame({"features": [text_features(grammar, t, memo).tolist() for t in batch["text"]], "toxic": batch["toxic"].astype("int32")})
    return run


def score_texts(routes: DataFrame, grammar: Grammar) -> DataFrame:
    """`routes` (route_id, text and any others) as they are with `score` and `predicted`.

    A text is cut into words and stops; the lexicon gives each word its class, the clause
    transducers turn classes into weights per channel (plain, negated, reported, aimed at
    someone) and a logistic sum of those is the score from 0 to 1, the same for equal
    texts. predicted is 1 from one half on. Null and empty texts have no clause and get
    the base score. Columns of these two names are replaced; no row is dropped.
    """
    weights = np.array(grammar.coefficients)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for part in texts:
            x = np.array([text_features(grammar, t, memo) for t in part]).reshape(-1, N_FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    scored = routes.withColumn("score", score("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
