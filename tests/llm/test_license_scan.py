"""Token automata of license notices against a regular expression per template."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from calorway.llm.license_scan import BASE_PHRASES, NOTICES, compile_templates, license_notices, mandatory_words, words_in
from calorway.llm.queries import notice_pattern

FEED = "dataset_id long, attribution string"


def _plain(markup: str) -> str:
    """The template's own wording, marks left out."""
    return re.sub(r"<[^>]*>", " ", markup)


def _expected(text: str):
    line = "".join(w.decode("utf-8", "surrogatepass") + " " for w in words_in(text or ""))
    found = {label for label, markup in [*NOTICES, *BASE_PHRASES] if re.search(r"(?:^| )" + notice_pattern(markup), line)}
    return sorted(found)


def test_labels_equal_regular_expressions(spark):
    rng = random.Random(5)
    texts = [None, "", "   ", "no notice here", "MIT  License", "mit licenses", "the MIT-License. The mit license!"]
    for _, markup in NOTICES:
        words = _plain(markup).split()
        texts.append("Before, " + " ".join(words) + ". After")
        for _ in range(6):
            changed = list(words)
            at = rng.randrange(len(changed))
            how = rng.choice(("drop", "swap", "add"))
            if how == "drop":
                del changed[at]
            else:
                changed[at:at + (how == "swap")] = ["other"]
            texts.append(" ".join(changed))
    rows = list(enumerate(texts))
    got = {r.dataset_id: r for r in license_notices(spark.createDataFrame(rows, FEED)).collect()}
    for key, text in rows:
        assert got[key].labels == _expected(text), text
        assert got[key].n_words == len(words_in(text or ""))
    assert len({tuple(r.labels) for r in got.values()}) > 8


def test_optional_and_replaceable_regions(spark):
    markup = [("x", 'alpha <optional>beta <optional>gamma</optional></optional> <alt match="one|two three">one</alt> <alt words="1-2">who</alt> omega')]
    cases = {"alpha one a omega": True, "alpha beta one a b omega": True, "alpha beta gamma two three a omega": True,
             "alpha gamma one a omega": False, "alpha one omega": False, "alpha one a b c omega": False,
             "alpha two a omega": False, "alpha one omega omega": True}
    rows = list(enumerate(cases))
    got = {r.dataset_id: r for r in license_notices(spark.createDataFrame(rows, FEED), markup, []).collect()}
    assert [bool(got[k].labels) for k, _ in rows] == list(cases.values())
    assert mandatory_words(markup[0][1]) == 4 and got[0].score == pytest.approx(4 / 6)


def test_runs_of_any_length(spark):
    """A run over more than 2^18 words, and places behind it."""
    long = "so " * 300_000 + "Released under the MIT License. " + "so " * 10 + "mit license"
    row = license_notices(spark.createDataFrame([(1, long)], FEED)).first()
    assert row.n_words == 300_000 + 5 + 10 + 2
    assert [(n.label, n.base, n.first_word, n.end_word) for n in row.notices] == [
        ("mit", False, 300_000, 300_005), ("mit", True, 300_003, 300_005), ("mit", True, 300_015, 300_017)]


def test_broken_markup():
    for bad in ("a <optional> b", "a </optional>", "a <alt words=\"0-2\">b", "<optional>a</optional>", "", "a </alt>"):
        with pytest.raises(ValueError):
            compile_templates([bad])


def test_rows_of_any_kind(spark):
    """Null and repeated ids, repeated rows, an empty table, and columns that carry the result's names."""
    feeds = spark.createDataFrame([(None, "mit license"), (1, None), (1, "apache license"), (1, "apache license")], FEED)
    feeds = feeds.withColumns({"n_words": F.lit("x"), "notices": F.lit(1), "score": F.lit(2), "labels": F.lit("q")})
    rows = sorted(license_notices(feeds).collect(), key=str)
    assert [(r.dataset_id, r.n_words, r.labels, r.score) for r in rows] == [
        (1, 0, [], 0.0), (1, 2, ["apache"], 0.5), (1, 2, ["apache"], 0.5), (None, 2, ["mit"], 0.5)]
    assert license_notices(feeds.limit(0)).count() == 0
