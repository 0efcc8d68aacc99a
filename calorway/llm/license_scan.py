"""License notices in the attribution texts of feeds, found by token automata compiled from template markup.

A template is the wording of a notice with marked regions:

    <optional>…</optional>              may be left out as a whole; regions nest
    <alt match="a|b c">original</alt>   one of the listed wordings
    <alt words="0-12">original</alt>    any run of so many words

All other words are mandatory. `compile_templates` turns each template into a nondeterministic automaton over words;
`license_notices` runs it from every word that can begin a notice and keeps the longest accepted run. The automaton is
made deterministic as it runs: a set of states and a word give the next set once.

Words are maximal runs of [0-9a-z] and characters beyond ASCII after A-Z is lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<optional>|</optional>|<alt (match|words)=\"([^\"]*)\">|</alt>")
_ANY = b""

# fixed values: phrases that name a license, and the label each gives
BASE_PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# fixed values: public license notices (SPDX identifiers in small letters), with their optional and replaceable regions
NOTICES = [
    ("apache-2.0", 'licensed under the <optional>terms of the</optional> apache license <optional>version</optional> 2 0'),
    ("mit", '<alt match="released|licensed|distributed|available">released</alt> under the <optional>terms of the</optional> mit license'),
    ("gpl-2.0", '<alt match="licensed|released|distributed|modify it">licensed</alt> under the <optional>terms of the</optional> '
                'gnu general public license <optional>as published by the free software foundation</optional> '
                '<optional>either</optional> version 2'),
    ("gpl-3.0", '<alt match="licensed|released|distributed|modify it">licensed</alt> under the <optional>terms of the</optional> '
                'gnu general public license <optional>as published by the free software foundation</optional> '
                '<optional>either</optional> version 3'),
    ("cc-by-4.0", 'licensed under <optional><alt match="a|the">a</alt></optional> <alt match="cc|creative commons">cc</alt> '
                  '<alt match="by|attribution">by</alt> 4 0'),
    ("cc-by-nc-4.0", 'licensed under <optional><alt match="a|the">a</alt></optional> <alt match="cc|creative commons">cc</alt> '
                     '<alt match="by nc|attribution noncommercial|attribution non commercial">by nc</alt> 4 0'),
    ("cc-by-sa-4.0", 'licensed under <optional><alt match="a|the">a</alt></optional> <alt match="cc|creative commons">cc</alt> '
                     '<alt match="by sa|attribution sharealike|attribution share alike">by sa</alt> 4 0'),
    ("odbl-1.0", '<optional>made</optional> available under the open <alt match="database|data commons open database">database</alt> license'),
    ("mpl-2.0", 'subject to the terms of the mozilla public license <optional>v</optional> <optional>version</optional> 2 0'),
    ("mit", 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation '
            'files <optional>the software</optional> to deal in the software without restriction including without limitation the '
            'rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons '
            'to whom the software is furnished to do so subject to the following conditions the above copyright notice and this '
            'permission notice <optional>including the next paragraph</optional> shall be included in all copies or substantial '
            'portions of <alt words="1-6">the software</alt> the software is provided as is without warranty of any kind express or '
            'implied including but not limited to the warranties of merchantability fitness for a particular purpose and '
            'noninfringement in no event shall <alt words="1-20">the authors or copyright holders</alt> be liable for any claim '
            'damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with '
            'the software or the use or other dealings in the software'),
    ("isc", 'permission to use copy modify and <optional>or</optional> distribute this software for any purpose with or without fee '
            'is hereby granted provided that the above copyright notice and this permission notice appear in all copies '
            'the software is provided as is and <alt words="1-12">the author</alt> disclaims all warranties with regard to this software'),
    ("bsd-2-clause", 'redistribution and use in source and binary forms with or without modification are permitted provided that the '
                     'following conditions are met <optional>1</optional> redistributions of source code must retain the above '
                     'copyright notice this list of conditions and the following disclaimer <optional>2</optional> redistributions '
                     'in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer '
                     'in the documentation and or other materials provided with the distribution'),
    ("bsd-3-clause", 'redistributions in binary form must reproduce the above copyright notice this list of conditions and the '
                     'following disclaimer in the documentation and or other materials provided with the distribution '
                     '<optional>3</optional> neither the name of <alt words="1-20">the copyright holder</alt> nor the names of its '
                     'contributors may be used to endorse or promote products derived from this software without specific prior '
                     'written permission'),
    ("unlicense", 'this is free and unencumbered software released into the public domain <optional>anyone is free to copy modify '
                  'publish use compile sell or distribute this software either in source code form or as a compiled binary for any '
                  'purpose commercial or non commercial and by any means</optional>'),
]


class Automaton(NamedTuple):
    """States with word arcs and empty arcs; `ends` names the template that a state accepts."""

    steps: list[list[tuple[bytes, int]]]
    jumps: list[list[int]]
    starts: list[int]
    ends: dict[int, int]


def words_in(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def mandatory_words(markup: str) -> int:
    """Words that every accepted text has: none of optional regions, the fewest of replaceable ones."""
    total, depth, at, inside = 0, 0, 0, None
    for mark in [*_MARK.finditer(markup), None]:
        plain = len(words_in(markup[at:mark.start() if mark else len(markup)]))
        total += 0 if depth or inside else plain
        if mark is None:
            break
        at, kind = mark.end(), mark.group()
        if kind.startswith("<alt"):
            inside = mark
            if not depth:
                total += (int(mark[2].split("-")[0]) if mark[1] == "words" else min(len(words_in(w)) for w in mark[2].split("|")))
        elif kind == "</alt>":
            inside = None
        else:
            depth += 1 if kind == "<optional>" else -1
    return total


def compile_templates(markups: Sequence[str]) -> Automaton:
    """One automaton for all templates; raises ValueError for broken markup or a template that accepts no word at all."""
    steps: list[list[tuple[bytes, int]]] = []
    jumps: list[list[int]] = []

    def state() -> int:
        steps.append([])
        jumps.append([])
        return len(steps) - 1

    def read(at: int, words: list[bytes]) -> int:
        for word in words:
            after = state()
            steps[at].append((word, after))
            at = after
        return at

    starts, ends = [], {}
    for number, markup in enumerate(markups):
        if mandatory_words(markup) < 1:
            raise ValueError(f"no mandatory word in template {markup!r}")
        here = state()
        starts.append(here)
        opened: list[int] = []
        at, original = 0, None
        for mark in _MARK.finditer(markup):
            if original is None:
                here = read(here, words_in(markup[at:mark.start()]))
            at, kind = mark.end(), mark.group()
            if kind == "<optional>":
                opened.append(here)
            elif kind == "</optional>":
                if not opened:
                    raise ValueError(f"stray </optional> in {markup!r}")
                after = state()
                jumps[here].append(after)
                jumps[opened.pop()].append(after)
                here = after
            elif kind == "</alt>":
                if original is None:
                    raise ValueError(f"stray </alt> in {markup!r}")
                here, original = original, None
            else:
                if original is not None:
                    raise ValueError(f"nested <alt> in {markup!r}")
                original = state()
                if mark[1] == "match":
                    for wording in mark[2].split("|"):
                        jumps[read(here, words_in(wording))].append(original)
                else:
                    low, high = (int(n) for n in mark[2].split("-"))
                    for k in range(high + 1):
                        if k >= low:
                            jumps[here].append(original)
                        if k < high:
                            here = read(here, [_ANY])
        if opened or original is not None:
            raise ValueError(f"region left open in {markup!r}")
        ends[read(here, words_in(markup[at:]))] = number
    return Automaton(steps, jumps, starts, ends)


class _Runner:
    """Walks an automaton; sets of states become numbered states of their own when first met."""

    def __init__(self, machine: Automaton, firsts: list[int]):
        self.machine = machine
        self.sets: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.known: list[dict[bytes, int]] = []
        self.heard: list[frozenset] = []
        self.open: list[bool] = []
        self.accepts: list[tuple[int, ...]] = []
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed(firsts))
        self.begins = self.heard[self.start]

    def _closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for after in self.machine.jumps[todo.pop()]:
                if after not in found:
                    found.add(after)
                    todo.append(after)
        return frozenset(found)

    def _number(self, states: frozenset) -> int:
        if states not in self.sets:
            words = {w for s in states for w, _ in self.machine.steps[s]}
            self.sets[states] = len(self.members)
            self.members.append(states)
            self.known.append({})
            self.heard.append(frozenset(words - {_ANY}))
            self.open.append(_ANY in words)
            self.accepts.append(tuple(sorted({self.machine.ends[s] for s in states if s in self.machine.ends})))
        return self.sets[states]

    def _step(self, at: int, word: bytes) -> int:
        # words that no arc names share one entry
        key = word if word in self.heard[at] else _ANY
        after = self.known[at].get(key)
        if after is None:
            moved = {t for s in self.members[at] for w, t in self.machine.steps[s] if w == _ANY or w == word}
            after = self.known[at][key] = self._number(self._closed(moved))
        return after

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of the longest accepted run from every place."""
        out = []
        begins, start, dead, accepts = self.begins, self.start, self.dead, self.accepts
        for i in [i for i, w in enumerate(words) if w in begins]:
            at, best = start, {}
            for j in range(i, len(words)):
                at = self._step(at, words[j])
                if at == dead:
                    break
                for number in accepts[at]:
                    best[number] = j + 1
            out.extend((number, i, stop) for number, stop in sorted(best.items()))
        return out


SCANNED = "n_words long, notices array<struct<label:string,base:boolean,mandatory:int,first_word:long,end_word:long>>"


def license_notices(feeds: DataFrame, notices: Sequence[tuple[str, str]] = tuple(NOTICES),
                    phrases: Sequence[tuple[str, str]] = tuple(BASE_PHRASES)) -> DataFrame:
    """License notices of every feed's attribution text.

    Parameters
    ----------
    feeds : (dataset_id, attribution); further columns are not read and not returned.
    notices : (label, markup) of the templates.
    phrases : (label, words) of plain phrases that name a license wherever they stand.

    Returns one row per input row: dataset_id, n_words, notices (label, base, mandatory, first_word, end_word: the words
    first_word up to but not end_word; of a template the longest run from each place, in order of place), labels (distinct,
    sorted, of phrases and templates), base_labels (of phrases alone) and score: m / (m + 2) for the most mandatory words m
    of anything found, 0 without a notice, so a long wording that matches exactly weighs more than a short phrase.

    A null or empty attribution has no words, no notices and score 0; rows with the same or no dataset_id stay rows of
    their own; an empty table gives an empty table; equal templates under one label give a notice each and one label. Texts
    are read whole; a run ends where its automaton has no way on, so the work follows the words of the text.
    """
    entries = [(label, False, markup) for label, markup in notices] + [(label, True, markup) for label, markup in phrases]
    machine = compile_templates([markup for _, _, markup in entries])
    facts = [(label, base, mandatory_words(markup)) for label, base, markup in entries]
    runners: list[_Runner] = []

    @F.pandas_udf(SCANNED)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not runners:
            runners.append(_Runner(machine, machine.starts))
        counts, found = [], []
        for text in texts:
            words = words_in(text) if text else []
            counts.append(len(words))
            found.append([{"label": facts[n][0], "base": facts[n][1], "mandatory": facts[n][2], "first_word": i, "end_word": j}
                          for n, i, j in runners[0].runs(words)])
        return pd.DataFrame({"n_words": pd.Series(counts, dtype="int64"), "notices": pd.Series(found, dtype=object)})

    scanned = feeds.select("dataset_id", scan("attribution").alias("_scan")).select("dataset_id", "_scan.*")
    labels = F.array_sort(F.array_distinct(F.col("notices.label")))
    named = F.array_sort(F.array_distinct(F.filter("notices", lambda n: n["base"])["label"]))
    most = F.coalesce(F.array_max("notices.mandatory"), F.lit(0))
    return scanned.select("dataset_id", "n_words", "notices", labels.alias("labels"), named.alias("base_labels"),
                          (most / (most + 2)).alias("score"))
