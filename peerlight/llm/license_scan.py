"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlight.llm.common import bounded_batches, documents
from peerlight.llm.license_rules import BASE, RULES
from peerlight.llm.word_arrays import folded

#: How sure a detection of each priority is, from hints to tags; base phrases count as names.
SURE = {5: 0.99, 4: 0.95, 3: 0.9, 2: 0.75, 1: 0.4}
_NAME = 2


@dataclass(frozen=True)
class Detection:
    start: int  # first word, from 0
    end: int  # behind the last word
    rule: int  # place in RULES

    @property
    def label(self) -> str:
        return RULES[self.rule].label

    @property
    def priority(self) -> int:
        return RULES[self.rule].priority


@cache
def _prefilter() -> ahocorasick.Automaton:
    """Finds the keywords of all rules and the base phrases in one pass: keyword -> itself."""
    automaton = ahocorasick.Automaton()
    for keyword in {r.keyword for r in RULES} | {phrase for phrase, _ in BASE}:
        automaton.add_word(f" {keyword} ", keyword)
    automaton.make_automaton()
    return automaton


@cache
def _rules_of(keyword: str) -> list[int]:
    return [i for i, r in enumerate(RULES) if r.keyword == keyword]


@cache
def _compiled(rule: int) -> re.Pattern:
    return re.compile(f"(?<= )(?:{RULES[rule].regex})(?= )")


def word_line(text: str | None) -> tuple[str, int]:
    """The words of a text with a blank around each, and their number."""
    words = folded(text).split()
    line = b" ".join([b"", *words, b""]) if words else b""
    return line.decode("utf-8", "surrogatepass"), len(words)


def keywords(line: str) -> set[str]:
    """Keywords and base phrases that a line of words holds."""
    return {found for _, found in _prefilter().iter(line)}


def detections(line: str, held: set[str], first: list[int]) -> list[Detection]:
    """Matches of the rules whose keyword is held, in order of rules and places.

    ``first`` has the place in ``line`` where each word starts.
    """
    found = []
    for rule in sorted(i for k in held for i in _rules_of(k)):
        for m in _compiled(rule).finditer(line):
            start = bisect_right(first, m.start()) - 1
            found.append(Detection(start, bisect_right(first, m.end() - 1), rule))
    return found


def resolved(found: list[Detection]) -> list[Detection]:
    """Detections that stay, by place: of two where one's words contain the other's, the one of
    higher priority stays, else the longer one, else that of the earlier rule.

    Taken from the strongest on, each stays unless one that stays is nested with it. Detections
    that merely overlap both stay.
    """
    by_place = sorted(found, key=lambda d: (d.start, d.end))
    kept: list[Detection] = []
    at = 0
    while at < len(by_place):
        # A cluster: detections connected by overlaps; nested ones are always in one.
        reach, to = by_place[at].end, at + 1
        while to < len(by_place) and by_place[to].start < reach:
            reach = max(reach, by_place[to].end)
            to += 1
        stay: list[Detection] = []
        for d in sorted(by_place[at:to], key=lambda d: (-d.priority, d.start - d.end, d.start, d.rule)):
            if not any(
                (k.start <= d.start and d.end <= k.end) or (d.start <= k.start and k.end <= d.end)
                for k in stay
            ):
                stay.append(d)
        kept += sorted(stay, key=lambda d: (d.start, d.end, d.rule))
        at = to
    return kept


def base_places(line: str, held: set[str], first: list[int]) -> list[tuple[int, str]]:
    """Start word and label of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        if phrase in held:
            at = line.find(f" {phrase} ")
            while at >= 0:
                out.append((bisect_right(first, at + 1) - 1, label))
                at = line.find(f" {phrase} ", at + 1)
    return out


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words, base places and resolved detections of a whole text."""
    line, n_words = word_line(text)
    held = keywords(line)
    if not held:
        return n_words, [], []
    first = [m.start() + 1 for m in re.finditer(" ", line[:-1])]
    return n_words, base_places(line, held, first), resolved(detections(line, held, first))


def certainty(base: list[tuple[int, str]], found: list[Detection]) -> float:
    """Chance that one label at least is right, if labels erred on their own; 0 without any."""
    sure = {label: SURE[_NAME] for _, label in base}
    for d in found:
        sure[d.label] = max(sure.get(d.label, 0.0), SURE[d.priority])
    wrong = 1.0
    for label in sorted(sure):
        wrong *= 1.0 - sure[label]
    return 1.0 - wrong if sure else 0.0


def license_spans(text: Column) -> Column:
    """The resolved detections of a text: label, priority, start and end word, matched words.

    Null and texts without a signature give an empty list.
    """

    @F.pandas_udf("array<struct<label: string, priority: int, start: long, end: long, words: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                found = scan(t)[2]
                words = folded(t).decode("utf-8", "surrogatepass").split() if found else []
                out.append(
                    [
                        {
                            "label": d.label, "priority": d.priority, "start": d.start, "end": d.end,
                            "words": " ".join(words[d.start : d.end]),
                        }
                        for d in found
                    ]
                )
            yield pd.Series(out, dtype=object)

    return run(text)


def license_summary(text: Column) -> Column:
    """Struct of n_words, n_base, first_word, last_word, base_labels, labels and score of a text.

    Labels are distinct, sorted and joined by commas (none: empty); base labels are always among
    ``labels``, however overlaps resolve. Null texts count as empty: no words, score 0.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                n_words, base, found = scan(t)
                starts = [s for s, _ in base]
                own = sorted({label for _, label in base})
                every = sorted({*own, *(d.label for d in found)})
                rows.append(
                    (
                        n_words, len(base), min(starts, default=None), max(starts, default=None),
                        ",".join(own), ",".join(every), certainty(base, found),
                    )
                )
            table = pd.DataFrame(rows, columns=names)
            yield table.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    return run(text)


def op12_license_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bounded_batches(spark)
    return docs.select("doc_id", license_summary(F.col("text")).alias("s")).select("doc_id", "s.*")
