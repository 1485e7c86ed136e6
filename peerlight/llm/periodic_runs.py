"""Runs of periodically repeated words, found as maximal pairs in the LCP-interval tree.

A run with period q that starts at word s and ends before word e is the same thing as a pair of
places (s, s + q): the words from both on agree for exactly e - q - s words (right-maximal), the
words to their left differ (left-maximal). All places whose next k words agree are one interval
of the suffix order; the intervals form a tree. Going through it from the bottom, every interval
holds its places in text order, each with the class of the word to its left, and when two
intervals become one, places that are neighbours in different classes give a maximal pair. No
pair is ever extended. Only neighbours matter: between s and s + q lies no other place where
the same words begin, or q would not be the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlight.llm.common import bounded_batches, documents

#: Runs have at least this many words and this many periods.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text handled at a time (one text at least).
PIECE_BYTES = 1 << 20


@dataclass
class Run:
    start: int
    length: int
    period: int


def split_words(text: str | None) -> list[bytes]:
    """Words: runs without blank, tab, line feed, vertical tab, form feed and return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def least_common(least_words: int, least_times: int) -> int:
    """Words that two places of a run must have in common at least, whatever its period."""
    return min(max(least_words - q, (least_times - 1) * q) for q in range(1, least_words + 1))


def repeated_places(
    word: np.ndarray, text: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of texts that share ``least`` words or more with their neighbour in the order.

    ``word`` numbers the words of all texts in a row, ``text`` their texts. Returns places in
    suffix order and, for each, how many words it has in common with the one before (0 if under
    ``least``). Places double the words they are sorted by; those that are alone go at once.
    """
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # where the group of places with equal words starts
    head = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    end = np.r_[np.flatnonzero(np.diff(text)) + 1, n]
    behind = np.repeat(end, np.diff(np.r_[0, end]))  # where the text of a place ends
    levels, step = [rank.copy()], 1
    open_ = _not_alone(order, rank)
    kept = open_  # places that share ``least`` words with another are among these
    while open_.size:
        later = open_ + step
        inside = later < behind[open_]
        second = np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        old = rank[open_]
        opens = np.r_[True, old[1:] != old[:-1]]
        first = np.flatnonzero(opens)
        offset = np.arange(len(open_)) - np.repeat(first, np.diff(np.r_[first, len(open_)]))
        split = opens | np.r_[True, second[1:] != second[:-1]]
        at = np.flatnonzero(split)
        rank[open_] = old + np.repeat(offset[at], np.diff(np.r_[at, len(open_)]))
        levels.append(rank.copy())
        if 2 * step <= least:
            kept = _not_alone(open_, rank)
        open_, step = _not_alone(open_, rank), 2 * step
    # Suffix order of the places kept: final ranks are all different.
    kept = kept[np.argsort(rank[kept], kind="stable")]
    common = np.zeros(len(kept), np.int64)
    left, right = kept[:-1].copy(), kept[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero((left < n) & (right < n))
        same = fits[levels[k][left[fits]] == levels[k][right[fits]]]
        common[same + 1] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    common[common < least] = 0
    return kept, common


def _not_alone(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The places of ``order`` (sorted by rank) that share their rank with a neighbour."""
    if len(order) < 2:
        return order[:0]
    own = rank[order]
    same = own[1:] == own[:-1]
    return order[np.r_[False, same] | np.r_[same, False]]


def maximal_pairs(
    places: list[int], common: list[int], left_class: list[int], least_words: int, least_times: int
) -> list[tuple[int, int, int]]:
    """Pairs (first place, words from it to the end of the run, distance) that are runs.

    ``common`` gives the words a place has in common with the one before in suffix order. The
    list of every interval holds its places in text order; ``left_class`` has the class of each
    place by the word to its left. The smaller list always goes into the larger one.
    """
    found = []

    def join(small: list[int], large: list[int], depth: int) -> list[int]:
        if len(small) > len(large):
            small, large = large, small
        reach = depth // (least_times - 1)
        for x in small:
            own = left_class[x]
            i = bisect_left(large, x)
            if i and x - large[i - 1] <= reach:
                y = large[i - 1]
                if left_class[y] != own and depth + x - y >= least_words:
                    found.append((y, depth + x - y, x - y))
            if i < len(large) and large[i] - x <= reach:
                y = large[i]
                if left_class[y] != own and depth + y - x >= least_words:
                    found.append((x, depth + y - x, y - x))
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
            return large
        large += small
        large.sort()  # two sorted stretches: one merge
        return large

    stack: list[tuple[int, list[int]]] = []
    current: list[int] = []
    for place, depth in zip(places, common):
        while stack and stack[-1][0] >= depth:
            below, before = stack.pop()
            current = join(before, current, below)
        if depth:
            stack.append((depth, current))
        current = [place]
    while stack:
        below, before = stack.pop()
        current = join(before, current, below)
    return found


def find_runs(
    texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES
) -> list[list[Run]]:
    """The runs of every list of words, by start, then period.

    A run is a stretch of ``max(least_words, least_times * q)`` or more words with smallest period
    q that no word beside it continues.
    """
    if least_words < 1 or least_times < 2:
        raise ValueError("a run has one word at least and two periods at least")
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    names: dict[bytes, int] = {}
    word = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    starts = np.r_[0, np.cumsum(sizes)]
    least = max(1, least_common(least_words, least_times))
    places, common = repeated_places(word, text, least)
    # Places that share fewer words with both neighbours stand in no interval.
    held = (common > 0) | np.r_[common[1:] > 0, False]
    places, common = places[held], common[held]
    left = np.full(len(word), -1)
    if len(word):
        left[1:] = np.where(text[1:] == text[:-1], word[:-1], -1)
    classes = dict(zip(places.tolist(), left[places].tolist()))
    pairs = maximal_pairs(places.tolist(), common.tolist(), classes, least_words, least_times)
    # A stretch with a multiple of its period is the same run again.
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in pairs:
        known = smallest.get((start, length))
        if known is None or period < known:
            smallest[start, length] = period
    for (start, length), period in sorted(smallest.items()):
        k = int(text[start])
        out[k].append(Run(start - int(starts[k]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, [r.start + r.period for r in runs], 1)
    np.add.at(edge, [r.start + r.length for r in runs], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods, compared exactly; of equals the first, then the shortest period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def given_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as they stand."""
    return words


def _pieces(rows: pd.DataFrame, prepare: Callable) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for doc_id, text in zip(rows["doc_id"], rows["text"]):
        words = prepare(None if pd.isna(doc_id) else int(doc_id), split_words(text))
        held.append(words)
        size += len(text or "")
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_RUNS = "array<struct<start: long, length: long, period: long>>"


def word_runs(
    doc_id: Column,
    text: Column,
    least_words: int = LEAST_WORDS,
    least_times: int = LEAST_TIMES,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] = given_words,
) -> Column:
    """Struct of a text's runs (by start, then period) and its collapsed words joined by blanks.

    ``prepare`` may change the words by the row's id first; the ids are cast to long. Null and
    empty texts have no words, no runs and collapse to the empty text. Repeated rows are handled
    one by one. Memory goes with the longest text.
    """

    @F.pandas_udf(f"runs {_RUNS}, collapsed string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            runs, left = [], []
            for texts in _pieces(rows, prepare):
                for words, found in zip(texts, find_runs(texts, least_words, least_times)):
                    runs.append([{"start": r.start, "length": r.length, "period": r.period} for r in found])
                    left.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(left, dtype=object)})

    return run(F.struct(doc_id.cast("long").alias("doc_id"), text.alias("text")))


def digests(
    doc_id: Column,
    text: Column,
    least_words: int = LEAST_WORDS,
    least_times: int = LEAST_TIMES,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] = given_words,
) -> Column:
    """Struct of n_runs, the strongest run's start, length, period and exponent_milli (null
    without a run), runs_sha256 and collapsed_sha256 of the same runs as ``word_runs``."""
    fields = ("start", "length", "period", "exponent_milli")

    @F.pandas_udf(
        "n_runs long, " + ", ".join(f"{f} long" for f in fields) + ", runs_sha256 string, collapsed_sha256 string"
    )
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for texts in _pieces(rows, prepare):
                for words, found in zip(texts, find_runs(texts, least_words, least_times)):
                    best = strongest(found)
                    one = (None,) * 4
                    if best:
                        one = (best.start, best.length, best.period, 1000 * best.length // best.period)
                    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
                    kept = b" ".join(collapsed(words, found))
                    digest = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), kept)]
                    out.append((len(found), *one, *digest))
            table = pd.DataFrame(out, columns=["n_runs", *fields, "runs_sha256", "collapsed_sha256"])
            yield table.astype({"n_runs": "int64"} | {f: "Int64" for f in fields})

    return run(F.struct(doc_id.cast("long").alias("doc_id"), text.alias("text")))


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In about a tenth of all texts (by crc32 of the id; a missing one is the empty text) the
    words from some place on repeat a first stretch of them."""
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def op13_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bounded_batches(spark)
    found = digests(F.col("doc_id"), F.col("text"), prepare=made_periodic)
    return docs.select("doc_id", found.alias("d")).select("doc_id", "d.*")
