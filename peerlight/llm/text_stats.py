"""Counts over whole texts that the quality operators share, for many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 or c >= 0xC3 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_MARK = np.array([chr(c) in "!?.,;:" for c in range(128)] + [False] * 128)
_LOUD = np.array([chr(c) in "!?" for c in range(128)] + [False] * 128)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_same_next", "n_upper", "n_lower", "n_digits", "n_marks", "n_loud"]
#: Words of a window that counts as repeated.
WINDOW = 5


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][np.r_[0, ends]])


def _repeated(words: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words inside windows of ``WINDOW`` words that occur twice or more in it."""
    if len(words) < WINDOW:
        return np.zeros(n, dtype=np.int64)
    count = len(words) - WINDOW + 1
    key = text[:count].astype(np.uint64)
    for i in range(WINDOW):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        key += words[i : i + count].astype(np.uint64) + np.uint64(1)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(text[:count] == text[WINDOW - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(words) + 1, dtype=np.int64)
    again = np.unique(np.r_[order[1:][same], order[:-1][same]])
    np.add.at(twice, again, 1)
    np.add.at(twice, again + WINDOW, -1)
    covered = np.cumsum(twice[:-1]) > 0
    return np.bincount(text[covered], minlength=n)


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts named in ``COUNTS`` and ``MORE``, one long per text; null is empty.

    Words are runs without blank, tab, line feed, vertical tab, form feed and return. A line
    (between line feeds) with a word that equals an earlier line of its text is a duplicate.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raw)
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    lists = [x.split() for x in raw]
    n_words = np.array([len(x) for x in lists], dtype=np.int64)
    names: dict[bytes, int] = {}
    words = np.fromiter(
        (names.setdefault(w, len(names)) for x in lists for w in x), np.int64, int(n_words.sum())
    )
    text = np.repeat(np.arange(n), n_words)
    pair = np.unique(text * max(1, len(names)) + words)
    dup, n_lines = [], []
    for x in raw:
        lines = [y for y in x.split(b"\n") if y.strip()] if b"\n" in x else []
        n_lines.append(max(1, len(lines)))
        dup.append(len(lines) - len(set(lines)))
    out = {
        "n_words": n_words,
        "word_chars": _per_text(_LEAD[flat] & ~_SPACE[flat], ends),
        "n_symbols": _per_text(_SYMBOL[flat], ends),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": _repeated(words, text, n),
        "n_lines": np.array(n_lines, dtype=np.int64),
        "n_distinct": np.bincount(pair // max(1, len(names)), minlength=n),
        "n_same_next": np.bincount(
            text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=n
        ),
    }
    for name, table in (
        ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_loud", _LOUD)
    ):
        out[name] = _per_text(table[flat], ends)
    return {k: v.astype(np.int64) for k, v in out.items()}
