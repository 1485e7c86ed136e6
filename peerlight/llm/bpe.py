"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import Shipped, bounded_batches, documents

#: Fixed values of the byte-level format: how text splits into words, and the printable
#: characters that stand for themselves in the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Words whose tokens a task remembers before it starts anew; texts handled at a time.
CACHE_WORDS, TEXTS = 200_000, 128
_NONE = np.iinfo(np.int32).max


@dataclass
class Tokenizer:
    byte_ids: np.ndarray  # token of each byte
    pair_keys: np.ndarray  # sorted: left token << 32 | right token
    pair_ranks: np.ndarray  # rank of each pair
    merged: np.ndarray  # token that a rank makes
    token_bytes: bytes  # bytes of all tokens, one after the other
    token_ends: np.ndarray
    specials: dict[str, int]


def load(path: str) -> Tokenizer:
    """Read a tokenizer file (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    others = [c for c in range(256) if c not in _PRINTED]
    byte_of = {chr(c): c for c in _PRINTED} | {chr(256 + i): c for i, c in enumerate(others)}
    vocab: dict[str, int] = told["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    count = max([*vocab.values(), *specials.values()]) + 1
    pieces = [b""] * count
    for token, i in vocab.items():
        if token not in specials:
            pieces[i] = bytes(byte_of[c] for c in token)
    for token, i in specials.items():
        pieces[i] = token.encode()
    byte_ids = np.zeros(256, dtype=np.int64)
    for char, c in byte_of.items():
        byte_ids[c] = vocab[char]
    merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
    keys = (left << 32) | right
    order = np.argsort(keys)
    return Tokenizer(
        byte_ids,
        keys[order],
        order.astype(np.int32),
        np.array([vocab[a + b] for a, b in merges], dtype=np.int64),
        b"".join(pieces),
        np.cumsum([len(p) for p in pieces]),
        specials,
    )


def _ranks(tok: Tokenizer, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = (left << 32) | right
    at = np.minimum(np.searchsorted(tok.pair_keys, key), len(tok.pair_keys) - 1)
    return np.where(tok.pair_keys[at] == key, tok.pair_ranks[at], _NONE)


def merge_rounds(tok: Tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, one after the other, and how many each word has.

    Each round looks at all words still open: the lowest-ranked pair of a word is merged
    wherever it occurs in it, from the left. Ranks are looked up again next to merges only.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    symbols = tok.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    rank = np.full(len(symbols), _NONE, dtype=np.int32)
    pair = np.flatnonzero(word[:-1] == word[1:])
    if len(tok.pair_keys):
        rank[pair] = _ranks(tok, symbols[pair], symbols[pair + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        length = np.diff(np.r_[first, len(word)])
        limit = np.repeat(lowest, length)
        closed = limit == _NONE
        if closed.any():
            done.append((word[closed], symbols[closed]))
            symbols, word, rank, limit = (x[~closed] for x in (symbols, word, rank, limit))
            if not len(symbols):
                break
        hit = rank == limit
        # In a run of one symbol its pair overlaps itself: take every second place.
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        overlaps = symbols[at] == symbols[at + 1]
        at = at[~overlaps | (place % 2 == 0)]
        symbols[at] = tok.merged[rank[at]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        fresh = np.zeros(len(symbols), dtype=bool)
        fresh[at] = True
        symbols, word, rank, fresh = symbols[keep], word[keep], rank[keep], fresh[keep]
        fresh[:-1] |= fresh[1:]
        fresh = np.flatnonzero(fresh)
        inner = fresh[fresh < len(symbols) - 1]
        inner = inner[word[inner] == word[inner + 1]]
        rank[fresh] = _NONE
        rank[inner] = _ranks(tok, symbols[inner], symbols[inner + 1])
    if not done:
        return np.zeros(0, dtype=np.int64), sizes
    owner = np.concatenate([w for w, _ in done])
    order = np.argsort(owner, kind="stable")
    tokens = np.concatenate([s for _, s in done])[order]
    return tokens, np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes texts, remembering the tokens of words it has seen."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.find = regex.compile(PATTERN).findall
        split = "|".join(map(regex.escape, sorted(tok.specials, key=len, reverse=True)))
        self.special = regex.compile(f"({split})") if split else None
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = {}
        self.tokens = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)  # end of each word's tokens, from index one
        for text, i in self.tok.specials.items():
            self._add([], [np.array([i], dtype=np.int32)], [1])
            self.names[text] = len(self.ends) - 2

    def _add(self, words: list[str], tokens: list[np.ndarray], counts) -> None:
        self.tokens = np.concatenate([self.tokens, *tokens])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _words(self, text: str) -> list[str]:
        if self.special is None or "<" not in text and not self.special.search(text):
            return self.find(text)
        out: list[str] = []
        for i, piece in enumerate(self.special.split(text)):
            out.extend([piece] if i % 2 else self.find(piece))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after the other, and how many each has; null is empty."""
        if len(self.names) > CACHE_WORDS:
            self._forget()
        names = self.names
        lists = [self._words(t) if t else [] for t in texts]
        known = len(names)
        index = np.fromiter(
            (names.setdefault(w, len(names)) for words in lists for w in words),
            np.int64,
            sum(map(len, lists)),
        )
        if len(names) > known:
            new = list(names)[known:] if known * 4 < len(names) else _tail(names, known)
            tokens, counts = merge_rounds(self.tok, [w.encode() for w in new])
            self._add(new, [tokens.astype(np.int32)], counts)
        begin, size = self.ends[index], self.ends[index + 1] - self.ends[index]
        total = np.cumsum(size)
        at = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        per_text = np.array([len(words) for words in lists], dtype=np.int64)
        upto = np.r_[0, total][np.cumsum(per_text)] if len(texts) else np.zeros(0, dtype=np.int64)
        return self.tokens[at], np.diff(np.r_[0, upto])


def _tail(names: dict[str, int], known: int) -> list[str]:
    """The words added last, newest last."""
    newest = reversed(names)
    return [next(newest) for _ in range(len(names) - known)][::-1]


def decode_tokens(tok: Tokenizer, tokens: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of consecutive token runs; bytes that are no UTF-8 become the replacement sign."""
    ends = tok.token_ends[tokens]
    begin = np.where(tokens > 0, tok.token_ends[tokens - 1], 0)
    size = ends - begin
    total = np.cumsum(size)
    at = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    data = np.frombuffer(tok.token_bytes, dtype=np.uint8)[at].tobytes()
    stops = np.r_[0, total][np.cumsum(counts)].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops)]


def encode(docs: DataFrame, tok: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text; a null text counts as empty.

    Texts of special tokens become these tokens. Other columns pass through, a column named
    like ``ids`` is replaced.
    """
    sent = Shipped(docs.sparkSession, tok)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(sent.value)
        for texts in batches:
            parts = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
            for at in range(0, len(texts), TEXTS):
                parts.append(encoder.encode(texts.slice(at, TEXTS).to_pylist()))
            tokens, counts = (np.concatenate(x) for x in zip(*parts))
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))

    return docs.withColumn(ids, run(text))


def decode(rows: DataFrame, tok: Tokenizer, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` (null: empty), special tokens included."""
    sent = Shipped(rows.sparkSession, tok)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts: list[str] = []
            for at in range(0, len(column), TEXTS):
                part = column.slice(at, TEXTS)
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                tokens = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts.extend(decode_tokens(sent.value, tokens, counts.astype(np.int64)))
            yield pa.array(texts, pa.string())

    return rows.withColumn(text, run(ids))


def round_trip(
    docs: DataFrame, tok: Tokenizer, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so ids need not go to Python a second time."""
    sent = Shipped(docs.sparkSession, tok)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(sent.value)
        for texts in batches:
            parts = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
            back: list[str] = []
            for at in range(0, len(texts), TEXTS):
                tokens, counts = encoder.encode(texts.slice(at, TEXTS).to_pylist())
                parts.append((tokens, counts))
                back.extend(decode_tokens(sent.value, tokens.astype(np.int64), counts))
            tokens, counts = (np.concatenate(x) for x in zip(*parts))
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
            yield pa.StructArray.from_arrays([lists, pa.array(back, pa.string())], ["ids", "decoded"])

    kept = [c for c in docs.columns if c not in (ids, decoded)]
    both = docs.withColumn("_both", run(text))
    return both.select(*kept, F.col("_both.ids").alias(ids), F.col("_both.decoded").alias(decoded))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row."""
    tok = load(path or default_path())
    rows = round_trip(docs.select("doc_id", "text"), tok)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir))
