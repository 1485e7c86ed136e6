"""Bloom filters of keys, built by merging bits on the cluster, tested before an exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, bits it sets, and the most bits a filter has (16 MB). More keys than that allows
#: only let more rows pass that a join has to drop.
BITS_PER_KEY, PROBES, MOST_BITS = 10, 4, 1 << 27


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of a table of keys as 64-bit words (a power of two of bits, 64 at least).

    Filters of parts merge by OR, so each task sets bits of its own keys and only words cross;
    ``MOST_BITS / 64`` words come to the driver at most. NULL keys are left out.
    """
    keys = keys.filter(F.col(key).isNotNull())
    wanted = max(64, min(MOST_BITS, keys.count() * BITS_PER_KEY))
    bits = 1 << int(wanted - 1).bit_length()
    mask = F.lit(bits - 1).cast("long")
    first, second = (h.bitwiseAND(mask) for h in _hashes(F.col(key)))
    places = F.transform(
        F.sequence(F.lit(0), F.lit(PROBES - 1)),
        lambda i: (first + i.cast("long") * second).bitwiseAND(mask),
    )
    words = (
        keys.select(F.explode(places).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(df: DataFrame, key: str, words: np.ndarray) -> Column:
    """Whether a key may be in the filter: true for all keys in it and for few others."""
    sent = df.sparkSession.sparkContext.broadcast(words)
    probes = PROBES

    @F.pandas_udf("boolean")
    def test(first: pd.Series, second: pd.Series) -> pd.Series:
        known = sent.value
        bits = np.int64(len(known) * 64)
        a, b = first.to_numpy(np.int64), second.to_numpy(np.int64)
        found = np.ones(len(a), dtype=bool)
        with np.errstate(over="ignore"):
            for i in range(probes):
                at = (a + np.int64(i) * b) & (bits - 1)
                found &= (known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(found)

    return F.col(key).isNotNull() & test(*_hashes(F.col(key)))
