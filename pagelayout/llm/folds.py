"""Folds by CRC of the key, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def in_fold(key: Column, n: int, fold: int) -> Column:
    """True where crc32(key as text) mod n is `fold`; a null key is in no fold."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % n == fold, F.lit(False))


def thinned(df: DataFrame, key: str, share: Column) -> DataFrame:
    """The rows whose hashed key falls below `share`: the same rows on every run."""
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_SCALE)) < share * _SCALE)
