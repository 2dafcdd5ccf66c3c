"""Normalising the keys (symbols, indicator names) of the store."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from snapfolio.catalog import data_types_where

# Every character that counts as white space for ``str.strip``.
_SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))


def strip_key(key: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(key, F.lit(_SPACES))


def normalize_key(key: Column, data_type: Column) -> Column:
    """Trim and fold a key: lower case for indicator names, upper case for symbols.

    Keys that are empty after trimming become NULL, so that callers can reject them.
    """
    stripped = strip_key(key)
    lower_types = data_types_where(lambda s: s.key_case == "lower")
    folded = F.when(data_type.isin(lower_types), F.lower(stripped)).otherwise(F.upper(stripped))
    return F.when(folded != "", folded)
