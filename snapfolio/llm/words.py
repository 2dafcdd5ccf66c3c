"""Words of texts as arrays, for functions that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """The words of a batch of texts.

    ``codes`` has a number per word, all texts after another; ``starts[i]:starts[i + 1]``
    are those of text i. ``distinct`` has the word of each number.
    """

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.Array

    def hashes(self) -> np.ndarray:
        """64 bits per distinct word, alike in every process."""
        if not len(self.distinct):
            return np.zeros(0, dtype=np.uint64)
        return pd.util.hash_array(
            self.distinct.to_numpy(zero_copy_only=False), categorize=False
        )


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    # Leading and trailing blanks give empty strings.
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    return Words(
        np.asarray(encoded.indices, dtype=np.int64),
        before[bounds - bounds[0]],
        encoded.dictionary,
    )


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit hashes; the order counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``most_bytes`` together, or of one row."""
    length = pc.binary_length(pc.fill_null(batch.column(column), ""))
    ends = np.cumsum(np.asarray(length, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
