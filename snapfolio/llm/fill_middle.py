"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and written with the middle last.

Texts are cut between units, ``[A-Za-z]+|[^A-Za-z]``, so no word of ASCII letters is torn. Every batch goes
through one chain of array steps: units as lists, flattened with the number of the text they are of, their
ordinals within it, one filter per role, lists of what is left, joined to the pieces.

What becomes of a text depends on its id, the seed and the text alone, so a repeated task writes the same.
The forms are ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and ``plain``, the text as it is.
A text that holds one of the marks stays plain, so the marks of the others can be told from their words and
``restored`` gives back every text exactly.

A null text counts as an empty one, and empty texts stay plain. A row without id draws with an empty id.
Repeated rows are cut alike. However long a text is, it is cut as a whole; texts of ``BATCH_BYTES`` together
or one longer text are in memory at once, with about 30 bytes for each of their units. An empty table gives no rows.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 1
#: Of a hundred texts, how many stay plain by their draw, and how many of the others are spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
BATCH_BYTES = 4 << 20

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
     ("middle_chars", pa.int64()), ("output", pa.string())]
)
DDL = "doc_id BIGINT, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output STRING"


def units(texts: pa.Array) -> pa.LargeListArray:
    """The units of every text as a list; the bytes are those of the texts, not copied."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = (data or pa.py_buffer(b"")).slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    raw = np.frombuffer(data, dtype=np.uint8)
    letter = ((raw | 32) >= ord("a")) & ((raw | 32) <= ord("z"))
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[bounds[:-1][bounds[:-1] < len(raw)]] = True
    at = np.flatnonzero(begins)
    strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), data)
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int64()), strings)


def _joined(flat: pa.Array, role: pa.Array, counts: np.ndarray) -> pa.Array:
    """The units of one role, ``counts`` of them per text, as one string per text."""
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), pc.filter(flat, role)), "")


def pieces(lists: pa.LargeListArray, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The units before ``low``, from there to ``high``, and after it, of every text."""
    offsets = np.asarray(lists.offsets)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat)) + offsets[0]), pc.take(pa.array(offsets[:-1]), parent))
    before = pc.less(ordinal, pc.take(pa.array(low), parent))
    after = pc.greater_equal(ordinal, pc.take(pa.array(high), parent))
    between = pc.invert(pc.or_(before, after))
    return (
        _joined(flat, before, low),
        _joined(flat, between, high - low),
        _joined(flat, after, np.diff(offsets) - high),
    )


def _rewritten(batch: pa.RecordBatch, plain_percent: int, spm_percent: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("t"), "")
    h1, h2, h3, h4 = (np.asarray(batch.column(f"h{i}")) for i in (1, 2, 3, 4))
    lists = units(texts)
    n = np.diff(np.asarray(lists.offsets))
    cuts = np.stack([h1 % (n + 1), h2 % (n + 1)])
    marked = pc.or_(
        pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)),
        pc.match_substring(texts, MIDDLE),
    )
    plain = pc.or_(marked, pa.array((n == 0) | (h3 % 100 >= 100 - plain_percent)))
    spm = pa.array(h4 % 100 < spm_percent)
    prefix, middle, suffix = pieces(lists, cuts.min(axis=0), cuts.max(axis=0))
    p, s, m, none = (pa.scalar(x) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    output = pc.if_else(
        spm,
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
    )
    missing = pa.scalar(None, pa.int64())
    columns = [
        batch.column("i"),
        pa.array(n),
        pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
        pc.if_else(plain, missing, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, missing, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(plain, texts, output),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits: the first digits of the SHA-256 of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [
        F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)
    ]


def transformed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``doc_id, n`` (units), ``form, prefix_chars, middle_chars`` (NULL if plain) and ``output`` of every row."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", BATCH_BYTES):
                yield _rewritten(batch, plain_percent, spm_percent)

    rows = docs.select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), *draws(F.col(id_col), seed)
    )
    return rows.mapInArrow(rewrite, DDL)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No mark is within a piece or across its ends, so the
    three marks cut an output into exactly three pieces."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
    )
