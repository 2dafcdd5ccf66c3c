"""Benchmark decontamination by the q-gram lemma.

Texts are put in lower case and their white space is merged. Benchmark items are cut into segments of
``SEGMENT`` characters, one every ``STRIDE``, the last at the item's end. A document holds a
segment if some region of it is at most so many edits away from it as ``budget`` allows (6 of 64). So an excerpt of
60 characters is found wherever in the item it begins: what it lacks of the nearest segment are edits.

A region within k edits of a segment of m characters shares m - q + 1 - kq of its q-grams with it,
on diagonals that differ by k at most. Every shared q-gram falls into two overlapping bands of 2k
diagonals; bands with enough q-grams are verified by an alignment confined to the band.

Items go to the tasks in blocks of ``BLOCK_CHARS`` characters, however many there are; documents are
read once for every block and never shuffled.

Items of less than ``EXACT`` characters are looked for without edits, as whole words. Null and empty texts hold
nothing. Items that are null or, normalised, shorter than ``SHORTEST`` characters, two or three words, are not looked for: they
turn up in any prose. An empty benchmark is held by no document. Very long texts are looked at whole. Items repeated under one id count once, under
several ids once each. Rows repeated or without id are judged like any other. Other columns are
passed through by ``clean`` and not looked at by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Q = 8
#: As many as a number has bits, which the alignment relies on.
SEGMENT = 64
STRIDE = SEGMENT // 8
EXACT = 24
SHORTEST = 16
#: An index has some 60 bytes per character.
BLOCK_CHARS = 1 << 20
#: Characters of documents that are looked at together.
BATCH_CHARS = 1 << 20
#: Bits of a q-gram's hash that are looked up first.
TABLE_BITS = 22
#: Regions that are aligned together.
ALIGNED = 4096

HITS = (
    "array<struct<item_id: bigint, item_start: int, start: bigint, stop: bigint, edits: int>>"
)

_FACTOR = 0x9E3779B97F4A7C15


def normalised(text: str | None) -> str:
    return " ".join((text or "").replace("\x00", " ").lower().split())


def budget(m: int) -> int:
    """Edits allowed in a segment of m characters: about a tenth, and so few that an eighth of
    its q-grams must be left whole; none in short ones."""
    return 0 if m < EXACT else max(0, min(m // 10, (m - Q + 1 - m // 8) // Q))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that starts at each place."""
    h = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    step, factor = 1, _FACTOR
    while step < Q:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % (1 << 64)
    return h * np.uint64(_FACTOR | 1)


@dataclass
class Index:
    """The segments of some items, and where each q-gram stands in them."""

    items: list
    item_start: np.ndarray
    lengths: np.ndarray
    points: np.ndarray  # segments by characters, padded with 0
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # of each hash's entries
    segment: np.ndarray
    place: np.ndarray
    table: np.ndarray
    budgets: np.ndarray
    least: np.ndarray  # q-grams that must be shared


def build_index(items: list[tuple[int | None, str | None]]) -> Index | None:
    cut = []
    for item, text in items:
        t = normalised(text)
        if len(t) < SHORTEST:
            continue
        starts = {*range(0, max(1, len(t) - SEGMENT + 1), STRIDE), max(0, len(t) - SEGMENT)}
        cut += [(item, s, t[s : s + SEGMENT]) for s in sorted(starts)]
    cut = list(dict.fromkeys(cut))
    if not cut:
        return None
    lengths = np.array([len(t) for _, _, t in cut])
    points = np.zeros((len(cut), SEGMENT), dtype=np.uint32)
    hashes, segment, place = [], [], []
    for i, (_, _, t) in enumerate(cut):
        p = _points(t)
        points[i, : len(p)] = p
        h = _gram_hashes(p)
        hashes.append(h)
        segment.append(np.full(len(h), i, dtype=np.int32))
        place.append(np.arange(len(h), dtype=np.int32))
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[grams >> np.uint64(64 - TABLE_BITS)] = True
    budgets = np.array([budget(m) for m in lengths])
    return Index(
        [c[0] for c in cut], np.array([c[1] for c in cut]), lengths, points, grams,
        np.append(first, len(flat)), np.concatenate(segment)[order], np.concatenate(place)[order],
        table, budgets, lengths - Q + 1 - budgets * Q,
    )


def aligned(patterns: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edits from each pattern to any part of its region, and where that part ends.

    A column of the table of edits is kept as bits of one number, its steps up and its steps down (Myers, 1999), since
    a pattern has 64 characters at most.
    """
    n, width = regions.shape
    last = np.uint64(1) << (lengths - 1).astype(np.uint64)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    edits = lengths.astype(np.int32)
    least, end = edits.copy(), np.zeros(n, dtype=np.int64)
    for j in range(width):
        equal = np.packbits(patterns == regions[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
        across = (((equal & up) + up) ^ up) | equal
        rises, falls = down | ~(across | up), up & across
        edits += (rises & last) != 0
        edits -= (falls & last) != 0
        rises, falls, equal = rises << np.uint64(1), falls << np.uint64(1), equal | down
        up, down = falls | ~(equal | rises), rises & equal
        better = edits < least
        least[better], end[better] = edits[better], j + 1
    return least, end


def _whole_words(text: str, start: int, stop: int) -> bool:
    """Whether no word goes on beyond either end."""
    before, after = text[max(start - 1, 0) : start + 1], text[max(stop - 1, 0) : stop + 1]
    return not any(len(ends) == 2 and ends.isalnum() for ends in (before if start else "", after))


def find(texts: list[str], index: Index) -> list[list[tuple]]:
    """The segments that each normalised text holds: item, its place there, start and stop in the text, edits."""
    found: list[list[tuple]] = [[] for _ in texts]
    # Q characters that are in no item keep q-grams within a text.
    points = _points(("\x00" * Q).join([*texts, ""]))
    sizes = np.array([len(t) + Q for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    if len(points) < Q:
        return found
    h = _gram_hashes(points)
    maybe = index.table[h >> np.uint64(64 - TABLE_BITS)]
    # Places in a window of a segment and its edits that has enough of them.
    reach = int((index.lengths + index.budgets).max())
    sums = np.concatenate([[0], np.cumsum(maybe, dtype=np.int32)])
    stop = np.minimum(np.arange(len(h)) + reach, len(h))
    rich = (sums[stop] - sums[:-1]) >= index.least.min()
    cover = np.zeros(len(h) + 1, dtype=np.int32)
    starts = np.flatnonzero(rich)
    cover += np.bincount(starts, minlength=len(cover)).astype(np.int32)
    cover -= np.bincount(stop[starts], minlength=len(cover)).astype(np.int32)
    at = np.flatnonzero(maybe & (np.cumsum(cover[:-1]) > 0))
    k = np.searchsorted(index.grams, h[at])
    k[k == len(index.grams)] = 0
    real = index.grams[k] == h[at]
    at, k = at[real], k[real]
    many = index.first[k + 1] - index.first[k]
    total = int(many.sum())
    if not total:
        return found
    entry = np.repeat(index.first[k] - (np.cumsum(many) - many), many) + np.arange(total)
    place = np.repeat(at, many)
    segment = index.segment[entry].astype(np.int64)
    diagonal = place - index.place[entry]
    width = np.maximum(index.budgets[segment], 1)
    band = diagonal // width
    # Every diagonal is in the band that starts at or before it and in the one before that.
    n_bands = len(points) + 2 * SEGMENT + 4
    key = segment * n_bands + band + SEGMENT + 2
    bands, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    bands = bands[counts >= index.least[bands // n_bands]]
    segment = bands // n_bands
    width = np.maximum(index.budgets[segment], 1)
    first = (bands % n_bands - SEGMENT - 2) * width
    reach = SEGMENT + 3 * int(width.max()) if len(width) else 0
    padded = np.concatenate([np.zeros(reach, np.uint32), points, np.zeros(reach, np.uint32)])
    for a in range(0, len(bands), ALIGNED):
        s, f = segment[a : a + ALIGNED], first[a : a + ALIGNED]
        # From the first diagonal back by the edits, to the last one and the segment's length.
        begin = f - index.budgets[s]
        columns = np.arange(reach + int(width.max()))
        regions = padded[np.clip(begin[:, None] + reach + columns, 0, len(padded) - 1)]
        edits, end = aligned(index.points[s], index.lengths[s], regions)
        for i in np.flatnonzero(edits <= index.budgets[s]):
            stop_at = int(begin[i] + end[i])
            doc = int(np.searchsorted(ends, max(stop_at - 1, 0), side="right"))
            base = int(ends[doc] - sizes[doc])
            stop_in = min(stop_at - base, len(texts[doc]))
            start_in = max(0, stop_in - int(index.lengths[s[i]]))
            if index.lengths[s[i]] < EXACT and not _whole_words(texts[doc], start_in, stop_in):
                continue
            found[doc].append(
                (index.items[s[i]], int(index.item_start[s[i]]), start_in, stop_in, int(edits[i]))
            )
    return [sorted(set(f), key=str) for f in found]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, text in enumerate(texts):
        if i > at and chars + len(text) > BATCH_CHARS:
            yield at, i
            at, chars = i, 0
        chars += len(text)
    if at < len(texts):
        yield at, len(texts)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's indexes, one for every ``BLOCK_CHARS`` characters."""
    rows = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")
    ).filter("text is not null")
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-chars // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        index = build_index(sorted(map(tuple, rows.filter(block == b).collect()), key=str))
        if index:
            yield index


def _hits(text: Column, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def held(series: pd.Series) -> pd.Series:
        out = []
        texts = [normalised(t) for t in series]
        for a, b in _runs(texts):
            out += find(texts[a:b], shared.value)
        names = ("item_id", "item_start", "start", "stop", "edits")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in hits] for hits in out], dtype=object)

    return held(text)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """A row per document and item that it holds segments of: ``segments`` how many, ``start``
    and ``stop`` the span from the first to the last in the normalised text, ``edits`` the most in one."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")
    )
    found = rows.select("doc_id", "row", F.array().cast(HITS).alias("hits")).limit(0)
    for index in _blocks(benchmark, item_col, "text"):
        found = found.union(rows.select("doc_id", "row", _hits(F.col("text"), index, docs.sparkSession).alias("hits")))
    each = found.select("doc_id", "row", F.explode("hits").alias("h"))
    return (
        each.groupBy("doc_id", "row", F.col("h.item_id").alias("item_id"))
        .agg(
            F.countDistinct("h.item_start").alias("segments"),
            F.min("h.start").alias("start"),
            F.max("h.stop").alias("stop"),
            F.max("h.edits").alias("edits"),
        )
        .drop("row")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no segment of any item, with the columns they came with."""
    for index in _blocks(benchmark, "item_id", "text"):
        docs = docs.filter(F.size(_hits(F.col(text_col), index, docs.sparkSession)) == 0)
    return docs
