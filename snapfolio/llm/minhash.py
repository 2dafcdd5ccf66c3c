"""Near-duplicate documents by MinHash with tensored banding.

A document's set are its distinct word shingles, or all its words as one if they are fewer.
Two small collections of hashes are made, left and right, each hash of ``ROWS`` MinHashes. Every left
hash with every right one forms the key of a table: 100 tables of six rows from 60 MinHashes
instead of 600. Two documents of similarity 0.85 share a table with probability 0.9998, more similar ones
all but surely. Candidates are confirmed on their full sets, with whole numbers.

Documents of the same words are one node, so copies are not compared. Before the tables
are formed, nodes that share no left hash or no right hash with another are left out,
which loses no candidate. Between table and full sets stand bitmaps that have, per bit, the parity of the shingles
that fall on it: bits that differ cannot outnumber the shingles that differ.

A null text, an empty one or one without words has an empty set and is linked with nothing.
A component's id is its least document id; it is null if none has one. Rows without id are linked like any other. Repeated rows are
in one component and have the same outcome. Columns other than the id and the text are not looked at.
Nodes and shingles are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.llm.graph import bucket_components
from snapfolio.llm.words import mix, slices, split_words
from snapfolio.sources.scratch import passing, sent, written

SHINGLE = 3
#: Similarity in hundredths.
LEAST_PERCENT = 85
#: MinHashes in a hash of the collections, and hashes in each of the two.
ROWS, SIDE = 3, 10
#: Longs in a bitmap; the first comparison folds them to ``FOLDED``.
BITMAP, FOLDED = 32, 8
BATCH_BYTES = 2 << 20

SKETCH = (
    "doc_id BIGINT, text_hash BIGINT, node BIGINT, n_shingles BIGINT, lefts ARRAY<BIGINT>, rights ARRAY<BIGINT>, "
    "bits ARRAY<BIGINT>"
)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts after another, where each text's begin, and 64
    bits per text that tell its sequence of words (0: no words)."""
    words = split_words(texts)
    h = words.hashes()[words.codes]
    n = len(h)
    gram = h.copy()
    for step in range(1, min(width, n)):
        gram[: n - step] = mix(gram[: n - step], h[step:])
    order = np.arange(n, dtype=np.uint64)
    sets, keys = [], np.zeros(len(words.starts) - 1, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:], strict=True)):
        if b == a:
            sets.append(gram[:0])
            continue
        own = h[a:b]
        whole = np.add.reduce(mix(own, order[: b - a]))
        keys[i] = mix(np.array([whole]), np.array([b - a], dtype=np.uint64))[0] or 1
        sets.append(np.unique(gram[a : b - width + 1]) if b - a >= width else keys[i : i + 1])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return np.concatenate(sets) if sets else gram[:0], starts, keys


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240607))
    n = 2 * SIDE * ROWS
    factors = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 1 << 63, n, dtype=np.uint64)


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``SKETCH`` of rows ``doc_id, text``. Texts without words have no arrays."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = _parameters()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                grams, starts, keys = shingle_sets(batch.column("text"), width)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                at = starts[:-1][full]
                least = np.empty((len(full), len(factors)), dtype=np.uint64)
                for k in range(len(factors) if len(full) else 0):
                    least[:, k] = np.minimum.reduceat((grams + terms[k]) * factors[k], at)
                hashes = least[:, ::ROWS].copy()
                for k in range(1, ROWS):
                    hashes = mix(hashes, least[:, k::ROWS])
                bits = np.zeros(len(full) * BITMAP * 64, dtype=np.uint8)
                owner = np.repeat(np.arange(len(full)), sizes[full])
                place = owner * (BITMAP * 64) + (grams >> np.uint64(7)).astype(np.int64) % (BITMAP * 64)
                bits = (np.bincount(place, minlength=len(bits)) & 1).astype(np.uint8)
                packed = np.packbits(bits).view(np.int64).reshape(len(full), BITMAP)

                def lists(values: np.ndarray) -> pa.Array:
                    has = np.zeros(len(sizes), dtype=bool)
                    has[full] = True
                    ends = np.concatenate([[0], np.cumsum(has)]) * values.shape[1]
                    return pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array(values.ravel().view(np.int64))
                    )

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_hash"), pa.array(keys.view(np.int64)), pa.array(sizes),
                        lists(np.ascontiguousarray(hashes[:, :SIDE])),
                        lists(np.ascontiguousarray(hashes[:, SIDE:])), lists(packed),
                    ],
                    names=[c.split()[0] for c in SKETCH.split(", ")],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, SKETCH)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                grams, starts, keys = shingle_sets(batch.column("text"), width)
                lists = pa.ListArray.from_arrays(
                    pa.array(starts.astype(np.int32)), pa.array(grams.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), lists], names=["node", "set"]
                )

    return docs.select("text").mapInArrow(expand, "node BIGINT, set ARRAY<BIGINT>")


def _differ(total: Column, least_percent: int, different: Column) -> Column:
    """Whether ``different`` shingles of ``total`` in both sets together leave them similar:
    with i in common, 100 i >= p (total - i) and different = total - 2 i."""
    return (100 + least_percent) * different <= (100 - least_percent) * total


def _xor_bits(columns: list[tuple[str, str]]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.bit_count(F.col(x).bitwiseXOR(F.col(y))).cast("long") for x, y in columns],
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    least_percent: int = LEAST_PERCENT,
    with_hash: bool = False,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``text_hash`` if asked for."""
    with passing() as stay:
        return stay(written(_judged(docs, id_col, text_col, width, least_percent, with_hash), "judged"))


def _judged(
    docs: DataFrame, id_col: str, text_col: str, width: int, least_percent: int, with_hash: bool
) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(sketches(docs, width), "sketches")
    nodes = drawn.filter("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n"),
        F.first("lefts").alias("lefts"),
        F.first("rights").alias("rights"),
        F.first("bits").alias("bits"),
    )
    nodes = written(nodes, "nodes")

    def sharing(side: str, among: DataFrame) -> DataFrame:
        """The nodes that have a hash of one collection in common with another node."""
        hashes = among.select("node", F.posexplode(side).alias("i", "h"))
        shared = hashes.groupBy("i", "h").agg(F.count("*").alias("c")).filter("c > 1")
        found = hashes.join(shared, ["i", "h"], "left_semi").select("node").distinct()
        return among.join(found, "node", "left_semi")

    left = written(sharing("lefts", nodes), "left")
    kept = written(sharing("rights", left), "sharing")
    tables = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(SIDE - 1)),
            lambda i: F.transform(
                F.sequence(F.lit(0), F.lit(SIDE - 1)),
                # Two digits of the bucket tell the table.
                lambda j: F.shiftright(
                    F.xxhash64(F.get(F.col("lefts"), i), F.get(F.col("rights"), j)), 7
                ) * (SIDE * SIDE) + i * SIDE + j,
            ),
        )
    )
    rows = kept.select("node", F.explode(tables).alias("bucket"))
    folds = [
        reduce(
            lambda a, b: a.bitwiseXOR(b),
            [F.col("bits")[k] for k in range(f, BITMAP, FOLDED)],
        ).alias(f"f{f}")
        for f in range(FOLDED)
    ]
    marks = written(
        kept.select(
            "node", "n", *folds,
            *[F.col("lefts")[k].alias(f"l{k}") for k in range(SIDE)],
            *[F.col("rights")[k].alias(f"r{k}") for k in range(SIDE)],
        ),
        "marks",
    )

    def near(x: str, y: str) -> Column:
        total = F.col(f"{x}n") + F.col(f"{y}n")
        sizes = F.abs(F.col(f"{x}n") - F.col(f"{y}n"))
        bits = _xor_bits([(f"{x}f{k}", f"{y}f{k}") for k in range(FOLDED)])
        return _differ(total, least_percent, sizes) & _differ(total, least_percent, bits)

    def first_table(x: str, y: str) -> Column:
        def first(side: str) -> Column:
            out = F.lit(SIDE)
            for k in reversed(range(SIDE)):
                out = F.when(F.col(f"{x}{side}{k}") == F.col(f"{y}{side}{k}"), k).otherwise(out)
            return out

        return first("l") * SIDE + first("r")

    # The texts of nodes that can be in a pair, one per node.
    wanted = written(kept.select(F.col("least").alias("doc_id")).distinct(), "wanted")
    # Texts are not shuffled for the few that are looked for.
    texts = docs.join(sent(wanted), "doc_id", "left_semi")
    # Nodes all of whose rows have no id are found among the rows without id.
    texts = texts.union(docs.filter("doc_id is null"))
    sets = _sets(texts, width).join(kept.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "sets")
    bitmaps = kept.select("node", "n", "bits")

    def confirm(pairs: DataFrame) -> DataFrame:
        def side(df: DataFrame, node: str, *columns: str) -> DataFrame:
            return df.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in columns])

        drawn = pairs.join(side(bitmaps, "a", "n", "bits"), "a").join(side(bitmaps, "b", "n", "bits"), "b")
        different = F.aggregate(
            F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")),
            F.lit(0).cast("long"), lambda s, v: s + v,
        )
        total = F.col("n_a") + F.col("n_b")
        close = written(
            drawn.filter(_differ(total, least_percent, different)).select("a", "b", "n_a", "n_b"), "close"
        )
        both = close.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        return both.filter(
            100 * common >= least_percent * (F.col("n_a") + F.col("n_b") - common)
        ).select("a", "b")

    table = F.pmod(F.col("bucket"), F.lit(SIDE * SIDE))
    groups = bucket_components(rows, marks, table, near, first_table, confirm)
    ids = written(
        nodes.select("node", "least").join(groups, "node", "left").select(
            "node", "least", F.coalesce("component", "node").alias("component")
        ),
        "ids",
    )
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(least, "component").select("node", "component_id")
    out = drawn.select("doc_id", "text_hash", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), *["text_hash"] * with_hash,
    )
