"""Quality by pairwise ranking (Bradley-Terry).

A document's worth is a weighted sum of features of its text. Of a document labelled 1 and one
labelled 0 the first should win: the weights make the logistic loss on the differences of their
features least. The cut lies at a quantile of the training scores: the share of documents
labelled 0. The score maps worth to 0 to 1 so that the cut is at ``THRESHOLD``.

All labelled rows that may be learnt from are fitted to. They are dealt into blocks of about ``BLOCK`` by a hash, and every
row labelled 1 meets every row labelled 0 of its block; a rare label's rows are in several blocks, so that no block is
without. The sums of a Newton step are made per block and added as decimals, so they depend neither on
partitions nor on the order of rows. The cut is the exact quantile over all these rows.

A null text counts as an empty one and has features of 0, so all empty texts have one score.
Repeated rows have equal scores. Labels without document, null labels and labels other than 0 and
1 are not used; if only one label is left, every score is ``THRESHOLD``, which accepts. Columns other
than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapfolio.llm.langid import held_out
from snapfolio.llm.words import slices, split_words
from snapfolio.sources.scratch import written

THRESHOLD = 0.7
#: Labelled rows in a block, on average, and those of each label at the least, on average.
BLOCK, LEAST = 512, 16
#: Parts that a range is cut into in search of a quantile.
BINS = 4096
#: Weight of the squares in the loss.
RIDGE = 1e-3
BATCH_BYTES = 1 << 20

FEATURES = (
    "capitals", "signs", "bars", "marks", "digits", "stops", "lines",
    "repeated_next", "repeated_words", "repeated_pairs", "word_length", "long_words", "log_words",
)


def _classes() -> np.ndarray:
    """For every byte, which kinds of characters it is one of."""
    kinds = np.zeros((7, 256), dtype=bool)
    for kind, characters in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"|", b"!?", b"0123456789", b".,;:", b"\n")
    ):
        kinds[kind, list(characters)] = True
    return kinds


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    words = split_words(texts)
    n_texts = len(words.starts) - 1
    raw = pa.array(texts.fill_null("")).cast(pa.large_string())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + n_texts + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    out = np.zeros((n_texts, len(FEATURES)))
    n_words = np.diff(words.starts)
    per_word = np.maximum(n_words, 1)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    for k, kind in enumerate(_classes()):
        # At most three a word, so that a few words of many signs do not outweigh the rest.
        out[:, k] = np.minimum(per_text(kind[bytes_], bounds) / per_word, 3)
    codes = words.codes
    text_of = np.repeat(np.arange(n_texts), n_words)
    size = max(len(words.distinct), 1)
    inside = text_of[1:] == text_of[:-1]
    equal = np.concatenate([[False], (codes[1:] == codes[:-1]) & inside]) if len(codes) else np.zeros(0, bool)
    out[:, 7] = per_text(equal, words.starts) / per_word

    def distinct_share(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o, new, n_texts)

    out[:, 8] = 1 - distinct_share(codes, text_of) / per_word
    if len(codes) > 1:
        pairs = (codes[:-1] * size + codes[1:])[inside]
        owner = text_of[1:][inside]
        out[:, 9] = 1 - distinct_share(pairs, owner) / np.maximum(n_words - 1, 1)
    out[n_words < 2, 9] = 0
    out[n_words == 0, 8] = 0
    lengths = np.array([len(w) for w in words.distinct.to_pylist()], dtype=np.int64)[codes]
    out[:, 10] = np.minimum(np.bincount(text_of, lengths, n_texts) / per_word, 40) / 10
    out[:, 11] = per_text(lengths > 20, words.starts) / per_word
    out[:, 12] = np.log1p(n_words) / 10
    return out


@dataclass
class Ranking:
    """What was learnt: the weights and the worth at which the score is ``THRESHOLD``."""

    weights: np.ndarray
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that it does not depend on the rows that come with it.
        return (x * self.weights).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        lead = np.tanh((self.worth(x) - self.cut) / 2)
        return np.where(lead >= 0, THRESHOLD + (1 - THRESHOLD) * lead, THRESHOLD * (1 + lead))


def pair_sums(x: np.ndarray, label: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Over all pairs of a row labelled 1 and one labelled 0: their number, the slope of the loss and its bend. A row counts
    ``n`` times."""
    good, bad = x[label == 1], x[label == 0]
    n_good, n_bad = n[label == 1].astype(float), n[label == 0].astype(float)
    margin = (good @ weights)[:, None] - (bad @ weights)[None, :]
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
    pairs = n_good[:, None] * n_bad[None, :]
    lost = p * pairs
    slope = bad.T @ lost.sum(axis=0) - good.T @ lost.sum(axis=1)
    bent = lost * (1 - p)
    cross = good.T @ bent @ bad
    bend = (good.T * bent.sum(axis=1)) @ good + (bad.T * bent.sum(axis=0)) @ bad - cross - cross.T
    return np.concatenate([[pairs.sum()], slope, bend.ravel()])


def _newton(width: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights that make the pairwise loss least; ``sums`` are those of ``pair_sums`` over all pairs."""
    weights = np.zeros(width)
    for _ in range(50):
        found = sums(weights)
        slope = found[1 : 1 + width] / found[0] + RIDGE * weights
        bend = found[1 + width :].reshape(width, width) / found[0] + RIDGE * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(x: np.ndarray, label: np.ndarray) -> Ranking:
    """The ranking of a few rows, all in one block."""
    if not (label == 1).any() or not (label == 0).any():
        return Ranking(np.zeros(x.shape[1]), 0.0)
    ones = np.ones(len(label), dtype=np.int64)
    ranking = Ranking(_newton(x.shape[1], lambda weights: pair_sums(x, label, ones, weights)), 0.0)
    ranking.cut = float(np.quantile(ranking.worth(x), (label == 0).mean()))
    return ranking


def _features_udf():
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        batch = pa.RecordBatch.from_arrays([column], names=["t"])
        return pd.Series(
            [row for part in slices(batch, "t", BATCH_BYTES) for row in features(part.column("t"))]
        )

    return of


def _blocks(cells: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``rows`` per block, of ``label, n, x``. Every block has both labels."""
    n_blocks = -(-sum(sizes.values()) // BLOCK)
    copies = {label: min(n_blocks, -(-LEAST * n_blocks // size)) for label, size in sizes.items()}
    seed = 0
    while True:
        times = F.when(F.col("label") == 1, copies[1]).otherwise(copies[0])
        # Rows of a very rare label are in every block.
        block = F.when(times == n_blocks, F.col("i")).otherwise(
            F.pmod(F.xxhash64(F.lit(seed), "doc_id", "x", "i"), F.lit(n_blocks))
        )
        dealt = cells.withColumn("i", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("block", block)
        blocks = written(
            dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("label", "n", "x"))).alias("rows")), "blocks"
        )
        one_label = F.get("rows", F.lit(0))["label"] == F.element_at("rows", -1)["label"]
        if blocks.filter(one_label).isEmpty():
            return blocks
        seed += 1


def _block_sums(blocks: DataFrame, weights: np.ndarray) -> np.ndarray:
    width = len(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows in batch.column("rows"):
                flat = rows.values
                x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                found.append(pair_sums(x, flat.field("label").to_numpy(), flat.field("n").to_numpy(), weights))
            yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], names=["s"])

    parts = blocks.select("rows").mapInArrow(sums, "s ARRAY<DOUBLE>").select(F.posexplode("s").alias("at", "v"))
    # Decimals, whose sum is the same in any order.
    total = parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(28,12)")).cast("double").alias("v")).collect()
    return np.array([r["v"] for r in sorted(total, key=lambda r: r["at"])])


def weighted_quantile(values: DataFrame, share: float) -> float:
    """The quantile of ``value``, each ``n`` times, as ``numpy.quantile`` has it. Only counts of ranges come to the driver."""
    lo, hi, total = values.agg(F.min("value"), F.max("value"), F.sum("n")).first()
    place = share * (total - 1)
    rank = int(place)
    before = 0
    while lo < hi:
        at = F.least(F.floor((F.col("value") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        ranges = (
            values.filter(F.col("value").between(lo, hi))
            .groupBy(at.alias("at"))
            .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n"))
            .collect()
        )
        for r in sorted(ranges, key=lambda r: r["at"]):
            lo, hi = r["lo"], r["hi"]
            if before + r["n"] > rank:
                break
            before += r["n"]
    if rank + 1 >= total:
        return lo
    up_to = values.filter(F.col("value") <= lo).agg(F.sum("n")).first()[0]
    above = lo if up_to > rank + 1 else values.filter(F.col("value") > lo).agg(F.min("value")).first()[0]
    return lo + (above - lo) * (place - rank)


def _worth_udf(ranking: Ranking):
    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(ranking.worth(np.stack(x)) if len(x) else np.zeros(0))

    return of


def _fitted(rows: DataFrame) -> Ranking:
    """Fits to all rows ``doc_id, label, x``."""
    nothing = Ranking(np.zeros(len(FEATURES)), 0.0)
    cells = written(rows.groupBy("doc_id", "label", "x").agg(F.count("*").alias("n")), "cells")
    found = cells.groupBy("label").agg(F.count("*").alias("cells"), F.sum("n").alias("n")).collect()
    sizes = {r["label"]: r["cells"] for r in found}
    if len(sizes) < 2:
        return nothing
    blocks = _blocks(cells, sizes)
    ranking = Ranking(_newton(len(FEATURES), lambda weights: _block_sums(blocks, weights)), 0.0)
    values = written(cells.select(_worth_udf(ranking)("x").alias("value"), "n"), "worths")
    n = {r["label"]: r["n"] for r in found}
    ranking.cut = weighted_quantile(values, n[0] / (n[0] + n[1]))
    return ranking


def _usable(labels: DataFrame, may_learn: Column, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn
    )


def learnt(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Ranking:
    """Fits to all labelled documents for whose ``doc_id`` ``may_learn`` holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(may_learn)
    # Features before the join, which then moves no texts.
    known = texts.select("doc_id", _features_udf()(F.col("text")).alias("x"))
    return _fitted(known.join(_usable(labels, may_learn, id_col, label_col), "doc_id"))


def score_of(text: Column, ranking: Ranking, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(ranking)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        batch = pa.RecordBatch.from_arrays([column], names=["t"])
        parts = [shared.value.scores(features(p.column("t"))) for p in slices(batch, "t", BATCH_BYTES)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def ranked(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    fold: int = 2,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learnt from the other folds."""
    known = written(
        docs.select(F.col(id_col).alias("doc_id"), _features_udf()(F.col(text_col)).alias("x")), "features"
    )
    may_learn = ~held_out("doc_id", folds, fold)
    ranking = _fitted(known.filter(may_learn).join(_usable(labels, may_learn, id_col, "quality"), "doc_id"))

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(ranking.scores(np.stack(x)) if len(x) else np.zeros(0))

    scores = known.select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), scored(F.col("x")).alias("score")
    )
    return scores.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    ranking = learnt(docs, labels, ~held_out("doc_id", 4, 2), text_col=text_col)
    score = score_of(F.col(text_col), ranking, docs.sparkSession)
    return docs.filter(score >= THRESHOLD)
