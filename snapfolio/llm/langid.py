"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, permuted by its place in an n-gram: an n-gram's
vector is the product (binding) of its letters' permuted vectors, a text's is the sum (bundling) of its
n-grams', a language's prototype the sum over its training texts. A text has the language
whose prototype has the largest cosine with it.

Sums and products can be swapped, so a text's product with a prototype is summed over the
products of its n-grams, and each distinct n-gram of a batch is bound once. A prototype
takes the same space however many n-grams there are, so scripts with many letters need no cap.

A null text, or one without letters, is ``und`` with score 0. So is every text if nothing was
learnt. Among equal cosines the first language by name wins. Repeated rows are judged
alike. Rows without id are learnt from if their remainder (that of an empty id) says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNDETERMINED = "und"
DIMENSIONS = 2048
#: Letters in an n-gram. Words are set off by one blank.
GRAM = 3
#: Characters that are looked at together.
BATCH_CHARS = 4 << 20
#: How sharply the score tells the best cosine from the others.
SHARPNESS = 40.0

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        import unicodedata

        kinds = [unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]
        _letters.append(np.array(kinds))
    return _letters[0]


def _vector(letter: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64(letter)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def _bound(grams: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given as rows of letter numbers."""
    out = np.roll(vectors, GRAM - 1, axis=1)[grams[:, 0]]
    for place in range(1, GRAM):
        out *= np.roll(vectors, GRAM - 1 - place, axis=1)[grams[:, place]]
    return out


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, text in enumerate(texts):
        if i > at and chars + len(text) > BATCH_CHARS:
            yield at, i
            at, chars = i, 0
        chars += len(text)
    if at < len(texts):
        yield at, len(texts)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts as rows of letter numbers, the letters, which n-gram
    stands where, and the text of each place."""
    # A blank on both sides, so that no n-gram spans two texts' words.
    joined = "".join(f" {t.lower()} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    symbols = np.where(_is_letter()[points], points, 32)
    # Runs of blanks count once.
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32) | (text_of[1:] != text_of[:-1])
    symbols, text_of = symbols[keep], text_of[keep]
    present = np.zeros(0x110000, dtype=bool)
    present[symbols] = True
    letters = np.flatnonzero(present)
    number = np.zeros(0x110000, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    s = number[symbols]
    n = len(letters)
    if len(s) < GRAM:
        return np.zeros((0, GRAM), dtype=np.int64), letters, np.zeros(0, dtype=np.int64), text_of[:0]
    code = np.zeros(len(s) - GRAM + 1, dtype=np.int64)
    for place in range(GRAM):
        code = code * n + s[place : len(s) - GRAM + 1 + place]
    inside = text_of[: len(code)] == text_of[GRAM - 1 :]
    code, text_of = code[inside], text_of[: len(inside)][inside]
    if n**GRAM <= 8 * max(len(code), 1 << 16):
        found = np.zeros(n**GRAM, dtype=bool)
        found[code] = True
        distinct = np.flatnonzero(found)
        place_of = np.zeros(n**GRAM, dtype=np.int32)
        place_of[distinct] = np.arange(len(distinct))
        which = place_of[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    grams = np.stack([distinct // n ** (GRAM - 1 - p) % n for p in range(GRAM)], axis=1)
    return grams, letters, which, text_of


def _vectors_by_letter(letters: np.ndarray) -> np.ndarray:
    return np.stack([_vector(int(c)) for c in letters]) if len(letters) else np.zeros((0, DIMENSIONS), np.float32)


#: N-grams bound at once.
BOUND = 4096


def prototypes(train: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """The prototype of every language, of all texts: one vector per language and task is
    shuffled, one per language comes to the driver."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            langs = batch.column("l").to_pylist()
            for a, b in _runs(texts):
                grams, letters, which, text_of = _grams(texts[a:b])
                names = sorted(set(langs[a:b]))
                lang_of = np.array([names.index(x) for x in langs[a:b]])
                counts = np.zeros((len(names), len(grams)))
                for k in range(len(names)):
                    counts[k] = np.bincount(which[lang_of[text_of] == k], minlength=len(grams))
                vectors = _vectors_by_letter(letters)
                total = np.zeros((len(names), DIMENSIONS))
                for at in range(0, len(grams), BOUND):
                    total += counts[:, at : at + BOUND] @ _bound(grams[at : at + BOUND], vectors)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + total[k]
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n] for n in names], pa.list_(pa.float64()))],
            names=["lang", "vector"],
        )

    rows = train.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    parts = rows.filter("l is not null and t is not null").mapInArrow(
        bundle, "lang STRING, vector ARRAY<DOUBLE>"
    )
    # Sums of whole numbers do not depend on their order.
    places = parts.select("lang", F.posexplode("vector").alias("place", "value"))
    summed = places.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = summed.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")
    )
    found = vectors.select("lang", F.transform("v", lambda x: x["value"]).alias("v")).collect()
    out = {r["lang"]: np.array(r["v"]) for r in found}
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def language_of(text: Column, learnt: dict[str, np.ndarray], spark) -> Column:
    """A struct ``lang, score`` for a text column."""
    names = list(learnt)
    unit = np.stack([v / np.linalg.norm(v) for v in learnt.values()]) if names else np.zeros((0, DIMENSIONS))
    shared = spark.sparkContext.broadcast(unit.astype(np.float32))

    @F.pandas_udf("lang STRING, score DOUBLE")
    def judged(series: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in series]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        unit = shared.value
        for a, b in _runs(texts) if names else ():
            grams, letters, which, text_of = _grams(texts[a:b])
            if not len(grams):
                continue
            vectors = _vectors_by_letter(letters)
            near = np.concatenate(
                [_bound(grams[at : at + BOUND], vectors) @ unit.T for at in range(0, len(grams), BOUND)]
            ).astype(np.float64)
            n = b - a
            dots = np.stack([np.bincount(text_of, near[which, k], n) for k in range(len(names))], axis=1)
            # N-gram vectors are nearly orthogonal, so the squared length of a text's vector is
            # that of its counts times the dimensions. It is the same for all languages.
            gram_of = text_of.astype(np.int64) * len(grams) + which
            _, first, counts = np.unique(gram_of, return_index=True, return_counts=True)
            squares = np.bincount(text_of[first], counts.astype(np.float64) ** 2, n)
            cosines = dots / np.sqrt(np.maximum(squares, 1)[:, None] * DIMENSIONS)
            best = cosines.argmax(axis=1)
            gap = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
            score = 1 / gap.sum(axis=1)
            lettered = np.zeros(n, dtype=bool)
            has = letters != 32
            lettered[text_of[has[grams].any(axis=1)[which]]] = True
            for i in np.flatnonzero(lettered):
                langs[a + i], scores[a + i] = names[best[i]], float(score[i])
        return pd.DataFrame({"lang": langs, "score": scores})

    return judged(text)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    fold: int = 2,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents, learnt from the other folds."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col, folds, fold).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    learnt = prototypes(rows.filter(~F.col("held_out")), "text", "lang")
    judged = rows.select("doc_id", "held_out", language_of(F.col("text"), learnt, docs.sparkSession).alias("j"))
    return judged.select(
        "doc_id", "held_out", F.col("j.lang").alias("lang_pred"), F.col("j.score").alias("score")
    )
