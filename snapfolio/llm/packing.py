"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. Longer ones than a sequence are cut into full
pieces and a rest. Lengths are all that packing depends on, and there are at most as many
different lengths as a sequence has tokens, so the plan is made for counts of lengths: pieces
above a third of the capacity are matched greedily, the longest with the longest that still fits, at
most two in a sequence; smaller ones, longest first, go to the smallest gap that holds
them. The plan is a short table of runs: pieces number r to s of one length go to sequences from
x on, so many in each, at one offset. Every piece finds its place from its number among the
pieces of its length; no task ever holds all pieces, and equal lengths, however many, are
numbered by task.

A null text counts as an empty one: it is the end id alone. Rows without id and repeated
rows are packed like any other. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from snapfolio.llm.words import slices, split_words
from snapfolio.sources.scratch import written

CAPACITY = 4096
END_ID = 1
#: Texts of one batch that are split at once, in bytes.
BATCH_BYTES = 8 << 20
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 200_000

PIECES = (
    "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, "
    "task INT, nth BIGINT"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The rules of the vocabulary that words are split by.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class WordIds:
    """The ids of words, as the tokenizer gives them for a text that consists of the word.

    The tokenizer drops white space and never joins what it separates, so the ids of a text
    are those of its words one after another. Words of ASCII and Latin-1 letters, digits and signs are cut
    as the vocabulary's own pattern cuts them and looked up in its model; all other words
    go through the whole tokenizer. So do texts that hold the string of a special token, which is one id, and
    all texts if the file has other rules than those that are followed here.
    """

    # The pattern of the vocabulary, for the characters of PLAIN.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PLAIN = re.compile(r"[!-~À-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        described = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in described["added_tokens"]]
        self.followed = {k: described[k] for k in RULES} == RULES and described["model"]["type"] == "BPE"
        self.model = self.whole.model
        # The byte-level alphabet shows printable bytes as themselves, others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, list[int]] = {}

    def part(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(shown)]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def word(self, word: str) -> list[int]:
        if self.PLAIN.fullmatch(word):
            found = [self.part(p) for p in self.PARTS.findall(word.lower())]
            return found[0] if len(found) == 1 else [i for ids in found for i in ids]
        return self.whole.encode(word, add_special_tokens=False).ids


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids after another, and where each text's begin; no end ids."""
    encoder = word_ids(path)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    whole = np.full(len(texts), not encoder.followed)
    for special in encoder.special:
        whole |= np.asarray(pc.match_substring(texts, special))
    if not whole.any():
        return _ids_by_word(texts, encoder)
    ids, starts = _ids_by_word(texts.filter(pa.array(~whole)), encoder)
    by_word = iter(np.split(ids, starts[1:-1]) if len(starts) > 1 else [])
    apart = iter(encoder.whole.encode_batch(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
    each = [np.array(next(apart).ids, dtype=np.uint32) if w else next(by_word) for w in whole]
    return np.concatenate(each).astype(np.uint32), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def _ids_by_word(texts: pa.Array, encoder: WordIds) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(texts)
    each = [encoder.word(w) for w in words.distinct.to_pylist()]
    counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    flat = np.fromiter((i for ids in each for i in ids), dtype=np.uint32, count=int(counts.sum()))
    first = np.cumsum(counts) - counts
    n = counts[words.codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first[words.codes] - (ends - n), n) + np.arange(total)
    return flat[at], np.concatenate([[0], ends])[words.starts]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """A row per piece. ``nth`` numbers the pieces of one length in one task."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, "t", BATCH_BYTES):
                ids, starts = token_ids(batch.column("t"), path)
                out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
                for i, doc in enumerate(batch.column("i").to_pylist()):
                    own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        n = len(piece)
                        nth = seen.get(n, 0)
                        seen[n] = nth + 1
                        for name, value in zip(
                            out, (doc, k, at, n, zlib.crc32(piece.tobytes()), task, nth), strict=True
                        ):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=ARROW_PIECES)

    return docs.select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")
    ).mapInArrow(cut, PIECES)


ARROW_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``length, from, sequence, per, offset``: pieces of a length, from number ``from`` on up to the
    length's next run, go to sequences from ``sequence`` on, ``per`` in each, the first at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    placed = dict.fromkeys(left, 0)
    opened = 0
    # Sequences by the gap they have: ranges (first, count) of sequences with that gap.
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    def put(n: int, first: int, count: int, per: int, offset: int) -> None:
        runs.append((n, placed[n], first, per, offset))
        placed[n] += count
        left[n] -= count

    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            # The longest large piece that fits beside this one.
            mate = next((m for m in large if m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                count = left[n]
                put(n, opened, count, 1, 0)
                free(capacity - n, opened, count)
            elif mate == n:
                # Two of a kind stand in one sequence after another.
                count = left[n] // 2
                put(n, opened, 2 * count, 2, 0)
                free(capacity - 2 * n, opened, count)
            else:
                count = min(left[n], left[mate])
                put(n, opened, count, 1, 0)
                put(mate, opened, count, 1, n)
                free(capacity - n - mate, opened, count)
            opened += count
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                count = -(-left[n] // (capacity // n))
                free(capacity, opened, count)
                opened += count
                continue
            gap = order[k]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            per = gap // n
            full = min(count, left[n] // per)
            if full:
                put(n, first, full * per, per, capacity - gap)
                free(gap - per * n, first, full)
                free(gap, first + full, count - full)
            else:
                some = left[n]
                put(n, first, some, per, capacity - gap)
                free(gap - some * n, first, 1)
                free(gap, first + 1, count - 1)
    return runs


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    by_task = cut.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = by_task.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    # At most one row per length.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    table = spark.sparkContext.broadcast(np.array(runs or [(0, 0, 0, 1, 0)], dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        # Runs of one length lie between the places of its first run and of the next length's.
        keys = runs[:, 0].astype(np.float64) * 2.0**40 + runs[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch.column("length"))
            number = np.asarray(batch.column("nth")) + np.asarray(batch.column("first"))
            run = runs[np.searchsorted(keys, length * 2.0**40 + number, side="right") - 1]
            nth = number - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(run[:, 2] + nth // run[:, 3]),
                    pa.array(run[:, 4] + nth % run[:, 3] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return cut.join(firsts, ["length", "task"]).mapInArrow(
        place,
        "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, "
        "sequence_id BIGINT, offset BIGINT",
    )
