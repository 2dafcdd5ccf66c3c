"""Language model scores by a probabilistic suffix tree over words.

Tokens are words, A-Z in lower case, and an end per text. The root's distribution is that of single
tokens, each count raised by 0.1 and one more token allowed for. A context of one or two words is
a candidate if training texts have it ``LEAST_COUNT`` times. That number does not depend on the
corpus, so what is learnt grows with it. A candidate becomes a state if its next-token distribution
diverges from that of its suffix: by ``LEAST_DIVERGENCE`` nats per occurrence at least, each occurrence left out
of the counts that it is judged by, so that chance does not pass for structure. The suffix of a
state is a state. Distributions are smoothed towards the suffix's (Witten-Bell):
(count + kinds * p(suffix)) / (total + kinds). A token's probability is that in the longest state that
its preceding words end with.

Texts are encoded once, in blocks: the numbers of their words, and the distinct words' hashes. A block
sends each distinct (context, token) once, and they are counted over all blocks, first for single words,
then for the pairs found to be frequent. They are dealt onto shards, whose number follows the number of tokens, and those
of a block and shard go as one packed row, so that Spark shuffles and writes a few bytes for each. A shard has all of a
context, but for contexts of ``SPLIT`` occurrences and more: these are dealt by their tokens as well, and their
distributions are judged in tables. Each block is told the counts it asked for and which of its
contexts are states. Contexts, states and distributions are tables only; none of them comes
to the driver or is held whole by a task.

A null text counts as an empty one: one end token. The remainder of a null id is that of an empty
text. Repeated rows are learnt from and scored like any other. Columns other than the id and the text
are not looked at. If nothing may be learnt from, counts are 0 and probabilities those of one unknown token.
Words are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from snapfolio.llm.langid import held_out
from snapfolio.llm.words import mix, slices, split_words
from snapfolio.sources.scratch import passing, written

ADDED = 0.1
#: Occurrences of a context in training texts, whatever their size.
LEAST_COUNT = 50
LEAST_DIVERGENCE = 0.02
#: Bytes of text in a block, or one text.
BLOCK_BYTES = 8 << 20
#: Tokens of a shard, about, and the fewest shards.
SHARD_TOKENS, FEWEST_SHARDS = 2 << 20, 24
#: Occurrences from which the tokens after a context are dealt onto several shards.
SPLIT = 2 << 20
#: The end token. No word hashes to it but by a chance of 2^-64.
END = 0x5EED0E4D

BLOCKS = (
    "block BIGINT, doc_id ARRAY<BIGINT>, held_out ARRAY<BOOLEAN>, n ARRAY<INT>, codes BINARY, "
    "symbols ARRAY<BIGINT>, n_train ARRAY<INT>"
)
#: ``counts`` and ``told`` are packed.
COUNTED = BLOCKS.replace("n_train ARRAY<INT>", "counts BINARY")
TOLD = COUNTED + ", told BINARY"
SENT = "block BIGINT, shard INT, packed BINARY"
#: Rows for a block: its counts, and which of its contexts are split; rows without block: of split contexts the
#: distributions, of others the suffixes of states.
SUMMED = (
    "block BIGINT, shard INT, packed BINARY, run ARRAY<BIGINT>, ctx ARRAY<BIGINT>, c ARRAY<BIGINT>, p ARRAY<DOUBLE>, "
    "suffix ARRAY<BIGINT>"
)


def encoded(docs: DataFrame) -> DataFrame:
    """``BLOCKS`` of rows ``doc_id, held_out, text``: ``n`` tokens per text, the number of each token's
    word in the block (packed), the hash of each distinct word and its training tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                words = split_words(batch.column("text"))
                symbols = np.append(words.hashes(), np.uint64(END)).view(np.int64)
                codes = np.insert(words.codes, words.starts[1:], len(symbols) - 1)
                n = np.diff(words.starts) + 1
                held = np.asarray(batch.column("held_out"))
                train = np.repeat(~held, n)
                n_train = np.bincount(codes[train], minlength=len(symbols))
                row = {
                    "block": [block],
                    "doc_id": [batch.column("doc_id")],
                    "held_out": [pa.array(held)],
                    "n": [n.astype(np.int32)],
                    "codes": [_packed(codes)],
                    "symbols": [symbols],
                    "n_train": [n_train.astype(np.int32)],
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) if f in ("block", "codes") else _one_list(v[0]) for f, v in row.items()],
                    names=list(row),
                )
                block += 1

    return docs.mapInArrow(encode, BLOCKS)


def _packed(codes: np.ndarray) -> bytes:
    """The numbers by their first, second, third and fourth bytes, compressed: about two bytes each."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(packed, decompressed_size=4 * n, asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T)
    return numbers.view("<i4").ravel()


def _one_list(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _distinct(context: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, token), always in the same order, and which one each pair given is."""
    keys, which = np.unique(context * size + codes, return_inverse=True)
    return keys // size, keys % size, which


def _before(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value one token earlier in the same text, or -1."""
    out = np.full(len(values), -1, dtype=np.int64)
    out[1:] = values[:-1]
    out[np.cumsum(n, dtype=np.int64) - n] = -1
    return out


def _bigrams(codes: np.ndarray, n: np.ndarray, counts: np.ndarray, least: int):
    """The tokens that follow a frequent word, and the distinct (word, token)."""
    before = _before(codes, n)
    use = np.flatnonzero((before >= 0) & (counts[before] >= least))
    return use, *_distinct(before[use], codes[use], len(counts))


def _trigrams(codes, n, use, which, in_all, least: int, size: int):
    """The tokens that follow a frequent pair, and the distinct (number of the pair, token)."""
    pair = np.full(len(codes), -1, dtype=np.int64)
    pair[use] = which
    before = _before(pair, n)
    # The count appended is that of no pair.
    use = np.flatnonzero(np.append(in_all, -1)[before] >= least)
    return pair, use, *_distinct(before[use], codes[use], size)


def _columns(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    """Columns of one block, the tokens' numbers and the texts' lengths first. Those packed are unpacked, ``told`` into
    three: ``in_all``, ``kinds`` and ``state``."""
    n = batch.column("n")[i].values.to_numpy(zero_copy_only=False)
    out = [_unpacked(batch.column("codes")[i].as_py(), int(n.sum())).astype(np.int64), n]
    for name in names:
        value = batch.column(name)[i]
        out += _unpack(value.as_py()) if name in ("counts", "told") else [value.values.to_numpy(zero_copy_only=False)]
    return out


class Shards(NamedTuple):
    """How many there are, and the occurrences from which a context is split."""

    number: int
    split: int


def _dealt(ctx, sym, total, shards: Shards) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which a block sends its (context, token) to the shards, the shard of each in that order, and
    where in it a run begins: those of one context and shard. They are given context by context, as hashes, and a context
    has ``total`` training occurrences."""
    part = mix(sym.view(np.uint64), np.uint64(END)) % (1 + total // shards.split).astype(np.uint64)
    shard = (mix(ctx.view(np.uint64), part) % np.uint64(shards.number)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, ctx = shard[order], ctx[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (shard[1:] != shard[:-1]) | (ctx[1:] != ctx[:-1])
    return order, shard, np.flatnonzero(first)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of longs, each by its first, second, … bytes, as many as it needs, compressed."""
    codec, sizes, parts = pa.Codec("zstd", compression_level=1), [], []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<i8")
        # Negative numbers need all bytes.
        width = max(1, (int(a.view("<u8").max()).bit_length() + 7) // 8) if len(a) else 0
        parts.append(codec.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True))
        sizes.append((len(a), width, len(parts[-1])))
    return b"".join([len(arrays).to_bytes(8, "little"), np.array(sizes, dtype="<i8").tobytes(), *parts])


def _unpack(packed: bytes) -> list[np.ndarray]:
    codec, many = pa.Codec("zstd"), int.from_bytes(packed[:8], "little")
    at, out = 8 + 24 * many, []
    for n, width, size in np.frombuffer(packed, dtype="<i8", count=3 * many, offset=8).reshape(-1, 3).tolist():
        numbers = np.zeros((n, 8), dtype=np.uint8)
        if n:
            planes = codec.decompress(packed[at : at + size], decompressed_size=width * n, asbytes=True)
            numbers[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
        out.append(numbers.view("<i8").ravel())
        at += size
    return out


def _sent(
    block: int, of_context: dict[str, np.ndarray], of_entry: dict[str, np.ndarray], shards: Shards
) -> Iterator[pa.RecordBatch]:
    """A packed row for each shard. ``of_context`` has values of an entry's context, alike in all of its entries, of which
    ``ctx`` and ``total`` are two; ``of_entry`` has values of each, of which ``sym`` is one."""
    order, shard, runs = _dealt(of_context["ctx"], of_entry["sym"], of_context["total"], shards)
    if not len(order):
        return
    sizes = np.diff(np.append(runs, len(order)))
    contexts = [v[order[runs]] for v in of_context.values()]
    entries = [v[order] for v in of_entry.values()]
    numbers, begins = np.unique(shard, return_index=True)
    for number, begin, end in zip(numbers.tolist(), begins, [*begins[1:], len(order)], strict=True):
        r = slice(*np.searchsorted(runs, [begin, end]))
        packed = _pack(sizes[r], *[v[r] for v in contexts], *[v[begin:end] for v in entries])
        yield pa.RecordBatch.from_pydict(
            {"block": [block], "shard": pa.array([number], pa.int32()), "packed": pa.array([packed], pa.binary())}
        )


def _in_all(
    sent: DataFrame, probability, of_contexts: int, least_divergence: float, shards: Shards
) -> DataFrame:
    """``SUMMED`` of the rows sent, with counts summed over all blocks. A context has ``of_contexts`` values, of which
    the first are ``ctx, total, suffix``; the first of an entry are ``sym, c``. ``probability`` of the further values of
    both is that of the token by the context's suffix."""

    def sum_up(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        parts = [_unpack(x.as_py()) for x in table.column("packed")]
        n_runs, n_entries = [len(x[0]) for x in parts], [len(x[-1]) for x in parts]
        sizes, *values = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        (ctx, total, suffix, *known), (sym, own, *counted) = values[:of_contexts], values[of_contexts:]
        contexts, first_run, which_ctx = np.unique(ctx, return_index=True, return_inverse=True)
        key = mix(np.repeat(which_ctx, sizes).view(np.uint64), sym.view(np.uint64))
        del sym
        grams, which = np.unique(key, return_inverse=True)
        del key
        at = np.zeros(len(grams), dtype=np.int64)
        # Any place of a gram has what is known of it.
        at[which] = np.arange(len(which))
        del grams
        c = np.bincount(which, own, minlength=len(at)).astype(np.int64)
        run_of = np.repeat(np.arange(len(ctx)), sizes)[at]
        p = probability([v[run_of] for v in known], [v[at] for v in counted])
        seen = np.flatnonzero(c > 0)
        of, c_seen, p_seen = which_ctx[run_of[seen]], c[seen], p[seen]
        kinds = np.bincount(of, minlength=len(contexts))
        all_of = np.bincount(of, c_seen, minlength=len(contexts))
        state = np.bincount(of, _gains(c_seen, p_seen, all_of[of], kinds[of]), minlength=len(contexts))
        state = state >= least_divergence * all_of
        split = total[first_run] >= shards.split
        summed = c[which]
        told = np.where(split, -1, 2 * kinds + state)[which_ctx]
        run_at, entry_at = np.cumsum([0, *n_runs]), np.cumsum([0, *n_entries])
        for i, block in enumerate(blocks):
            r = slice(run_at[i], run_at[i + 1])
            later = np.flatnonzero(told[r] < 0)
            yield _summed(
                block, shard, _pack(told[r], summed[entry_at[i] : entry_at[i + 1]]), run=later, ctx=ctx[r][later]
            )
        yield _summed(None, shard, None, suffix=np.unique(suffix[first_run[state & ~split]]))
        later = np.flatnonzero(split[of])
        if len(later):
            at = of[later]
            yield _summed(
                None, shard, None, ctx=contexts[at], c=c_seen[later], p=p_seen[later], suffix=suffix[first_run[at]]
            )

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(sum_up(table)))

    return sent.groupBy("shard").applyInArrow(whole, SUMMED)


def _gains(c: np.ndarray, p: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What each (context, token) adds to its context's divergence."""
    out = np.zeros(len(c))
    # Nothing is left of a context that occurred once.
    some = np.flatnonzero(total > 1)
    c, p, total, kinds = c[some], p[some], total[some], kinds[some]
    kinds = kinds - (c == 1)
    out[some] = c * np.log((c - 1 + kinds * p) / (total - 1 + kinds) / p)
    return out


def _summed(block: int | None, shard: int, packed: bytes | None, **lists: np.ndarray) -> pa.RecordBatch:
    kinds = {"run": pa.int64(), "ctx": pa.int64(), "c": pa.int64(), "p": pa.float64(), "suffix": pa.int64()}
    row = [pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([packed], pa.binary())]
    row += [
        _one_list(pa.array(lists[k], t)) if k in lists else pa.nulls(1, pa.list_(t)) for k, t in kinds.items()
    ]
    return pa.RecordBatch.from_arrays(row, names=["block", "shard", "packed", *kinds])


def _split_tested(summed: DataFrame, least_divergence: float) -> DataFrame:
    """``ctx, suffix, kinds, state`` per context that is split."""
    grams = summed.filter("block IS NULL AND ctx IS NOT NULL")
    grams = grams.select(F.explode(F.arrays_zip("ctx", "suffix", "c", "p")).alias("g")).select("g.*")
    totals = grams.groupBy("ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    kinds = F.col("kinds") - F.when(F.col("c") == 1, 1).otherwise(0)
    left_out = (F.col("c") - 1 + kinds * F.col("p")) / (F.col("total") - 1 + kinds)
    gain = F.when(F.col("total") > 1, F.col("c") * F.log(left_out / F.col("p"))).otherwise(0.0)
    tested = grams.join(totals, "ctx").groupBy("ctx", "total", "kinds").agg(
        F.sum(gain).alias("gain"), F.first("suffix").alias("suffix")
    )
    return tested.withColumn("state", F.col("gain") >= least_divergence * F.col("total")).drop("gain", "total")


def _answers(summed: DataFrame, tested: DataFrame) -> DataFrame:
    """What each block is told of its contexts and tokens: ``of, shard, packed``, and of split contexts ``of, shard, j,
    kinds, state``, by their runs."""
    rows = summed.filter("block IS NOT NULL")
    told = rows.select(
        F.col("block").alias("of"), "shard", "packed", F.lit(None).cast("long").alias("j"),
        F.lit(None).cast("long").alias("kinds"), F.lit(None).cast("boolean").alias("state"),
    )
    split = rows.select("block", "shard", F.explode(F.arrays_zip("run", "ctx")).alias("r"))
    split = split.select("block", "shard", F.col("r.run").alias("j"), F.col("r.ctx").alias("ctx")).join(tested, "ctx")
    return told.union(
        split.select("block", "shard", F.lit(None).cast("binary"), "j", F.col("kinds").cast("long"), "state")
    )


def _told(blocks: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """Every block with the answers to it."""
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(function, schema)


def _read(answers: pa.Table, order: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the (context, token) of a block the counts, and of each of its runs the kinds and whether it is a state."""
    packed = answers.filter(pc.is_valid(answers.column("packed"))).sort_by("shard")
    parts = [_unpack(x.as_py()) for x in packed.column("packed")]
    told = np.concatenate([np.zeros(0, dtype=np.int64), *[x[0] for x in parts]])
    counts = np.zeros(len(order), dtype=np.int64)
    counts[order] = np.concatenate([np.zeros(0, dtype=np.int64), *[x[1] for x in parts]])
    kinds, state = told >> 1, (told & 1).astype(bool)
    begins = dict(zip(packed.column("shard").to_pylist(), np.cumsum([0, *[len(x[0]) for x in parts]]), strict=False))
    later = answers.filter(pc.is_valid(answers.column("kinds")))
    at = [begins[s] + j for s, j in zip(later.column("shard").to_pylist(), later.column("j").to_pylist(), strict=True)]
    at = np.array(at, dtype=np.int64)
    kinds[at] = later.column("kinds").to_numpy()
    state[at] = later.column("state").to_numpy(zero_copy_only=False)
    return counts, kinds, state


def with_counts(blocks: DataFrame, asked: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks with ``counts``, the training count of each of their words in all blocks, and the words' numbers in
    place of their hashes. A word that only one block has keeps its hash."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks().to_batches()[0]
        counts = batch.column("n_train")[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = batch.column("symbols")[0].values.to_numpy(zero_copy_only=False).copy()
        j = right.column("j").to_numpy()
        counts[j], symbols[j] = right.column("c").to_numpy(), right.column("number").to_numpy()
        left = left.drop_columns(["symbols", "n_train"])
        left = left.append_column("symbols", pa.chunked_array([_one_list(symbols)]))
        return left.append_column("counts", pa.array([_pack(counts)], pa.binary()))

    # A block is not told of words that only it has.
    elsewhere = asked.join(words.filter("blocks > 1"), "sym")
    return _told(blocks, elsewhere.select(F.col("block").alias("of"), "j", "c", "number"), count, COUNTED)


def followers(blocks: DataFrame, least: int, shards: Shards) -> DataFrame:
    """``SENT``: each distinct (word, token) of a block, with the block's training count and the token's in all."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, n, symbols, counts, held = _columns(batch, i, "symbols", "counts", "held_out")
                use, ctx, code, which = _bigrams(codes, n, counts, least)
                train = np.repeat(~held, n)[use]
                own = np.bincount(which[train], minlength=len(ctx))
                yield from _sent(
                    batch.column("block")[i].as_py(),
                    {"ctx": symbols[ctx], "total": counts[ctx], "suffix": np.zeros(len(ctx), dtype=np.int64)},
                    {"sym": symbols[code], "c": own, "count": counts[code]},
                    shards,
                )

    return blocks.select("block", "codes", "n", "symbols", "counts", "held_out").mapInArrow(follow, SENT)


def with_singles(blocks: DataFrame, answers: DataFrame, least: int, shards: Shards) -> DataFrame:
    """The blocks with what they are told of single words, packed: ``in_all`` has the training count of each (word,
    token), ``kinds`` and ``state`` concern the words."""

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks().to_batches()[0]
        codes, n, symbols, counts = _columns(batch, 0, "symbols", "counts")
        _, ctx, code, _ = _bigrams(codes, n, counts, least)
        order, _, runs = _dealt(symbols[ctx], symbols[code], counts[ctx], shards)
        c, kinds, state = _read(right, order, runs)
        kinds_of, state_of = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=bool)
        at = ctx[order[runs]]
        kinds_of[at], state_of[at] = kinds, state
        return left.append_column("told", pa.array([_pack(c, kinds_of, state_of)], pa.binary()))

    return _told(blocks, answers, tell, TOLD)


def _pairs(symbols: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hashes of pairs of a block's words."""
    return mix(symbols[first].view(np.uint64), symbols[second].view(np.uint64)).view(np.int64)


def pair_followers(blocks: DataFrame, least: int, shards: Shards) -> DataFrame:
    """As ``followers``, for contexts of two words, whose suffix is the later one. A token also has the training count
    in all of (later word, token)."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, n, symbols, counts, held, in_all, kinds, _ = _columns(
                    batch, i, "symbols", "counts", "held_out", "told"
                )
                use, word, later, which = _bigrams(codes, n, counts, least)
                pair, use, ctx, code, which = _trigrams(codes, n, use, which, in_all, least, len(counts))
                train = np.repeat(~held, n)[use]
                own = np.bincount(which[train], minlength=len(ctx))
                # Any place of each (pair, token) tells which (word, token) it ends with.
                last = np.zeros(len(ctx), dtype=np.int64)
                last[which] = pair[use]
                suffix = later[ctx]
                yield from _sent(
                    batch.column("block")[i].as_py(),
                    {
                        "ctx": _pairs(symbols, word[ctx], suffix), "total": in_all[ctx], "suffix": symbols[suffix],
                        "kinds": kinds[suffix], "count": counts[suffix],
                    },
                    {"sym": symbols[code], "c": own, "count": counts[code], "after": in_all[last]},
                    shards,
                )

    columns = blocks.select("block", "codes", "n", "symbols", "counts", "held_out", "told")
    return columns.mapInArrow(follow, SENT)


def scored(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    fold: int = 0,
    least_count: int = LEAST_COUNT,
    least_divergence: float = LEAST_DIVERGENCE,
    split: int = SPLIT,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``n_in_states``, the tokens
    predicted by a state other than the root, of every row."""
    if least_count < 1:
        raise ValueError("a context must occur once at least")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds, fold).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    with passing() as stay:
        return stay(written(_scored(rows, least_count, least_divergence, split), "scored"))


def _scored(rows: DataFrame, least_count: int, least_divergence: float, split: int) -> DataFrame:
    """``scored`` of rows ``doc_id, held_out, text``."""
    # Tables that a later one takes the place of are deleted on the way.
    with passing() as stay:
        with passing() as stay_here:
            blocks = written(encoded(rows), "blocks")
            asked = blocks.select("block", F.posexplode(F.arrays_zip("symbols", "n_train")).alias("j", "s"))
            asked = asked.select("block", "j", F.col("s.symbols").alias("sym"), F.col("s.n_train").alias("n"))
            words = asked.groupBy("sym").agg(F.sum("n").alias("c"), F.count("*").alias("blocks"))
            # Frequent words have small numbers, which take less room than their hashes.
            words = words.sortWithinPartitions(F.desc("c")).withColumn("number", F.monotonically_increasing_id())
            words = written(words, "words")
            first = words.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
            n_all, v_all = first["n"] or 0, first["v"]
            base = n_all + ADDED * (v_all + 1)
            blocks = stay_here(written(with_counts(blocks, asked, words), "blocks"))
        tokens = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        n_tokens = blocks.agg(F.sum(tokens)).first()[0] or 0
        shards = Shards(max(FEWEST_SHARDS, -(-n_tokens // SHARD_TOKENS)), split)

        def by_root(of_context: list[np.ndarray], of_entry: list[np.ndarray]) -> np.ndarray:
            return (of_entry[0] + ADDED) / base

        one = _in_all(followers(blocks, least_count, shards), by_root, 3, least_divergence, shards)
        one = written(one, "summed")
        told = _answers(one, _split_tested(one, least_divergence))
        blocks = stay(written(with_singles(blocks, told, least_count, shards), "blocks"))

    def by_word(of_context: list[np.ndarray], of_entry: list[np.ndarray]) -> np.ndarray:
        kinds, count = of_context
        root = (of_entry[0] + ADDED) / base
        return (of_entry[1] + kinds * root) / (count + kinds)

    two = _in_all(pair_followers(blocks, least_count, shards), by_word, 5, least_divergence, shards)
    two = written(two, "summed")
    pairs = written(_split_tested(two, least_divergence), "pairs")
    # The suffix of a state is a state; answers about words have no shard.
    suffixes = two.filter("block IS NULL AND ctx IS NULL").select(F.explode("suffix").alias("sym"))
    suffixes = suffixes.union(pairs.filter("state").select("suffix")).distinct()
    places = blocks.select("block", F.posexplode("symbols").alias("j", "sym"))
    above = places.join(suffixes, "sym").select(
        "block", F.lit(None).cast("int"), F.lit(None).cast("binary"), F.col("j").cast("long"),
        F.lit(None).cast("long"), F.lit(True),
    )
    answers = _answers(two, pairs).union(above)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks().to_batches()[0]
        codes, n, symbols, counts, in_all, kinds, state = _columns(batch, 0, "symbols", "counts", "told")
        state = state.astype(bool)
        state[right.filter(pc.is_null(right.column("shard"))).column("j").to_numpy()] = True
        use, word, later, which = _bigrams(codes, n, counts, least_count)
        _, use_two, pair, code, which_two = _trigrams(codes, n, use, which, in_all, least_count, len(counts))
        order, _, runs = _dealt(_pairs(symbols, word[pair], later[pair]), symbols[code], in_all[pair], shards)
        c_two, of_run, state_of_run = _read(right, order, runs)
        kinds_two, state_two = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
        sizes = np.diff(np.append(runs, len(order)))
        kinds_two[order], state_two[order] = np.repeat(of_run, sizes), np.repeat(state_of_run, sizes)
        p_root = ((counts + ADDED) / base)[codes]
        p_one = p_root.copy()
        at = word[which]
        p_one[use] = (in_all[which] + kinds[at] * p_root[use]) / (counts[at] + kinds[at])
        inside = np.zeros(len(codes), dtype=bool)
        inside[use] = state[at]
        p = np.where(inside, p_one, p_root)
        k = kinds_two[which_two]
        p_two = (c_two[which_two] + k * p_one[use_two]) / (in_all[pair[which_two]] + k)
        p[use_two] = np.where(state_two[which_two], p_two, p[use_two])
        starts = np.cumsum(n, dtype=np.int64) - n
        return pa.table(
            {
                "doc_id": batch.column("doc_id")[0].values,
                "held_out": batch.column("held_out")[0].values,
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": np.add.reduceat(counts[codes] > 0, starts, dtype=np.int64),
                "train_tokens": np.full(len(n), n_all, dtype=np.int64),
                "base_score": np.add.reduceat(np.log10(p_root), starts),
                "score": np.add.reduceat(np.log10(p), starts),
                "n_in_states": np.add.reduceat(inside, starts, dtype=np.int64),
            }
        )

    return _told(
        blocks, answers, score,
        "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, "
        "base_score DOUBLE, score DOUBLE, n_in_states BIGINT",
    )
