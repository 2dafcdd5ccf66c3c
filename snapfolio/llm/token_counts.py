"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

The counts of all prefixes come from one pass of dynamic programming. Of all tokens that end at a place, exactly one
ends the encoding of the prefix up to there: the one that can stand after the last token of the prefix it leaves. So
the last token and the number of tokens of a prefix follow from those of shorter ones, and nothing is encoded twice. Two
tokens can stand next to each other if their bytes together are encoded as just these two.

Once stored, the counts answer how many tokens a text or its first characters have, whether it is above a budget,
and where to cut it so that it fits (``fitting``), without encoding anything again.

The tokenizer splits texts by a pattern before it encodes. Where its parts begin is told from the characters' kinds, for a
batch at once; the kind of a character is asked of the tokenizer itself. Each distinct part is worked out once in a
batch, and remembered. A prefix may split otherwise than the whole text in three places, which are treated
apart: within white space that is followed by something else, within ``'re``, ``'ve`` and ``'ll``, and within the strings
of special tokens.

A null text counts as an empty one, which has no token. Rows without id and repeated rows are counted like any
other. A text is counted as a whole, however long it is, and has four bytes per character of counts; texts of
``BATCH_BYTES`` together or one longer text are in memory at once, with about 60 bytes per character. An empty table
gives no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.llm.words import slices

BATCH_BYTES = 2 << 20
#: Pairs of tokens that a Python worker remembers.
REMEMBERED = 2_000_000
#: Bytes beyond which a part is gone through by itself. No token may be longer.
LONG = 250

LETTER, NUMBER, SIGN, SPACE = 1, 2, 3, 4
# The endings that the vocabulary's pattern keeps with their apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")

DDL = "doc_id BIGINT, n_bytes BIGINT, counts ARRAY<INT>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("counts", pa.list_(pa.int32()))])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _check(described: dict) -> None:
    """Refuses a vocabulary whose rules are others than those that are followed here."""
    model, before = described["model"], described.get("pre_tokenizer") or {}
    followed = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(model.get(k) for k in ("byte_fallback", "ignore_merges"))
        and described.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
    )
    plain = not any(
        t[k] for t in described.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")
    )
    if not (followed and plain):
        raise ValueError("not a byte-level BPE vocabulary without normalizer")


class PrefixCounts:
    """Token counts of all prefixes by the vocabulary in a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        described = json.loads(whole.to_str())
        _check(described)
        self.model, self.splitter = whole.model, whole.pre_tokenizer
        self.special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        # The byte-level alphabet shows printable bytes as themselves, others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.strings: dict[int, str] = {}
        # The tokens' bytes as a tree: the child of a node by the next byte, 0 if none, and its token.
        edges: dict[tuple[int, int], int] = {}
        tokens = {}
        for text, token in described["model"]["vocab"].items():
            # A token that is never made, not even of its own bytes, ends nothing.
            if text in self.special or [t.id for t in self.model.tokenize(text)] != [token]:
                continue
            self.strings[token] = text
            node = 0
            for c in text:
                node = edges.setdefault((node, byte_of[c]), len(edges) + 1)
            tokens[node] = token
        self.children = np.zeros((len(edges) + 1, 256), dtype=np.int32)
        for (node, byte), child in edges.items():
            self.children[node, byte] = child
        self.token_of = np.full(len(edges) + 1, -1, dtype=np.int64)
        self.token_of[list(tokens)] = list(tokens.values())
        # The last one is no pair, and greater than all.
        self.pairs, self.fit = np.array([np.iinfo(np.int64).max]), np.array([False])
        self.kinds = np.zeros(0x110000, dtype=np.uint8)

    def _adjacent(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether tokens can follow each other. What was found out is kept, sorted by pair."""
        keys = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        new = np.unique(keys[self.pairs[at] != keys])
        if len(new):
            fit = []
            for key in new.tolist():
                pair = [key >> 32, key & 0xFFFFFFFF]
                both = self.model.tokenize(self.strings[pair[0]] + self.strings[pair[1]])
                fit.append([t.id for t in both] == pair)
            if len(self.pairs) > REMEMBERED:
                old = np.unique(keys)
                old = old[np.isin(old, self.pairs)]
                kept = np.append(np.searchsorted(self.pairs, old), len(self.pairs) - 1)
                self.pairs, self.fit = self.pairs[kept], self.fit[kept]
            places = np.searchsorted(self.pairs, new)
            self.pairs, self.fit = np.insert(self.pairs, places, new), np.insert(self.fit, places, fit)
            at = np.searchsorted(self.pairs, keys)
        return self.fit[at]

    def _tokens(
        self, raw: np.ndarray, at: np.ndarray, left: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens that begin at the places ``at`` and take no more bytes than are ``left``: where each begins,
        its size and its number."""
        node = np.zeros(len(at), dtype=np.int32)
        found, size = [], 0
        while len(at):
            node = self.children[node, raw[at + size]]
            size += 1
            token = self.token_of[node]
            hit = np.flatnonzero(token >= 0)
            found.append((at[hit], np.full(len(hit), size), token[hit]))
            more = np.flatnonzero((node > 0) & (left > size))
            at, node, left = at[more], node[more], left[more]
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _long(self, raw: list[int]) -> tuple[list[int], list[int]]:
        """The last token and the number of tokens up to each byte of one long part."""
        last, count = [-1] * len(raw), [0] * len(raw)
        children, token_of, seen = self.children, self.token_of, {}
        for start in range(len(raw)):
            node, before = 0, last[start - 1] if start else -1
            for end in range(start, len(raw)):
                node = int(children[node, raw[end]])
                if not node:
                    break
                token = int(token_of[node])
                if token >= 0 and last[end] < 0:
                    fits = start == 0 or seen.get((before, token))
                    if fits is None:
                        fits = seen[before, token] = bool(self._adjacent(np.array([before]), np.array([token]))[0])
                    if fits:
                        last[end], count[end] = token, (count[start - 1] if start else 0) + 1
        return last, count

    def of_parts(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the first 1, 2, ... characters of every part, and where those of each begin.

        All parts go forward together, a byte a step, but for those of more than ``LONG`` bytes.
        """
        sizes = np.asarray(pc.binary_length(parts), dtype=np.int64)
        _, offsets, data = parts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        step = (np.arange(len(raw)) - np.repeat(starts[:-1], sizes)).astype(np.int32)
        left = np.repeat(sizes, sizes) - step
        # Place x of these is after byte x; before a part's first byte there is no token.
        last = np.full(len(raw), -1, dtype=np.int64)
        count = np.zeros(len(raw), dtype=np.int32)
        for part in np.flatnonzero(sizes > LONG):
            own = slice(starts[part], starts[part + 1])
            last[own], count[own] = self._long(raw[own].tolist())
        short = np.flatnonzero(np.repeat(sizes <= LONG, sizes))
        begin, size, token = self._tokens(raw, short, left[short])
        end = begin + size - 1
        # By place in the part, longest first: the tokens before are known by then.
        key = (step[end] << 8 | 255 - size).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order])) + 1
        for now in np.split(order, bounds):
            now = now[last[end[now]] < 0]
            start, own = begin[now], token[now]
            fits = step[start] == 0
            within = np.flatnonzero(~fits)
            if len(within):
                fits[within] = self._adjacent(last[start[within] - 1], own[within])
            now, start, first = now[fits], start[fits], step[start[fits]] == 0
            last[end[now]] = own[fits]
            count[end[now]] = np.where(first, 0, count[start - 1]) + 1
        whole = np.append((raw[1:] & 0xC0) != 0x80, True)
        flat = count[whole]
        firsts = np.concatenate([[0], np.cumsum(whole)])[starts]
        apart = np.asarray(pc.is_in(parts, pa.array(["'" + e for e in LONG_ENDINGS], parts.type)))
        flat[firsts[:-1][apart] + 1] = 2
        return flat, firsts

    def _kind(self, point: int) -> int:
        """The kind of a character: what it makes one part with."""
        c = chr(point)
        for kind, fellow in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")):
            if len(self.splitter.pre_tokenize_str(fellow + c)) == 1:
                return kind
        return SPACE

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        new = np.unique(points[kinds == 0])
        if len(new):
            self.kinds[new] = [self._kind(int(p)) for p in new]
            kinds = self.kinds[points]
        return kinds

    def _begins(self, points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where parts begin. ``first`` marks the first character of every text."""
        n = len(points)
        last = np.append(first[1:], True)
        inside = ~first[1:]
        same = np.zeros(n, dtype=bool)  # as the character before
        same[1:] = (kinds[1:] == kinds[:-1]) & inside
        begins = ~same
        # The last blank before something else belongs to it, if it is an ordinary one.
        closing = np.zeros(n, dtype=bool)
        closing[:-1] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & inside
        begins |= closing
        blank = closing & (points == 32)
        begins[1:] &= ~blank[:-1]
        # An apostrophe that begins a part takes an ending of one or two letters with it.
        lone = np.flatnonzero((points == ord("'")) & begins & ~last)
        if len(lone):
            second = points[lone + 1]
            follows = ~last[lone + 1]
            third = np.where(follows, points[np.minimum(lone + 2, n - 1)], 0)
            size = np.isin(second, [ord(c) for c in SHORT_ENDINGS]).astype(np.int64)
            for ending in LONG_ENDINGS:
                size[(second == ord(ending[0])) & (third == ord(ending[1]))] = 2
            lone, size = lone[size > 0], size[size > 0]
            begins[lone + 1] = False
            after = lone + size + 1
            begins[after[after < n]] = True
        return begins

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all texts one after another, each from its empty prefix on, and where each begins.

        Texts here hold no special token.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        joined = "".join(texts)
        out = np.zeros(len(joined) + len(texts), dtype=np.int32)
        places = starts + np.arange(len(starts))
        if not joined:
            return out, places
        encoded = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kinds = self._kinds_of(points)
        first = np.zeros(len(points), dtype=bool)
        first[starts[:-1][sizes > 0]] = True
        begins = np.flatnonzero(self._begins(points, kinds, first))
        lengths = np.diff(np.append(begins, len(points)))
        codes, flat, part_starts = self._distinct(encoded, points, begins, begins + lengths)
        totals = flat[part_starts[1:] - 1]
        before = np.cumsum(totals[codes]) - totals[codes]
        # The first part of a text counts from nothing.
        opening = np.flatnonzero(first[begins])
        base = before - np.repeat(before[opening], np.diff(np.append(opening, len(begins))))
        within = np.arange(len(points)) - np.repeat(begins, lengths)
        values = np.repeat(base, lengths) + flat[np.repeat(part_starts[codes], lengths) + within]
        # A prefix that ends in white space has all of it in one part.
        run = np.zeros(len(points), dtype=bool)
        run[1:] = (kinds[1:] == SPACE) & (kinds[:-1] == SPACE) & ~first[1:]
        stop = run.copy()
        stop[:-1] &= (kinds[1:] != SPACE) & ~first[1:]
        stop[-1] = False
        ends = np.flatnonzero(stop)
        if len(ends):
            opens = np.flatnonzero((kinds == SPACE) & ~run)
            opens = opens[np.searchsorted(opens, ends, side="right") - 1]
            run_codes, of_run, run_starts = self._distinct(encoded, points, opens, ends + 1)
            run_totals = of_run[run_starts[1:] - 1]
            values[ends] = np.where(first[opens], 0, values[opens - 1]) + run_totals[run_codes]
        text_of_char = np.repeat(np.arange(len(texts)), sizes)
        out[np.arange(len(points)) + text_of_char + 1] = values
        return out, places

    def _distinct(
        self, encoded: bytes, points: np.ndarray, begins: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the distinct strings among some spans each span is, their counts one after another, and where
        those of each begin."""
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        spans = np.stack([at[begins], at[ends]], axis=1).reshape(-1)
        # Every other string is a span; those between are dropped.
        strings = pa.LargeStringArray.from_buffers(
            len(spans) - 1, pa.py_buffer(np.ascontiguousarray(spans)), pa.py_buffer(encoded)
        )
        found = strings.take(pa.array(np.arange(0, len(spans), 2))).dictionary_encode()
        return np.asarray(found.indices), *self.of_parts(found.dictionary)

    def of_text(self, text: str) -> np.ndarray:
        """The counts of one text that may hold special tokens.

        A text is ordinary up to the last character of a special token's string; with that, the string is one token.
        """
        segments, stops, start = [], [], 0
        while True:
            found = [(text.find(s, start), -len(s)) for s in self.special]
            found = [f for f in found if f[0] >= 0]
            if not found:
                break
            at, size = min(found)
            segments.append(text[start : at - size - 1])
            stops.append(at - start)
            start = at - size
        values, places = self.of_texts([*segments, text[start:]])
        out, base = [np.zeros(1, dtype=np.int32)], 0
        for stop, a, b in zip(stops, places[:-2], places[1:-1], strict=True):
            out.append(base + values[a + 1 : b])
            base += int(values[a + stop]) + 1
            out.append(np.array([base], dtype=np.int32))
        out.append(base + values[places[-2] + 1 :])
        return np.concatenate(out)

    def batch(self, texts: list[str]) -> pa.ListArray:
        """The counts of every text as a list."""
        plain = [not any(s in t for s in self.special) for t in texts]
        values, places = self.of_texts([t if p else "" for t, p in zip(texts, plain, strict=True)])
        if not all(plain):
            each = [values[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            each = [e if p else self.of_text(t) for e, p, t in zip(each, plain, texts, strict=True)]
            values = np.concatenate(each)
            places = np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values, pa.int32()))


_loaded: dict[str, PrefixCounts] = {}


def prefix_counter(path: str) -> PrefixCounts:
    if path not in _loaded:
        _loaded[path] = PrefixCounts(path)
    return _loaded[path]


def prefix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """``doc_id, n_bytes, counts`` of every row: ``counts[i]`` is the number of tokens of the first i characters.

    ``vocabulary`` is a file that every executor can open, by default the one installed with them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary or default_vocabulary())
        for whole in batches:
            for batch in slices(whole, "t", BATCH_BYTES):
                texts = [t or "" for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i"), batch.column("b"), counter.batch(texts)], schema=SCHEMA
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("i"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"),
        F.col(text_col).alias("t"),
    )
    return rows.mapInArrow(count, DDL)


def total(counts: Column) -> Column:
    """The number of tokens of a whole text."""
    return F.element_at(counts, -1).cast("long")


def count_of_first(counts: Column, chars: Column) -> Column:
    """The number of tokens of a text's first characters, or of all if it has fewer."""
    return F.element_at(counts, (F.least(chars, F.size(counts) - 1) + 1).cast("int")).cast("long")


def over_budget(counts: Column, budget: int) -> Column:
    return total(counts) > budget


def fitting(counts: Column, budget: int) -> Column:
    """The most characters from the start of a text that have no more than ``budget`` tokens.

    Counts can fall as a prefix grows (the end of a word may join what stood apart), so it is the
    last place within the budget, not the first one beyond it.
    """
    within = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(within).cast("long")
