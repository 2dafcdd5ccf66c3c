"""Clustering, fill-in-the-middle and token counts against brute force, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given as sampled
from hypothesis import settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapfolio.llm import clustering, fill_middle, graph, line_blocks, line_dedup, line_sketch, oracles, queries, token_counts
from snapfolio.sources import scratch
from tests.compare import connect, differences
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, empty, odd, prose


@pytest.mark.parametrize("name", ["op11_clustering", "op12_fill_middle"])
def test_queries_against_sql(spark, name):
    con = connect(SF_SMALL)
    assert differences(queries.queries()[name](spark, SF_SMALL), con, oracles.oracle_sql()[name]) is None


# --- clustering -----------------------------------------------------------------

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, x INT, p STRING, cluster INT"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "p", 2) for i, v in rows], VECTORS)


def blobs(n, centres=6, seed=3, width=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 64))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, 64)) * width


def lloyd(rows, k=40, rounds=5):
    """By definition, in Python's own whole numbers."""
    kept = [
        (i, [int(np.floor(float(np.float32(c)) * 256)) for c in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)
    ]
    draw = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in draw[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, nearest(v)) for i, v in kept]
    inertia = {}
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(
        (-1 if i is None else i, j, d, inertia[j], sum(inertia.values()), clustering.digest(centroids[j]))
        for i, (d, j) in found
    )


def clustered(df, **options):
    rows = clustering.clustered(df, **options).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


def test_clusters_by_definition_with_odd_vectors(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(blobs(150, width=0.4))]
    some = rows[7][1]
    rows += [
        (None, some), (7, some), (8, rows[9][1]), (200, some), (201, None), (202, []), (203, some[:63]),
        (204, [*some, 1.0]), (205, [None, *some[1:]]), (206, [float("nan"), *some[1:]]), (207, [float("inf"), *some[1:]]),
        (208, [0.0] * 64), (209, [-0.001] * 64), (None, None),
    ]
    assert clustered(vectors(spark, rows).repartition(5)) == lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(blobs(n))]
    assert clustered(vectors(spark, rows)) == lloyd(rows)


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [0.5] * 64) for i in range(60)] + [(i, [0.25 * (i % 3)] * 64) for i in range(60, 90)]
    assert clustered(vectors(spark, rows)) == lloyd(rows)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not fit into a long"):
        clustering.clustered(vectors(spark, [(1, [1e7] * 64)])).collect()


@settings(max_examples=30, deadline=None)
@sampled(seed=st.integers(0, 10_000), reach=st.sampled_from([1, 3, 300, clustering.MOST]))
def test_bounds_are_never_above_the_distance(seed, reach):
    rng = np.random.default_rng(seed)
    x, centroids, pivots = (rng.integers(-reach, reach + 1, (n, 64)) for n in (60, 11, 5))
    centroids[3], centroids[5], x[:11] = centroids[7], pivots[1], centroids
    pivots = clustering.spread(np.concatenate([pivots, pivots]), 5)
    nearest = clustering.Nearest(centroids, pivots)
    exact = clustering.squares(x, centroids)
    assert (nearest.bounds(clustering.squares(x, pivots)) <= exact).all()
    number, distance, _ = nearest(x, clustering.squares(x, pivots))
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_spare_most_of_the_work():
    x = np.floor(blobs(4000, centres=40) * 256).astype(np.int64)
    centroids = x[:40]
    pivots = clustering.spread(centroids, clustering.PIVOTS)
    _, _, measured = clustering.Nearest(centroids, pivots)(x, clustering.squares(x, pivots))
    assert measured < 4000 * 40 / 2


# --- fill in the middle -----------------------------------------------------------

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), output, text)


def rewritten(df):
    out = fill_middle.transformed(df)
    return [tuple(r) for r in out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()]


def test_forms_by_definition(spark):
    rng = random.Random(5)
    parts = ["ab", "c", " ", "é", "日本", "🙂", "\n", "\x00", "<", "<P", ">", "S>", "1", "Z", "é"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    texts += [(400, "<P>"), (401, "a<S>b"), (402, "<M><M>")]
    got = rewritten(documents(spark, texts))
    assert sorted(got) == sorted(by_hand(*t) for t in texts)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_on_odd_input(spark):
    df = odd(spark)
    expected = [by_hand(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(str, rewritten(df))) == sorted(map(str, expected))
    assert rewritten(empty(spark)) == []


def test_units_of_a_slice():
    texts = pa.array(["skip", None, "", "ab1é", "x"]).slice(1)
    assert fill_middle.units(texts).to_pylist() == [[], [], ["ab", "1", "é"], ["x"]]


# --- token counts -----------------------------------------------------------------

LIBRARY = Tokenizer.from_file(token_counts.default_vocabulary())
PIECES = [
    "a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'r", "'ll", "'LL", "'t", "12", "3", "½", "!", "?!", "é",
    "é", "日本", "🙂", " ", "　", " ", "\x1c", "\x85", "<|endoftext|>", "<|endof", "|>", "\x00", "ß", "़", "�",
]


def prefixes(text):
    return [len(LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def counts(texts):
    return token_counts.prefix_counter(token_counts.default_vocabulary()).batch(texts).to_pylist()


@settings(max_examples=60, deadline=None)
@sampled(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=12))
def test_every_prefix_has_the_count_of_the_library(texts):
    assert counts(texts) == [prefixes(t) for t in texts]


@settings(max_examples=60, deadline=None)
@sampled(st.text(max_size=30))
def test_any_characters(text):
    assert counts([text]) == [prefixes(text)]


def test_long_parts():
    texts = ["a" * 600, "ab" * 200 + " " * 500 + "c", "日本" * 120, "x" * 249 + "!", "=" * 251]
    assert counts(texts) == [prefixes(t) for t in texts]


def test_documents_have_the_library_counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op13_token_counts(spark, SF_SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(text.encode()), n, n > 1024)


def test_budgets_are_answered_from_counts(spark):
    texts = [(i, prose(i, 30)) for i in range(5)] + [(9, None), (10, " " * 40 + "it's <|endoftext|> over")]
    stored = token_counts.prefix_counts(documents(spark, texts))
    c = F.col("counts")
    asked = stored.select(
        "doc_id", token_counts.total(c), token_counts.fitting(c, 12), token_counts.count_of_first(c, F.lit(17)),
        token_counts.over_budget(c, 12),
    )
    for doc_id, total, fits, first, over in asked.collect():
        every = prefixes(dict(texts)[doc_id] or "")
        assert total == every[-1] and over == (total > 12)
        assert fits == max(i for i, n in enumerate(every) if n <= 12)
        assert first == every[min(17, len(every) - 1)]


def test_token_counts_on_odd_input(spark):
    df = odd(spark)
    expected = [(r["doc_id"], prefixes(r["text"] or "")) for r in df.filter("doc_id <> 7 OR doc_id IS NULL").collect()]
    got = token_counts.prefix_counts(df).select("doc_id", "counts").collect()
    assert sorted(str((i, c)) for i, c in got if i != 7) == sorted(map(str, expected))
    long = next(r["text"] for r in df.collect() if r["doc_id"] == 7)
    assert next(c for i, c in got if i == 7)[-1] == len(LIBRARY.encode(long, add_special_tokens=False).ids)
    assert token_counts.prefix_counts(empty(spark)).collect() == []


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))


# --- line dedup -------------------------------------------------------------------


def _similar(spark, norm):
    """All pairs of lines within a tenth of edits. Lines whose letters differ by more than these are told apart first."""
    sizes = np.array([len(x) for x in norm])
    letters = np.zeros((len(norm), 128), dtype=np.int16)
    for i, x in enumerate(norm):
        for c in x:
            letters[i, ord(c) % 128] += 1
    found = []
    for i in range(len(norm) - 1):
        most = np.maximum(sizes[i + 1 :], sizes[i]) // 10
        apart = np.abs(letters[i + 1 :] - letters[i]).sum(axis=1)
        found += [(i, i + 1 + int(j)) for j in np.flatnonzero((apart <= 2 * most) & (abs(sizes[i + 1 :] - sizes[i]) <= most))]
    pairs = spark.createDataFrame([(i, j, norm[i], norm[j]) for i, j in found], "i INT, j INT, a STRING, b STRING")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) / 10).cast("int")
    near = pairs.repartition(16).filter(F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0)
    return [(r["i"], r["j"]) for r in near.select("i", "j").collect()]


def _lines(spark, folder):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    norm = sorted(set(line_sketch.normalised(pa.array([x for t in texts for x in t.split("\n")])).to_pylist()))
    return [x for x in norm if x.count(" ") >= 4 or len(x) >= 20]


def test_blocks_are_shared_by_similar_lines(spark):
    """Against all pairs of lines of a table, and lines of any length with a word replaced."""
    norm = _lines(spark, SF_SMALL)
    near = _similar(spark, norm)
    buckets = [set(b) for b in line_sketch.blocks(pa.array(norm)).to_pylist()]
    assert len(near) > 20
    assert sum(bool(buckets[a] & buckets[b]) for a, b in near) >= 0.9 * len(near)
    rng, pairs = random.Random(3), []
    for n in range(5, 120):
        words = prose(7 * n, n).split()
        at = rng.randrange(n)
        pairs.append((" ".join(words), " ".join([*words[:at], "zzz", *words[at + 1 :]])))
    one, other = (line_sketch.blocks(pa.array(x)).to_pylist() for x in zip(*pairs, strict=True))
    assert sum(bool(set(a) & set(b)) for a, b in zip(one, other, strict=True)) >= 0.97 * len(pairs)


def test_bitmaps_never_rule_out_similar_lines():
    rng = random.Random(11)
    for _ in range(300):
        line = prose(rng.randrange(10_000), rng.randrange(5, 60))
        edits = max(1, len(line) // 10)
        changed = list(line)
        for _ in range(rng.randint(1, edits)):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["q"], [changed[at], "é"]])
        one, other = line_sketch.parities(pa.array([line, "".join(changed)])).view(np.uint64)
        assert sum(int(x).bit_count() for x in one ^ other) <= 4 * edits


def test_lines_with_clashing_columns_and_odd_texts(spark):
    names = ["_hash", "_gone", "_n_removed", "row", "id", "place", "places", "text_hash", "node", "a.b`c"]
    ddl = "doc_id BIGINT, text STRING, " + ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names)
    copied = "a line of several words that comes again"
    texts = [(1, copied), (2, f"first\n{copied}"), (None, copied), (3, None), (4, ""), (2, f"first\n{copied}")]
    docs = spark.createDataFrame([(i, t, *names) for i, t in texts], ddl)
    out = line_dedup.dedup_lines(docs, wide=True)
    assert out.columns == [c for c in docs.columns if c != "_n_removed"] + ["_n_lines", "_n_removed"]
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in names if c != "_n_removed")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["_n_lines"], r["_n_removed"]) for r in rows)
    assert got == [
        ("1", "", 1, 1), ("2", "first", 2, 1), ("2", "first", 2, 1), ("3", "None", 0, 0), ("4", "", 1, 0), ("None", copied, 1, 0),
    ]
    for odd_docs in (odd(spark), empty(spark)):
        kept = line_dedup.dedup_lines(odd_docs, wide=True)
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


def test_a_text_of_very_many_lines(spark):
    lines = [f"{i} {prose(i % 50, 6)}" for i in range(100_000)] * 2
    out = line_sketch.left_lines(pd.Series(["\n".join(lines)]), pd.Series([list(range(100_000, 200_000))]))
    assert out[0] == "\n".join(lines[:100_000])


def test_lines_are_deduplicated_without_python(spark, monkeypatch):
    """Of all tables written on the way, and of the result."""
    plans = []
    write = scratch.written

    def told(df, name, **options):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name, **options)

    for module in (line_dedup, graph):
        monkeypatch.setattr(module, "written", told)
    # The last comparison goes by slices.
    monkeypatch.setattr(graph, "WHOLE_ROWS", -1)
    lines = [prose(k // 3, 12) + " " + "abc"[k % 3] for k in range(60)]
    out = line_dedup.dedup_lines(documents(spark, list(enumerate(lines))), wide=True)
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 10 and not [p for p in plans if re.search("Python|Pandas|Arrow", p)]
    assert sum(r["text"] == "" for r in out.collect()) == 40


def test_simhash_of_spark_functions(spark):
    """Against the counts of every bit."""
    rng = random.Random(7)
    runs = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in [*range(1, 64), 2, 2, 4]]
    runs[-1] = [5, 5, -1, 0]
    rows = spark.createDataFrame([(r,) for r in runs], "v ARRAY<BIGINT>")
    got = [r[0] for r in rows.select(line_blocks.simhash(F.col("v"), F.size("v"))).collect()]
    for run, simhash in zip(runs, got, strict=True):
        wanted = sum((2 * sum(x >> i & 1 for x in run) > len(run)) << i for i in range(64))
        assert simhash % (1 << 64) == wanted


def test_blocks_of_spark_functions_are_shared_by_similar_lines(spark):
    """As often as those of the Arrow form, against all pairs of lines and words replaced; and as many as those."""
    norm = _lines(spark, SF_SMALL)
    near = _similar(spark, norm)
    rng, pairs = random.Random(3), []
    for n in range(5, 120):
        words = prose(7 * n, n).split()
        at = rng.randrange(n)
        pairs.append((" ".join(words), " ".join([*words[:at], "zzz", *words[at + 1 :]])))
    every = [*norm, *[x for pair in pairs for x in pair]]
    rows = spark.createDataFrame(list(enumerate(every)), "i INT, x STRING").select("i", line_blocks.blocks(F.col("x")))
    buckets = [set(r[1]) for r in sorted(rows.collect())]
    assert sum(bool(buckets[a] & buckets[b]) for a, b in near) >= 0.9 * len(near)
    changed = buckets[len(norm) :]
    assert sum(bool(a & b) for a, b in zip(changed[::2], changed[1::2], strict=True)) >= 0.97 * len(pairs)
    arrow = sum(len(b) for b in line_sketch.blocks(pa.array(every)).to_pylist())
    assert 0.95 * arrow < sum(len(b) for b in buckets) < 1.05 * arrow


def test_bitmaps_of_spark_functions_never_rule_out_similar_lines(spark):
    rng, lines, most = random.Random(11), [], []
    for _ in range(150):
        line = prose(rng.randrange(10_000), rng.randrange(5, 60))
        edits = max(1, len(line) // 10)
        changed = list(line)
        for _ in range(rng.randint(1, edits)):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["q"], [changed[at], "é"], ["🙂"]])
        lines += [line, "".join(changed)]
        most.append(4 * edits)
    rows = spark.createDataFrame([*enumerate(lines), (len(lines), "x")], "node BIGINT, norm STRING")
    found = {r["node"]: [v % (1 << 64) for v in r[1:]] for r in line_blocks.parities(rows).collect()}
    assert len(found) == len(lines) + 1 and not any(found[len(lines)])
    for k, limit in enumerate(most):
        assert sum((a ^ b).bit_count() for a, b in zip(found[2 * k], found[2 * k + 1], strict=True)) <= limit
    odd = sum(v.bit_count() for v in found[0])
    pairs = collections.Counter(zip(lines[0], lines[0][1:], strict=False))
    assert 0 < odd <= sum(n % 2 for n in pairs.values())


def test_lines_left_of_a_text_of_very_many(spark):
    lines = [f"{i} {prose(i % 50, 6)}" for i in range(100_000)] * 2
    rows = [("\n".join(lines), list(range(100_000, 200_000))), ("a\n\nb\n", [0]), ("a", [0]), ("\n", [5])]
    docs = spark.createDataFrame(rows, "text STRING, gone ARRAY<INT>").coalesce(1)
    out = [r[0] for r in docs.select(line_blocks.left_lines(F.col("text"), F.col("gone"))).collect()]
    assert out == ["\n".join(lines[:100_000]), "\nb\n", "", "\n"]


def test_a_line_of_very_many_words(spark):
    line = " ".join(f"w{i}" for i in range(200_000))
    rows = spark.createDataFrame([(line,)], "x STRING").select(F.size(line_blocks.blocks(F.col("x"))))
    assert rows.first()[0] > 30_000


def test_lines_are_similar_by_their_edit_distance(spark):
    """Without the words at both ends and word by word as by Spark's function over whole lines."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    pairs = [("a", "a"), ("a", "b"), ("x y", "x z y"), ("x x", "x x x"), ("a b", "ab"), ("漢字かな", "漢字カな"), ("a b c", "b c a"), ("a", "a b")]
    for _ in range(400):
        line = [word() for _ in range(rng.randint(1, 25))]
        other = list(line)
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(other)), rng.random()
            other[at : at + 1] = [word()] if kind < 0.5 else [word(), other[at]] if kind < 0.75 else []
            other = other or ["a"]
        pairs.append((" ".join(line), " ".join(other)))
    rows = spark.createDataFrame(pairs, "a STRING, b STRING").withColumn("most", F.explode(F.array(*map(F.lit, (0, 1, 3, 6, 12)))))
    got = rows.select(
        (F.levenshtein("a", "b") <= F.col("most")).alias("wanted"), line_blocks.within(F.col("a"), F.col("b"), F.col("most")).alias("got")
    ).collect()
    assert all(r["got"] == r["wanted"] for r in got) and {r["got"] for r in got} == {True, False}
    long = [word() for _ in range(60_000)]
    pair = [(" ".join(long), " ".join([*long[:30_000], "other", *long[30_001:59_999], "end"]))]
    # All of both lines would be 180,000 letters in a band of 36,000.
    most = F.floor(F.length("a") / 10).cast("int")
    assert spark.createDataFrame(pair, "a STRING, b STRING").select(line_blocks.within(F.col("a"), F.col("b"), most)).first()[0]
