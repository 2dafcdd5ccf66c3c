"""The operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date
from functools import lru_cache
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapfolio.llm import (
    decontaminate,
    graph,
    langid,
    licenses,
    line_dedup,
    minhash,
    oracles,
    packing,
    quality_rank,
    quality_rules,
    queries,
    suffix_tree,
    warc,
)
from snapfolio.sources import scratch
from snapfolio.sources.scratch import new_folder
from tests.compare import connect, differences
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, empty, odd, prose


def given(spark, name="documents"):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


def words(text):
    return (text or "").encode().lower().split()


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    con = connect(SF_SMALL)
    assert differences(queries.queries()[name](spark, SF_SMALL), con, oracles.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


# 1


def test_suffix_tree_base_scores(spark):
    docs = given(spark)
    texts = dict(docs.select("doc_id", "text").collect())
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    rows = suffix_tree.scored(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["train_tokens"]) == (len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_by_hand(spark):
    """All states and scores of a small corpus, step by step."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:60]
    pattern = ["a b c", "a b c x", "q b d", "q b d y", "z b c"]
    texts = {i: pattern[k % 5] for k, i in enumerate(ids)}
    often, least = 3, 0.02
    rows = suffix_tree.scored(documents(spark, list(texts.items())), least_count=often, least_divergence=least).collect()
    tokens = {i: [*t.split(), None] for i, t in texts.items()}
    one = Counter(w for t in tokens.values() for w in t)
    n, v = sum(one.values()), len(one)
    after = defaultdict(Counter)
    for t in tokens.values():
        for k, w in enumerate(t):
            for size in (1, 2):
                context = tuple(t[max(0, k - size) : k])
                if len(context) == size and all(one[c] >= often for c in context):
                    after[context][w] += 1
    root = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in one.items()}
    pairs = {c for c in after if len(c) == 2 and after[(c[0],)][c[1]] >= often}

    def p(context, w):
        if not context:
            return root[w]
        total, kinds = sum(after[context].values()), len(after[context])
        return (after[context][w] + kinds * p(context[1:], w)) / (total + kinds)

    states = set()
    for context in [*(c for c in after if len(c) == 1), *pairs]:
        total, kinds, gain = sum(after[context].values()), len(after[context]), 0.0
        for w, c in after[context].items():
            k = kinds - (c == 1)
            q = p(context[1:], w)
            gain += c * math.log((c - 1 + k * q) / (total - 1 + k) / q) if total > 1 else 0
        if gain >= least * total:
            states |= {context, context[1:]} - {()}
    assert any(len(s) == 2 for s in states) and len(states) > 2
    for r in rows:
        t, score = tokens[r["doc_id"]], 0.0
        for k, w in enumerate(t):
            held = next((tuple(t[k - s : k]) for s in (2, 1) if k >= s and tuple(t[k - s : k]) in states), ())
            value = root[w]
            for s in range(1, len(held) + 1):
                if held[-s:] in states:
                    context = held[-s:]
                    total, kinds = sum(after[context].values()), len(after[context])
                    value = (after[context][w] + kinds * value) / (total + kinds)
            score += math.log10(value)
        assert r["score"] == pytest.approx(score)


def test_suffix_tree_split_contexts(spark):
    """Contexts dealt onto several shards by their tokens, over several blocks, give the same scores."""
    texts = [(i, prose(i, 300)) for i in range(60)] + [(60, None), (61, ""), (62, "the")]
    docs = documents(spark, texts).repartition(5, "doc_id")

    def scores(**more):
        rows = suffix_tree.scored(docs, least_count=5, least_divergence=0.001, **more).collect()
        return {r["doc_id"]: r for r in rows}

    whole, split = scores(), scores(split=20)
    assert whole.keys() == split.keys() and sum(r["n_in_states"] for r in whole.values()) > 1000
    for k, r in whole.items():
        assert r["n_in_states"] == split[k]["n_in_states"]
        assert r["score"] == pytest.approx(split[k]["score"], rel=1e-12)


def test_suffix_tree_sends_packed_rows(spark, monkeypatch):
    """What blocks send, and what they are told, is a row per block and shard, not per (context, token)."""
    rows_of = defaultdict(list)

    def kept(df, name, **options):
        out = scratch.written(df, name, **options)
        rows_of[name].append(out.count())
        return out

    monkeypatch.setattr(suffix_tree, "written", kept)
    docs = documents(spark, [(i, prose(i, 2000)) for i in range(40)]).coalesce(1)
    rows = suffix_tree.scored(docs, least_count=5).collect()
    assert sum(r["n_in_states"] for r in rows) > 1000
    # A row for the block and one for the states, of two words at most, of each shard.
    assert len(rows_of["summed"]) == 2 and max(rows_of["summed"]) <= 2 * suffix_tree.FEWEST_SHARDS


def test_suffix_tree_packs_any_longs():
    arrays = [np.array([0, -1, 2**63 - 1, -(2**63)]), np.zeros(0, dtype=np.int64), np.arange(70_000)]
    assert all((a == b).all() for a, b in zip(arrays, suffix_tree._unpack(suffix_tree._pack(*arrays)), strict=True))


# 2


def test_packing_tokens_and_places(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    extra = ["It's 3 o'clock, I'LL go!!  x y", "ÉCOLE Straße ²½ ª × ÷ \x1c", "é É", "日本 <|endoftext|> ok", "a\x00b"]
    extra += ["hello<|endoftext|>world", "<|startoftext|> a <|endoftext|>", "<|endoftext|>", "<|ENDOFTEXT|> <|endof text|>"]
    docs = given(spark).select("doc_id", "text").union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id BIGINT, text STRING")
    )
    texts = dict(docs.collect())
    rows = packing.packed(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096))
        assert all(r["length"] == 4096 for r in own[:-1])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 4096
    assert len(by_sequence) <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_ids_of_other_vocabularies():
    """One that is not split as it is by default goes through the whole tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's  two words", None, "", "é <|endoftext|>x", "plain"]
    ids, starts = packing.token_ids(pa.array(texts), path)
    whole = Tokenizer.from_file(path)
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == expected


def test_plan_places_everything_once():
    rng = np.random.default_rng(1)
    for capacity in (10, 97):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, 40), rng.integers(1, 50, 40), strict=True)}
        runs = sorted(packing.plan(counts, capacity))
        used = defaultdict(set)
        for k, (n, first, sequence, per, offset) in enumerate(runs):
            last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
            for i in range(last - first):
                at = offset + i % per * n
                place = set(range(at, at + n))
                assert not used[sequence + i // per] & place
                used[sequence + i // per] |= place
        assert sum(map(len, used.values())) == sum(n * c for n, c in counts.items())
        assert all(max(s) < capacity and len(s) == max(s) + 1 for s in used.values())


# 3


def _least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontaminate_against_every_alignment(spark):
    items = [(k, prose(100 + k, 20)) for k in range(4)]
    rng = np.random.default_rng(5)
    texts = []
    for k in range(30):
        item = list(items[k % 4][1])
        for _ in range(k % 12):
            item[rng.integers(len(item))] = "#"
        texts.append((k, f"{prose(200 + k, 15)}\n{''.join(item).upper()} {prose(300 + k, 5)}"))
    texts.append((99, prose(7, 60)))
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    docs = documents(spark, texts)
    found = {(r["doc_id"], r["item_id"]): r["segments"] for r in decontaminate.leaks(docs, bench).collect()}
    index = decontaminate.build_index(items)
    wanted = Counter()
    for i, t in texts:
        for s, item in enumerate(index.items):
            m = index.lengths[s]
            pattern = "".join(map(chr, index.points[s][:m]))
            if _least_edits(pattern, decontaminate.normalised(t)) <= index.budgets[s]:
                wanted[(i, item)] += 1
    assert found == dict(wanted) and len(wanted) > 20
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in wanted}


def test_decontaminate_excerpts_at_every_offset(spark):
    item = decontaminate.normalised(prose(100, 60))
    excerpts = [(k, f"zq {item[k : k + 60]} vx {prose(400 + k, 6)}") for k in range(len(item) - 59)]
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    found = {r["doc_id"] for r in decontaminate.leaks(documents(spark, excerpts), bench).collect()}
    assert found == {k for k, _ in excerpts} and len(found) > 100


def test_decontaminate_short_items(spark):
    """Items of 16 to 23 characters are held whole and between other words, or not at all."""
    items = [(1, "Quartz vow, 9 jugs b"), (2, "sixteen of chars"), (3, "fifteen of char")]
    assert [len(t) for _, t in items] == [20, 16, 15]
    texts = [
        (1, "They say: quartz  VOW, 9 jugs b."), (2, "quartz vow, 9 jugs b"), (3, "aquartz vow, 9 jugs b"),
        (4, "quartz vow, 9 jugs by"), (5, "quartz vow, 8 jugs b"), (6, "a sixteen of chars, so"), (7, "fifteen of char"),
        (8, "sixteen of charsixteen of chars"), (9, "quartz vow, 9 jugs by quartz vow, 9 jugs b"),
    ]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 2), (9, 1)}


def test_decontaminate_blocks(spark, monkeypatch):
    items = [(k, prose(100 + k, 20)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    docs = documents(spark, [(k, f"x {t} y") for k, t in items])
    whole = sorted(decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    assert sorted(decontaminate.leaks(docs, bench).collect()) == whole and len(whole) >= 6


# 4


def _simhash(line, hashes):
    found = set(line.split(" "))
    counts = [sum(hashes[w] >> b & 1 for w in found) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(found))


def test_lines_against_all_pairs(spark):
    base = [prose(k, 30) for k in range(12)]
    near = [b.replace("river", "rivers", 1) + "." for b in base]
    lines = [*base, *near, *base[:5], "short one", "short one", base[0].upper() + "  "]
    texts = [(k, "\n".join(lines[k::9])) for k in range(9)]
    docs = documents(spark, texts)
    norm = {l: " ".join(l.lower().split()) for l in lines}
    distinct = sorted({n for n in norm.values() if len(n.split()) >= 5})
    vocabulary = sorted({w for n in distinct for w in n.split(" ")})
    hashed = spark.createDataFrame([(w,) for w in vocabulary], "w STRING").select("w", F.xxhash64("w")).collect()
    hashes = {w: h % (1 << 64) for w, h in hashed}
    simhashes = {n: _simhash(n, hashes) for n in distinct}
    con = duckdb.connect()
    links = []
    for a, b in combinations(distinct, 2):
        edits = con.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]
        if (simhashes[a] ^ simhashes[b]).bit_count() <= 3 and 10 * edits <= max(len(a), len(b)):
            links.append((a, b))
    classes = closure(distinct, links)
    hash_of = {r["t"]: r["h"] for r in docs.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    seen, wanted = set(), {}
    for i, t in sorted(texts, key=lambda x: (x[0], hash_of[x[1]])):
        kept = []
        for line in t.split("\n"):
            c = classes.get(norm[line])
            if c is None or c not in seen:
                kept.append(line)
            seen.add(c) if c is not None else None
        wanted[i] = "\n".join(kept)
    out = line_dedup.dedup_lines(docs)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == wanted
    assert out.select(docs.columns).columns == docs.columns and links


def test_wide_search_links_by_edit_distance_alone(spark):
    """Lines with a word replaced, with and without blanks, against the edit distances of all pairs."""
    texts = [prose(100 + k, 8 + 2 * k) for k in range(14)]
    lines = []
    for k, text in enumerate(texts):
        at = text.split()
        at[k % len(at)] = at[k % len(at)][::-1]
        lines += [text, " ".join(at)]
    letters = ["".join(chr(0x4E00 + (7919 * (k + 1) * (i + 3) ** 2) % 6000) for i in range(60)) for k in range(4)]
    # Blanks let these lines take part whatever their script.
    letters = [" ".join(x[i : i + 12] for i in range(0, 60, 12)).replace(" ", "\u3002 ") for x in letters]
    lines += [*letters, *[x.replace(x[5], "\u4e00").replace(x[30], "\u4e01") for x in letters]]
    con = duckdb.connect()
    near = [
        (a, b)
        for a, b in combinations(lines, 2)
        if 10 * con.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= max(len(a), len(b))
    ]
    classes = closure(lines, near)
    assert len(near) >= 12
    seen, wanted = set(), {}
    for i, line in enumerate(lines):
        wanted[i] = "" if classes[line] in seen else line
        seen.add(classes[line])
    docs = documents(spark, list(enumerate(lines)))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, wide=True).collect()} == wanted
    # Fewer lines are within the radius of SimHash.
    assert sum(r["text"] == "" for r in line_dedup.dedup_lines(docs).collect()) < len(lines) - len(seen)


def test_copies_of_short_lines_and_of_lines_without_blanks(spark):
    passage = "".join(chr(0x3041 + (31 * i * i) % 80) for i in range(70))
    changed = passage[:40] + "\u4e00" + passage[41:]
    texts = [
        (1, f"All rights reserved.\n\npage 12\n{passage}"), (2, f"all  rights reserved. \n\npage 13\n{passage}"),
        (3, f"{changed}\n\n日本\npage 12"), (4, "日本"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, texts), wide=True).collect()}
    assert got == {1: texts[0][1], 2: "\npage 13", 3: "\n日本", 4: ""}


# 5


def test_warc_is_deterministic_and_whole(spark):
    big = "<p>ü</p>" * 300
    rows = [(k, f"http://x/{k}", big if k % 3 == 0 else f"page {k}") for k in range(30)]
    rows += [(None, None, None), (100, "a b\nc", None), (101, "u", ""), (27, "http://x/27", big)]
    # The newest of some copies has several addresses.
    rows += [(27, f"http://x/{k}", big) for k in "cab"]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("digest", F.lit("x"))
    lists = []
    for n in (1, 7):
        folder = new_folder(spark, "test-warc")
        manifest = warc.write_archives(pages.repartition(n), folder, shard_bytes=5_000, roll_bytes=2_000)
        lists.append(sorted(map(tuple, manifest.collect())))
    assert lists[0] == lists[1] and len(lists[0]) > 3
    read = warc.read_archives(spark, folder).collect()
    assert len(read) == len(rows) and all(r["intact"] for r in read)
    assert len({r["record_id"] for r in read}) == len(rows)
    payloads = {i: (h or "").encode() for i, _, h in rows}
    for r in read:
        payload = payloads[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        again = len(payload) >= 1000 and r["page_id"] != 27
        assert (r["record_type"], r["refers_to"]) == (("revisit", 27) if again else ("response", None))
        assert (r["payload"] is None) == again


# 6


def test_policies_and_ablations(spark):
    entries = quality_rules.ledger(given(spark))
    rows = entries.collect()
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(entries, 2).collect()}
    for k, rule in enumerate(quality_rules.RULES):
        failed = sum(r["failed"] >> k & 1 for r in rows)
        assert found.get(rule, (0, 0)) == (failed, sum(r["failed"] == 1 << k for r in rows))


# 7


def test_minhash_against_all_pairs(spark):
    docs = given(spark).select("doc_id", "text")
    near = [(1000 + k, " ".join([*prose(k, 120).split()[: 120 - 3 * k], *prose(50 + k, 3 * k).split()])) for k in range(6) for _ in (0,)]
    copies = [(2000 + k, prose(k % 6, 120)) for k in range(20)]
    docs = docs.union(spark.createDataFrame([*near, *copies], "doc_id BIGINT, text STRING"))
    sets = {}
    for i, t in docs.collect():
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    wanted = closure(sets, links)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(sets)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_links_rows_without_id(spark):
    text = prose(7, 200).split()
    near = [" ".join([*text[:k], "changed", *text[k + 1 :]]) for k in (50, 120, 199)]
    other = prose(8, 200).split()
    docs = documents(
        spark,
        [(None, near[0]), (None, near[1]), (5, near[2]), (9, " ".join(other)), (None, " ".join(other[:-1]))],
    )
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == {(None, 5, False): 2, (5, 5, True): 1, (9, 9, True): 1, (None, 9, False): 1}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(159, 161)]
    got = dict(graph.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect())
    assert got == closure({x for l in links for x in l}, links)


def test_components_of_trees_and_of_groups_joined(spark):
    """A round has a row per node, and only the groups that links join are looked at again."""
    trees = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(150, 300)]
    links = spark.createDataFrame(trees, "a BIGINT, b BIGINT")
    groups = graph.rooted(links)
    assert dict(groups.collect()) == closure({x for l in trees for x in l}, trees)
    more = [(120, 250), (7, 8), (8, 140), (900, 901), (100, 160)]
    got = graph.joined(groups, spark.createDataFrame(more, "a BIGINT, b BIGINT")).collect()
    wanted = closure({x for l in trees + more for x in l}, trees + more)
    assert len(got) == len(wanted) and dict(got) == wanted
    assert graph.joined(groups, links.limit(0)) is groups
    assert graph.rooted(links.limit(0)).isEmpty()


def test_minhash_does_not_shuffle_texts(spark, monkeypatch):
    plans = {}

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return scratch.written(df, name, **options)

    monkeypatch.setattr(minhash, "written", seen)
    docs = documents(spark, [(k, prose(k // 2, 60)) for k in range(20)])
    assert sum(r["kept"] for r in minhash.near_duplicates(docs).collect()) == 10
    assert "strategy=broadcast" in plans["sets"]


# 8


def test_licences_are_found_and_inherited(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = [
        ("a/LICENSE", apache), ("a/b/x.py", prose(1)), ("a/b/c/y.py", f"{prose(2)}\n# {mit.upper()}\n{prose(3)}"),
        ("a/b/LICENSE", mit), ("a/b/c/z.py", prose(4)), ("top.py", prose(5)), ("q/w.py", None), (None, mit),
        ("a/e.py", ""), ("a/b/c/z.py", prose(4)), ("r/under.py", "licensed work under the version of this"),
    ]
    df = spark.createDataFrame(files, "path STRING, text STRING").withColumn("line", F.lit(7))
    got = {(r["path"], r["license"], r["line"], r["inherited_from"]) for r in licenses.license_scan(df).collect()}
    assert got == {
        ("a/LICENSE", "Apache-2.0", -1, None), ("a/b/LICENSE", "MIT", -1, None), ("a/b/x.py", "MIT", None, "a/b"),
        ("a/b/c/y.py", "MIT", 1, None), ("a/b/c/z.py", "MIT", None, "a/b"), ("top.py", None, None, None),
        ("q/w.py", None, None, None), (None, "MIT", -1, None), ("a/e.py", "Apache-2.0", None, "a"),
        ("r/under.py", None, None, None),
    }
    assert licenses.license_scan(df).count() == len(files)


MIT = """MIT License

Copyright (c) 2024 Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
TITLE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""


def test_full_licence_texts_are_inherited(spark):
    """Files with whole licence texts, amid long other text, speak for their directories by their names."""
    long = "\n".join(prose(k, 12) for k in range(40))
    header = "# Licensed under the Apache\n# License, Version 2.0. x\nimport os\n" + prose(3)
    files = [
        ("m/LICENSE", MIT + long), ("m/a.py", prose(1)), ("b3/LICENSE.txt", BSD + THIRD + long), ("b3/x/y/a.py", prose(2)),
        ("b2/COPYING", BSD + long), ("b2/a.py", ""), ("ap/licence.md", TITLE + long), ("ap/a.py", prose(4)),
        ("h/a.py", header), ("h/b.py", prose(5)), ("n/notes.txt", MIT + long), ("n/a.py", prose(6)), ("e/LICENSE", ""),
        ("e/a.py", "x"),
    ]
    df = spark.createDataFrame(files, "path STRING, text STRING")
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in licenses.license_scan(df).collect()}
    assert got == {
        "m/LICENSE": ("MIT", None), "m/a.py": ("MIT", "m"), "b3/LICENSE.txt": ("BSD-3-Clause", None),
        "b3/x/y/a.py": ("BSD-3-Clause", "b3"), "b2/COPYING": ("BSD-2-Clause", None), "b2/a.py": ("BSD-2-Clause", "b2"),
        "ap/licence.md": ("Apache-2.0", None), "ap/a.py": ("Apache-2.0", "ap"), "h/a.py": ("Apache-2.0", None),
        "h/b.py": (None, None), "n/notes.txt": ("MIT", None), "n/a.py": (None, None), "e/LICENSE": (None, None),
        "e/a.py": (None, None),
    }


def test_licence_lines_against_every_cosine(spark):
    docs = given(spark).withColumn("path", F.col("doc_id").cast("string"))
    texts = {str(i): t for i, t in docs.select("doc_id", "text").collect()}
    idf, other = licenses._weights(docs.select("text"), licenses.NOTICES)
    wanted = {}
    import regex

    for path, text in texts.items():
        best = []
        lines = text.split("\n")
        blocks = [(k, lines[k : k + m]) for m in (1, 2, 3, 4) for k in range(len(lines) - m + 1)]
        has_words = [bool(regex.search(r"[\p{L}\p{N}]", x)) for x in lines]
        blocks = [(k, "\n".join(b)) for k, b in blocks if has_words[k] and has_words[k + len(b) - 1]]
        for k, line in [(-1, text), *blocks]:
            tf = Counter(w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w)
            norm = math.sqrt(sum((c * idf.get(w, other)) ** 2 for w, c in tf.items()))
            for name, notice in licenses.NOTICES:
                vector = licenses._vector(notice, idf)
                dot = sum(tf[w] * idf[w] * x for w, x in vector.items())
                cosine = dot / norm / math.sqrt(sum(x * x for x in vector.values())) if norm else 0
                if cosine >= 0.6:
                    best.append((name in licenses.GENERAL, -round(cosine, 9), name, k))
        wanted[path] = min(best)[2:] if best else (None, None)
    got = {r["path"]: (r["license"], r["line"]) for r in licenses.license_scan(docs).collect()}
    assert got == wanted and sum(v[0] is not None for v in wanted.values()) >= 3


# 9 and 10


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_sums_equal_bundles():
    texts = ["ab cab", "bca"]
    grams, letters, which, owner = langid._grams(texts)
    vectors = langid._vectors_by_letter(letters)
    bound = langid._bound(grams, vectors)
    for i, text in enumerate(texts):
        padded, total = f" {text} ", np.zeros(langid.DIMENSIONS)
        for k in range(len(padded) - 2):
            one = np.ones(langid.DIMENSIONS)
            for p, c in enumerate(padded[k : k + 3]):
                one *= np.roll(langid._vector(ord(c)), 2 - p)
            total += one
        assert np.array_equal(bound[which[owner == i]].sum(axis=0), total)


def test_languages_against_every_cosine(spark):
    """Predictions are the prototypes of greatest cosine, all vectors bundled by definition."""
    rows = given(spark).select("doc_id", "text", "lang").orderBy("doc_id").limit(120).collect()
    letter, bound = lru_cache(None)(lambda c: langid._vector(ord(c)).astype(np.float64)), {}

    def bundle(text):
        total = np.zeros(langid.DIMENSIONS)
        plain = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        plain = re.sub(" +", " ", plain)
        for gram, n in Counter(plain[k : k + 3] for k in range(len(plain) - 2)).items():
            if gram not in bound:
                bound[gram] = np.prod([np.roll(letter(c), 2 - p) for p, c in enumerate(gram)], axis=0)
            total += n * bound[gram]
        return total

    vectors = {r["doc_id"]: bundle(r["text"] or "") for r in rows}
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]] += vectors[r["doc_id"]]
    wanted = {}
    for i, v in vectors.items():
        cosines = sorted((-(v @ p) / np.linalg.norm(v) / np.linalg.norm(p), lang) for lang, p in sums.items())
        # Single precision tells no closer ones apart.
        if cosines[1][0] - cosines[0][0] > 1e-4:
            wanted[i] = cosines[0][1]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs).collect()}
    assert {i: got[i] for i in wanted} == wanted and len(wanted) > 100 and len(set(wanted.values())) > 1


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_rank.ranked(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_pairwise_fit_orders_by_the_feature_that_tells():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality_rank.FEATURES)))
    label = (x[:, 3] > 0).astype(int)
    ranking = quality_rank.fit(x, label)
    assert np.argmax(ranking.weights) == 3
    assert ((ranking.scores(x) >= quality_rank.THRESHOLD) == label).mean() > 0.95


def test_quality_is_learnt_from_every_labelled_row(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, 3 + i % 4) + rng.choice(["", "!", " A1;", " B||"]), int(rng.random() < 0.7)) for i in range(21_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([r[::2] for r in rows], "doc_id BIGINT, quality INT")
    ranking = quality_rank.learnt(docs, labels, F.lit(True))
    worth = ranking.worth(quality_rank.features(pa.array([r[1] for r in rows])))
    share = sum(r[2] == 0 for r in rows) / len(rows)
    assert ranking.cut == pytest.approx(np.quantile(worth, share), abs=1e-12)
    assert quality_rank.learnt(docs.repartition(3), labels, F.lit(True)).cut == ranking.cut


@pytest.mark.parametrize("n_bad", [1, 40, 900])
def test_quality_blocks_hold_every_row_and_both_labels(spark, n_bad):
    width = len(quality_rank.FEATURES)
    rows = [(i, int(i >= n_bad), 1, [float(i)] * width) for i in range(3000)]
    cells = spark.createDataFrame(rows, "doc_id BIGINT, label INT, n BIGINT, x ARRAY<DOUBLE>")
    blocks = quality_rank._blocks(cells, {0: n_bad, 1: 3000 - n_bad}).collect()
    assert len(blocks) == 6 and all({r["label"] for r in b["rows"]} == {0, 1} for b in blocks)
    assert {r["x"][0] for b in blocks for r in b["rows"]} == set(map(float, range(3000)))


# Odd input


def operators(spark):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0), (999, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    bench = spark.createDataFrame([(1, prose(1)), (None, None), (3, ""), (4, "tiny")], "item_id BIGINT, text STRING")
    return {
        "suffix_tree": suffix_tree.scored,
        "packing": packing.packed,
        "clean": lambda d: decontaminate.clean(d, bench),
        "leaks": lambda d: decontaminate.leaks(d, bench),
        "line_dedup": line_dedup.dedup_lines,
        "warc": lambda d: _warc(d),
        "quality_rules": quality_rules.ledger,
        "minhash": minhash.near_duplicates,
        "licenses": lambda d: licenses.license_scan(d, "lang", "text", keep=("doc_id",)),
        "language": langid.identified,
        "quality_rank": lambda d: quality_rank.ranked(d, labels),
    }


def _warc(docs):
    folder = new_folder(docs.sparkSession, "test-warc")
    warc.write_archives(docs, folder, "doc_id", "source", "text")
    return warc.read_archives(docs.sparkSession, folder)


@pytest.mark.parametrize("name", [
    "suffix_tree", "packing", "clean", "leaks", "line_dedup", "warc", "quality_rules", "minhash", "licenses",
    "language", "quality_rank",
])
def test_odd_and_empty_input(spark, name):
    operator = operators(spark)[name]
    docs = odd(spark)
    rows = operator(docs).collect()
    ids = [r["page_id" if name == "warc" else "doc_id"] for r in rows]
    expected = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    if name == "clean":
        # These begin with the benchmark's item.
        expected = Counter({k: v for k, v in expected.items() if k not in (5, 6, 7)})
    if name == "leaks":
        expected = Counter({k: v for k, v in expected.items() if k in (5, 6, 7)})
    if name == "packing":
        # A long text has several pieces.
        assert set(ids) == set(expected)
    else:
        assert Counter(ids) == expected
    if name == "language":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    if name == "minhash":
        assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert operator(empty(spark)).collect() == []


def test_nothing_to_learn_from(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert {r["predicted"] for r in quality_rank.ranked(docs, none).collect()} == {1}
    assert {r["lang_pred"] for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_dates_are_parameters():
    assert warc.info_record("x", "2024-01-01T00:00:00Z") == warc.info_record("x", "2024-01-01T00:00:00Z")
    assert date(2024, 1, 1).isoformat() in warc.DATE
