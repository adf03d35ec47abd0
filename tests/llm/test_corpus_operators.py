"""Operators over whole tables, against brute force on small ones."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import (
    bagminhash, chaining, decontamination, line_dedup, linking, sharding, stupid_backoff,
)
from bindery.llm.blocks import normalised, split_words
from bindery.session import written

SF_DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def words_of(text):
    found = normalised(split_words(pa.array([text], pa.string())))
    return found.vocab.take(pa.array(found.codes)).to_pylist()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, every):
    words = text.split()
    for i in range(rng.randrange(every), len(words), every):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (1, None, "a"), (None, "", "b"), (2, " ", "c"), (3, "one two", "d"), (3, "one two", "d"),
        (None, None, None), (4, "one  two", "e"), (5, "x" * 100_000, "f"), (6, "spam " * 3000, "g"),
    ]
    return written(spark.createDataFrame(rows, "doc_id long, text string, score string"), "odd")


# -- components and linking ---------------------------------------------------


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)]
    got = linking.components(spark.createDataFrame(edges, "a long, b long"))
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.root for r in got.collect()} == want
    assert got.count() == len(want)


def test_linking_equals_all_pairs(spark):
    """Neither hub links nor components may hide a pair that a block holds."""
    rng = random.Random(4)
    blocks = [(k, rng.randrange(60)) for k in range(25) for _ in range(rng.randrange(2, 9))]
    blocks = sorted(set(blocks))
    similar = lambda a, b: (a * 7 + b * 7) % 5 < 2
    tested = []

    def verify(pairs):
        rows = pairs.select("a", "b").collect()
        tested.extend((r.a, r.b) for r in rows)
        good = [(r.a, r.b) for r in rows if similar(r.a, r.b)]
        return spark.createDataFrame(good, "a long, b long")

    df = spark.createDataFrame(blocks, "key long, node long")
    got = {r.node: r.root for r in linking.linked(df, verify, "test").collect()}
    by_key = {}
    for k, n in blocks:
        by_key.setdefault(k, set()).add(n)
    pairs = {tuple(sorted(p)) for s in by_key.values() for p in combinations(s, 2)}
    want = plain_components([p for p in pairs if similar(*p)])
    assert got == want
    assert len(tested) <= len(pairs)


def test_a_block_with_few_links_needs_no_square_of_pairs(spark):
    """A tenth of the pairs of one large block hold: hubs find the component, not all pairs."""
    size, tested = 300, set()
    links = {p for p in combinations(range(size), 2) if random.Random(p[0] * size + p[1]).random() < 0.1}

    def verify(pairs):
        rows = [tuple(sorted((r.a, r.b))) for r in pairs.select("a", "b").collect()]
        tested.update(rows)
        return spark.createDataFrame([p for p in rows if p in links], "a long, b long")

    df = spark.createDataFrame([(1, n) for n in range(size)], "key long, node long")
    got = {r.node: r.root for r in linking.linked(df, verify, "test").collect()}
    assert got == plain_components(links)
    assert len(tested) <= size * size / 2 / 3


@pytest.mark.parametrize("few", [0, 10**6])
def test_sketches_hide_no_pair(spark, monkeypatch, few):
    """Numbers are linked if near; what sketches rule out is not verified."""
    monkeypatch.setattr(linking, "FEW", few)
    rng = random.Random(5)
    blocks = sorted({(k, rng.randrange(400)) for k in range(6) for _ in range(60)})
    tested = set()

    def verify(pairs):
        rows = pairs.select("a", "b").collect()
        tested.update((r.a, r.b) for r in rows)
        good = [(r.a, r.b) for r in rows if abs(r.a - r.b) <= 3]
        return spark.createDataFrame(good, "a long, b long")

    df = spark.createDataFrame(blocks, "key long, node long")
    sketches = lambda: df.select("node", F.col("node").alias("at")).distinct()
    near = F.abs(F.col("a_at") - F.col("b_at")) <= 5
    got = linking.linked(df, verify, "test", sketches, near).collect()
    by_key = {}
    for k, n in blocks:
        by_key.setdefault(k, set()).add(n)
    pairs = {p for s in by_key.values() for p in combinations(sorted(s), 2)}
    assert {r.node: r.root for r in got} == plain_components(p for p in pairs if p[1] - p[0] <= 3)
    first = {(min(s), n) for s in by_key.values() for n in s}
    assert all(abs(a - b) <= 5 for a, b in tested - first)


# -- scoring ------------------------------------------------------------------


def plain_scores(texts, order=3, alpha=0.4):
    docs = [words_of(t) for t in texts]
    own = [
        {n: Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for n in range(1, order + 1)}
        for d in docs
    ]
    every = {n: sum((o[n] for o in own), Counter()) for n in range(1, order + 1)}
    total = sum(map(len, docs))
    out = []
    for d, o in zip(docs, own, strict=True):
        left = lambda g: every[len(g)][g] - o[len(g)][g] if g else total - len(d)  # noqa: B023, E731
        score, backed = 0.0, 0
        for i in range(len(d)):
            steps = 0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                if left(gram) > 0:
                    score += math.log(left(gram) / left(gram[:-1])) + steps * math.log(alpha)
                    break
                steps += 1
            else:
                score += steps * math.log(alpha) - math.log(left(()) + 1)
            backed += steps > 0
        out.append((len(d), score, backed))
    return out


def test_scores_equal_plain_counting(spark, docs):
    rows = docs.orderBy("doc_id").collect()[:120]
    texts = [r.text for r in rows] + [None, "", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in stupid_backoff.scored(df, block_bytes=40_000).collect()}
    assert len(got) == len(texts)
    for i, (n, score, backed) in enumerate(plain_scores(texts)):
        assert got[i].n_words == n and got[i].n_backed_off == backed
        assert math.isclose(got[i].log_score, score, rel_tol=1e-9, abs_tol=1e-6)


def test_packed_numbers():
    numbers = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (stupid_backoff.unpacked(stupid_backoff.packed(numbers)) == numbers).all()


# -- decontamination ----------------------------------------------------------


def plain_alignment(a, b):
    best = 0
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            step = decontamination.MATCH if x == y else decontamination.MISMATCH
            row.append(max(0, above[j] + step, above[j + 1] + decontamination.GAP, row[j] + decontamination.GAP))
        best = max(best, *row)
        above = row
    return best


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        score, begin, end = decontamination.smith_waterman(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        if score:
            assert plain_alignment(a.tolist(), b[begin:end].tolist()) == score


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_leaks_are_found_and_clean_texts_left(spark, most_sent):
    rng = random.Random(8)
    items = [sentence(rng, 30) for _ in range(12)] + ["only three words", "  ", None]
    rows, want = [], set()
    for d in range(80):
        text = sentence(rng, 150)
        if d % 4 == 0:
            k = rng.randrange(12)
            leak = [items[k], edited(rng, items[k], 6), items[k].upper()][d // 4 % 3]
            if d % 8 == 0:
                leak = " ".join(w for i, w in enumerate(leak.split()) if i % 9)
            text, want = f"{text} {leak} {sentence(rng, 60)}", want | {(d, k)}
        rows.append((d, text, "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, items[3], "x"), (102, items[3], "x")]
    want |= {(102, 3)}
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, score string"), "docs")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.report(docs, bench, most_sent=most_sent).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    clean = decontamination.cleaned(docs, bench, most_sent=most_sent)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_repeated_edited_copies_are_found_beside_a_verbatim_one(spark):
    rng = random.Random(18)
    item = sentence(rng, 36)
    copy = " ".join(f"new{i}" if i % 6 == 3 else w for i, w in enumerate(item.split()))
    leaked = [item] + [copy] * 50
    rows = [(d, f"{sentence(rng, 40)} {x} {sentence(rng, 40)}") for d, x in enumerate(leaked)]
    rows += [(100 + d, sentence(rng, 100)) for d in range(10)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.report(docs, bench).collect()
    assert {r.doc_id for r in got} == set(range(51))
    assert {r.doc_id for r in decontamination.cleaned(docs, bench).collect()} == {
        r[0] for r in rows if r[0] >= 100
    }


def test_leaks_equal_alignment_of_all_pairs(spark):
    """Items that share common 4-grams, in documents that hold parts of them."""
    rng = random.Random(28)
    common = "one of the most"
    items = [f"{sentence(rng, 12)} {common} {sentence(rng, 12)}" for _ in range(8)]
    texts = []
    for d in range(40):
        words = items[d % 8].split()
        if d % 3 == 0:
            words = words[: rng.randrange(6, 28)]
        elif d % 3 == 1:
            words = edited(rng, items[d % 8], rng.randrange(5, 9)).split()
        else:
            words = common.split()
        again = words if d % 5 == 0 else []
        texts.append(" ".join([sentence(rng, 30), common, *words, sentence(rng, 25), *again]))
    want = set()
    for d, text in enumerate(texts):
        names = {w: k for k, w in enumerate(dict.fromkeys(words_of(text + " " + " ".join(items))))}
        own = np.array([names[w] for w in words_of(text)])
        for k, item in enumerate(items):
            codes = np.array([names[w] for w in words_of(item)])
            if decontamination.smith_waterman(codes, own)[0] >= len(codes):  # half of two a word
                want.add((d, k))
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "d")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(docs, bench).collect()}
    assert 10 < len(want) < 40
    assert got == want


def test_a_stretch_with_any_gram_has_its_rarest_as_seed(spark):
    seeds = spark.createDataFrame(
        [(g, 4, 1, p, 20) for g, p in ((10, 0), (11, 3), (12, 9), (13, 12))],
        "gram long, size int, item_id long, item_pos long, item_words long",
    )
    found = [(10, 1, 100), (11, 1, 103), (12, 1, 109), (13, 2, 12), (10, 2, 50)]
    hits = spark.createDataFrame(
        [(g, 0, r, p) for g, r, p in found] + [(10, 0, 9, 7)] * 5,
        "gram long, _file long, _row long, pos long",
    )
    got = decontamination.rare_seeds(hits, seeds).where("_row < 9").collect()
    # row 1: a seed in each of two stretches; row 2: two placements
    assert sorted((r._row, r.begin) for r in got) == [(1, 100), (1, 100), (2, 0), (2, 50)]


def test_leaks_of_odd_tables(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(odd_docs, none).count() == 0
    assert decontamination.cleaned(odd_docs, none).count() == odd_docs.count()
    some = spark.createDataFrame([(1, "one two"), (None, "one two")], none.schema)
    assert decontamination.cleaned(odd_docs, some).count() == odd_docs.count() - 3
    empty = written(odd_docs.limit(0), "none")
    assert decontamination.report(empty, some).count() == 0


# -- passages -----------------------------------------------------------------


def plain_chain_score(anchors):
    best = []
    for i, (p, h) in enumerate(anchors):
        score = chaining.GAIN
        for j in range(i):
            q, g = anchors[j]
            if q < p and g < h:
                score = max(score, best[j] + chaining.GAIN - chaining.GAP * (p - q + h - g))
        best.append(score)
    return max(best)


def test_fenwick_chains_equal_all_predecessors():
    rng = random.Random(5)
    for _ in range(100):
        anchors = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(rng.randrange(1, 25))})
        found = chaining.chains(anchors)
        first = [anchors[i] for i in found[0]]
        score = chaining.GAIN * len(first) - chaining.GAP * sum(
            b[0] - a[0] + b[1] - a[1] for a, b in zip(first, first[1:], strict=False)
        )
        assert math.isclose(score, plain_chain_score(anchors))
        assert sorted(i for c in found for i in c) == list(range(len(anchors)))


def test_minimizers_equal_plain_windows():
    rng = np.random.default_rng(3)
    starts = np.array([0, 3, 3, 40, 60])
    hashes = rng.integers(0, 50, 60).astype(np.uint64)
    got = set(chaining.minimizers(hashes, np.arange(60), starts, 8).tolist())
    want = set()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for w in range(a, max(a + 1, b - 7)) if b > a else ():
            window = range(w, min(w + 8, b))
            want.add(min(window, key=lambda i: (hashes[i], i)))
    assert got == want


def test_repeated_passages_are_found(spark):
    rng = random.Random(6)
    passage = {k: sentence(rng, 70) for k in range(6)}
    rows, holders = [], {}
    for d in range(60):
        text = sentence(rng, 200)
        if d % 2 == 0:
            k = d // 2 % 6
            copy = passage[k] if d % 3 else edited(rng, passage[k], 15)
            holders.setdefault(k, []).append(d)
            text = f"{text} {copy} {sentence(rng, 50)}"
        rows.append((d, text, "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, passage[0] + " " + passage[0], "x")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, _x string"), "docs")
    found = chaining.passages(docs).collect()
    pairs = plain_components([(r.doc_id, r.of_doc_id) for r in found])
    for k, who in holders.items():
        assert len({pairs.get(d) for d in who}) == 1, k
        assert None not in {pairs.get(d) for d in who}
    assert set(pairs) == {d for who in holders.values() for d in who} | {102}
    for r in found:
        assert r.words == r.end - r.start >= 50 and r.identity >= 0.8
        a = words_of(rows[r.doc_id][1])[r.start : r.end] if r.doc_id < 60 else None
        if a and r.identity == 1 and r.of_doc_id < 60:
            assert a == words_of(rows[r.of_doc_id][1])[r.of_start : r.of_end]


def test_header_and_footer_around_differing_words_are_passages(spark):
    rng = random.Random(16)
    header, footer = sentence(rng, 60), sentence(rng, 60)
    sizes = (50, 90, 140, 200)
    rows = [(d, f"{header} {sentence(rng, n)} {footer}") for d, n in enumerate(sizes)]
    one_file = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = chaining.passages(written(one_file, "docs")).collect()
    for d, n in list(enumerate(sizes))[1:]:
        own = sorted((r.start, r.end) for r in found if r.doc_id == d)
        assert any(a == 0 and 60 <= b <= 64 for a, b in own), (d, own)
        assert any(56 + n <= a <= 60 + n and b == 120 + n for a, b in own), (d, own)
    assert all(r.identity >= 0.8 and r.words >= 50 for r in found)


def test_a_chance_meeting_with_the_first_document_hides_no_pair(spark):
    rng = random.Random(26)
    passage = " ".join(f"p{i}" for i in range(60)).split()
    # the first documents hold each run of five words of the passage by chance, one by one
    runs = [
        " ".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)} {' '.join(passage[i : i + 5])}" for i in part)
        for part in (range(0, 56, 2), range(1, 56, 2))
    ]
    rows = [(k, r) for k, r in enumerate(runs)]
    rows += [(10 + d, f"{sentence(rng, 80)} {' '.join(passage)} {sentence(rng, 80)}") for d in range(3)]
    one_file = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = chaining.passages(written(one_file, "docs")).collect()
    pairs = {(r.doc_id, r.of_doc_id) for r in found if r.words >= 58}
    assert {(11, 10), (12, 10)} <= pairs


def test_an_extension_ends_where_the_texts_part():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([a[:40], a[:60] + 1000]).astype(np.uint32)
    assert chaining.extension(a, b) == (40, 40, False)
    assert chaining.extension(a[:30], b[:30]) == (30, 30, True)
    assert chaining.extension(a, a + 1000) == (0, 0, False)
    assert chaining.extension(a[:2], a[:2] + 1000) == (0, 0, True)
    assert chaining.extension(a[:0], b) == (0, 0, True)


def test_passages_of_one_seed_reach_as_far_as_they_go(spark):
    """A window of 400 5-mers leaves these 300 words a seed or two."""
    rng = random.Random(31)
    passage = sentence(rng, 300)
    rows = [(d, f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}") for d in range(3)]
    one_file = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = chaining.passages(written(one_file, "docs"), window=400).collect()
    assert any(r.words >= 300 for r in found)
    assert len({tuple(r) for r in found}) == len(found)
    for r in found:
        words, other = words_of(rows[r.doc_id][1]), words_of(rows[r.of_doc_id][1])
        assert r.identity < 1 or words[r.start : r.end] == other[r.of_start : r.of_end]


def test_exact_copies_are_whole_passages(spark, docs):
    copies = docs.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"))
    rows = chaining.passages(docs).collect()
    reported = {r.doc_id for r in rows}
    for c in copies.where("n > 1").collect():
        size = len(words_of(c.text))
        same = {r.doc_id for r in docs.where(F.col("text") == c.text).collect()}
        if size >= 60:
            assert len(same - reported) <= 1
            assert any(r.words == size for r in rows if r.doc_id in same)


def test_passages_of_odd_rows(odd_docs):
    assert chaining.passages(written(odd_docs.limit(0), "none")).count() == 0
    assert {r.doc_id for r in chaining.passages(odd_docs).collect()} <= {5, 6}


# -- sharding -----------------------------------------------------------------


def test_shards_hold_each_row_once_and_evenly(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.sharded(docs).collect()
    text = {r.doc_id: r.text for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.tokens == len((text[r.doc_id] or "").split())
    slots, sizes, shards = {}, Counter(), {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values())
    largest = max(len(t or "") for t in text.values())
    assert largest > 0 and sum(len(s) > 1 for s in shards.values()) <= len(shards) * 0.1


def test_a_hot_group_is_split_evenly(spark):
    rows = [(i, "hot text of some length" if i % 3 == 0 else f"text {i} " * (i % 40 + 1)) for i in range(6000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), bundles=256).collect()
    sizes = Counter()
    counts = Counter(r.shard for r in got)
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    assert max(counts.values()) <= 1.05 * min(counts.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_texts_share_a_shard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sharding.sharded(docs).cache()
    by_text = got.join(docs.select("doc_id", F.sha1("text").alias("h")), "doc_id")
    split = by_text.groupBy("h").agg(F.count_distinct("shard").alias("n"), F.count("*").alias("m"))
    assert split.where("m > 1").count() > 5 and split.where("n > 1").isEmpty()
    sizes = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8


def test_only_what_exceeds_a_shard_is_split(spark):
    """A third of all rows is one text, a tenth another, over texts of their own."""
    rows = [(i, "hot " * 20 if i % 3 == 0 else "warm " * 15 if i % 10 == 1 else f"text {i} " * (i % 30 + 1))
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(docs).join(docs, "doc_id").collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text, set()).add(r.shard)
    assert [t[:4] for t, s in shards.items() if len(s) > 1] == ["hot "]
    assert len(shards["hot " * 20]) == 3  # a third of the rows in shards of an eighth
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 8


def test_sharding_of_odd_rows(odd_docs):
    got = sharding.sharded(odd_docs).collect()
    assert len(got) == 9
    assert sharding.sharded(odd_docs.limit(0)).count() == 0


def test_placing_follows_the_dot_product():
    chosen = sharding.place(np.array([[8.0, 1, 1], [1, 8, 1], [1, 1, 8], [2, 2, 2]]), 2)
    assert len(set(chosen.tolist())) == 2


# -- lines --------------------------------------------------------------------


def test_lines_equal_plain_dedup(spark, docs):
    """Lines without similar ones: the first of equal normalised lines stays."""
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    seen, want = set(), {}
    for r in rows:
        kept = []
        for line in r.text.split("\n"):
            words = tuple(words_of(line))
            if len(words) < line_dedup.LEAST_WORDS or words not in seen:
                kept.append(line)
            seen.add(words)
        want[r.doc_id] = "\n".join(kept)
    got = line_dedup.deduplicated(docs, similar=1.0).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_equal_lines_of_few_words_are_dropped(spark):
    short = ["All rights reserved", "Read more here", "more", "漢字漢字漢字漢字", "one two three four"]
    rows = [(d, "\n".join([f"line {d} of its own kind", *short, "", "--"])) for d in range(3)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "short")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.deduplicated(docs).collect()}
    assert got[0] == rows[0][1].split("\n")
    for d in (1, 2):
        assert got[d] == [f"line {d} of its own kind", "", "--"]


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_similar_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    lines = []
    for _ in range(25):
        base = sentence(rng, 60).split()
        lines.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rng.randrange(60)] = rng.choice(WORDS)
            lines.append(" ".join(other))
    rows = [(i, line) for i, line in enumerate(lines)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "lines")
    edges = [
        (i, j)
        for i, j in combinations(range(len(lines)), 2)
        if abs(len(lines[i]) - len(lines[j])) < 40 and similarity(lines[i], lines[j]) >= 0.9
    ]
    roots = plain_components(edges)
    assert len(edges) > 20
    want = {i for i in range(len(lines)) if roots.get(i, i) == i}
    got = {r.doc_id for r in line_dedup.deduplicated(docs).collect() if r.text}
    assert got == want


def random_line(rng, words):
    if words < 0:  # a script without spaces
        return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(-words))
    return " ".join(
        "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
        for _ in range(words)
    )


def changed(rng, line, edits):
    out = list(line)
    for i in rng.sample([i for i, x in enumerate(line) if x != " "], edits):
        out[i] = "z"
    return "".join(out)


@pytest.mark.parametrize("words", [8, 12, 20, 40, -20, -40])
def test_recall_of_lines_with_a_typo(spark, words):
    """Every pair here is at or above the similarity; nothing else may go."""
    rng = random.Random(words)
    rows, other = [], []
    for k in range(100):
        line = random_line(rng, words)
        rows += [(2 * k, line), (2 * k + 1, changed(rng, line, 1))]
        other.append((1000 + k, random_line(rng, words)))
    docs = written(spark.createDataFrame(rows + other, "doc_id long, text string"), "typos")
    assert all(similarity(a, b) >= 0.9 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    gone = {r.doc_id for r in line_dedup.deduplicated(docs).collect() if not r.text}
    assert gone <= {2 * k + 1 for k in range(100)}
    assert len(gone) >= 90


@pytest.mark.parametrize("words", [12, 20, 40, -20, -40])
def test_recall_of_lines_with_changes_up_to_half_the_limit(words):
    rng = random.Random(words)
    texts = []
    for _ in range(300):
        line = random_line(rng, words)
        texts += [line, changed(rng, line, rng.randint(1, max(1, len(line) // 20)))]
    keys, starts = line_dedup.block_keys(pa.array(texts), 0.9)
    of = [set(keys[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    met = sum(bool(a & b) for a, b in zip(of[::2], of[1::2], strict=True))
    assert met >= 0.9 * 300


def scattered_edits(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
    return "".join(out)


@pytest.mark.parametrize("size", [10, 14, 18, 19, 20, 23, 26, 29])
def test_short_lines_within_the_limit_always_meet(size):
    """Every pair of two lines under 30 letters, one, two edits apart, shares a key."""
    rng = random.Random(size)
    texts = []
    while len(texts) < 600:
        line = "".join(rng.choice("abcde fghi 12") for _ in range(size)).strip()
        other = scattered_edits(rng, line, rng.randrange(1, 3)).strip()
        numbers = [[c for c in x if c.isdigit()] for x in (line, other)]
        alike = line != other and numbers[0] == numbers[1] and similarity(line, other) >= 0.9
        if alike and max(len(line), len(other)) < 30:
            texts += [line, other]
    keys, starts = line_dedup.block_keys(pa.array(texts), 0.9)
    of = [set(keys[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert all(a & b for a, b in zip(of[::2], of[1::2], strict=True))


def test_short_lines_with_a_typo_are_dropped(spark):
    lines = ["Read the whole story", "read the hole story", "Alle Rechte vorbehalten", "Alle Rechte vorbehaltn",
             "see page 12 of it", "see page 13 of it", "see page of it"]
    docs = written(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "short")
    got = line_dedup.deduplicated(docs).collect()
    assert {r.doc_id for r in got if not r.text} == {1, 3}


def test_an_edit_leaves_lanes_alone():
    """Pigeonholes: each lane that none of the changed n-grams is in is a shared key."""
    rng = random.Random(3)
    for size in (60, 200, 800):
        line = random_line(rng, size // 6)
        other = changed(rng, line, 1)
        keys, starts = line_dedup.block_keys(pa.array([line, other]), 0.9)
        a, b = set(keys[: starts[1]].tolist()), set(keys[starts[1] :].tolist())
        # both sides of a lane whose n-grams changed, 8 of them at most
        assert len(a & b) >= len(a) - 2 * 8 and a & b


def test_bags_bound_the_edit_distance():
    rng = random.Random(13)
    for _ in range(200):
        line = [rng.choice("abc ") for _ in range(rng.randrange(1, 60))]
        other = list(line)
        for _ in range(edits := rng.randrange(8)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
        a, b = line_dedup.bags(pa.array(["".join(line), "".join(other)])).to_pylist()
        assert sum(abs(u - v) for u, v in zip(a, b, strict=True)) <= 4 * edits
    assert max(line_dedup.bags(pa.array(["x" * 1000, ""])).to_pylist()[0]) == 127


def test_pairs_that_only_share_letters_are_not_aligned():
    """Edits within the limit always pass; other lines of the same letters don't."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        line = random_line(rng, 40)
        texts += [(line, changed(rng, line, 5)), (line, "".join(rng.sample(line, len(line))))]
    x, y = (pa.array(side) for side in zip(*texts, strict=True))
    most = pa.array([5 if i % 2 == 0 else len(t[0]) // 10 for i, t in enumerate(texts)], pa.int32())
    rows = pa.RecordBatch.from_arrays([x, y, most], names=["x", "y", "most"])
    kept = pa.Table.from_batches(line_dedup.alike([rows])).to_pylist()
    assert [(r["x"], r["y"]) for r in kept if r["most"] == 5] == texts[::2]
    assert len(kept) == 60
    apart = np.abs(np.diff(np.array(line_dedup.bags(pa.array(["abcabc", "abcabd"]), 3, 1024).to_pylist()), axis=0))
    assert apart.sum() <= 2 * 3


def test_keys_of_odd_lines():
    odd = ["", "a", "word", "x" * 1000, "spam " * 500, "\U0001F600" * 50, "no grams!"]
    keys, starts = line_dedup.block_keys(pa.array(odd), 0.9)
    assert len(starts) == len(odd) + 1 and starts[-1] == len(keys)
    assert np.diff(starts)[:3].tolist() == [0, 0, 0]
    assert len(line_dedup.block_keys(pa.array([], pa.string()), 0.9)[0]) == 0
    # equal lines have equal keys, whatever is beside them
    alone, _ = line_dedup.block_keys(pa.array(odd[4:5]), 0.9)
    assert alone.tolist() == keys[starts[4] : starts[5]].tolist()


def test_lines_of_odd_rows(odd_docs):
    rows = line_dedup.deduplicated(odd_docs).collect()
    assert len(rows) == 9
    assert line_dedup.cleaned(odd_docs).columns == odd_docs.columns
    copies = written(
        odd_docs.sparkSession.createDataFrame(
            [(7, "the same long line here"), (7, "the same long line here")], "doc_id long, text string"
        ),
        "copies",
    )
    assert [r.text for r in line_dedup.cleaned(copies).collect()] == ["the same long line here"]
    assert line_dedup.cleaned(written(odd_docs.limit(0), "none")).count() == 0


# -- near-duplicates ----------------------------------------------------------


def multiset(text):
    words = words_of(text)
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    m = 4000
    for weights in ([1, 1, 1, 1], [5, 1, 3, 2], [1, 40, 7, 9]):
        keys = rng.integers(0, 2**63, 4).astype(np.uint64)
        other = np.array([2, 1, 5, 0])
        a = bagminhash.signatures(keys, np.zeros(4, np.int64), np.array(weights), 1, m)
        some = other > 0
        b = bagminhash.signatures(keys[some], np.zeros(3, np.int64), other[some], 1, m)
        want = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        assert abs((a == b).mean() - want) < 4 * math.sqrt(want * (1 - want) / m) + 1e-9


def test_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for size in (1, 30, 800):
        a, b = rng.integers(0, 5, (2, size))
        grams = rng.integers(0, 1 << 62, size).astype(np.uint64)
        x, y = (
            bagminhash.parities(np.repeat(grams, w), np.zeros(w.sum(), np.int64), 1) for w in (a, b)
        )
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= np.abs(a - b).sum()
        assert differ > 0 or (a == b).all() or size == 1
    docs, owners = np.array([3, 4, 3], np.uint64), np.array([0, 0, 2])
    assert np.bitwise_count(bagminhash.parities(docs, owners, 3)).sum(axis=1).tolist() == [2, 0, 1]


def test_signatures_do_not_depend_on_company():
    keys = np.arange(50, dtype=np.uint64)
    weights = np.arange(50) % 7 + 1
    alone = bagminhash.signatures(keys, np.zeros(50, np.int64), weights, 1, 100)
    owners = np.repeat([0, 1], [3, 50])
    both = bagminhash.signatures(
        np.concatenate([keys[:3] + np.uint64(999), keys]), owners, np.concatenate([weights[:3], weights]), 2, 100
    )
    assert (both[1] == alone[0]).all()


def test_groups_equal_all_pairs(spark, docs):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for d in range(40):
        words = rows[d][1].split()
        if len(words) > 80:
            words[rng.randrange(len(words))] = "changed"
            rows += [(1000 + d, " ".join(words))]
    rows += [(2000, "a b c"), (2001, "A, b c!"), (2002, None), (2003, ""), (2004, "")]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    sets = {d: multiset(t) for d, t in rows}
    edges = [
        (a, b) for a, b in combinations(sorted(sets), 2)
        if jaccard(sets[a], sets[b]) >= 0.8 or (a, b) == (2003, 2004)
    ]
    roots = plain_components(edges)
    got = {r.doc_id: r.class_id for r in bagminhash.report(df).collect()}
    assert got == {d: roots.get(d, d) for d, _ in rows}
    kept = bagminhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({roots.get(d, d) for d, _ in rows})


def test_groups_of_odd_rows(odd_docs):
    rows = bagminhash.report(odd_docs).collect()
    assert len(rows) == 9
    kept = bagminhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect())[3] == 1
    assert bagminhash.report(written(odd_docs.limit(0), "none")).count() == 0
