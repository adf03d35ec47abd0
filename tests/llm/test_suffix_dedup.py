"""Bytes of repeated strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import queries, suffix_dedup

SF_DIR = "/root/testdata/sf0.001"


def plain_kept(texts, length):
    """(kept bytes, spans) of each text, by counting every string of `length` bytes."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        last = -1
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                first = max(i, last)
                gone[first : i + length] = [True] * (i + length - first)
                last = i + length
        spans, end = [], None
        for i, g in enumerate([*gone, False]):
            if g and end is None:
                end = i
            elif not g and end is not None:
                spans.append((end, i))
                end = None
        out.append((bytes(b for b, g in zip(d, gone, strict=True) if not g), spans))
    return out


def planted(rng, n, length, letters):
    """Texts with passages around the limit, copies at odd places, runs of one letter."""
    base = "".join(rng.choices(letters, k=40 * length))
    texts = []
    for _ in range(n):
        text = "".join(rng.choices(letters, k=rng.randint(0, 4 * length)))
        for _ in range(rng.randint(0, 3)):
            size = rng.choice([length - 1, length, length + 1, 2 * length, 5 * length])
            a, b = rng.randint(0, len(base)), rng.randint(0, len(text))
            text = text[:b] + base[a : a + size] + text[b:]
        if rng.random() < 0.2:
            text += rng.choice("xé") * rng.randint(0, 2 * length)
        if rng.random() < 0.2 and texts:
            other = rng.choice(texts)
            text = other[: rng.randint(0, len(other))] + "#" + other[rng.randint(0, len(other)) :]
        texts.append(text)
    return texts + rng.choices(texts, k=n // 5)


@pytest.mark.parametrize("seed,length,covers,letters", [
    (0, 200, suffix_dedup.COVERS, "abcdefgh é\n"), (1, 40, (24, 5, 1), "ab"),
    (2, 64, (50, 1), "abc"), (3, 200, (160, 16, 1), "ab"),
])
def test_equals_counting_all_strings(spark, seed, length, covers, letters):
    texts = planted(random.Random(seed), 120, length, letters)
    docs = spark.createDataFrame(enumerate(texts), "doc_id int, text string").repartition(7)
    rows = suffix_dedup.cleaned(docs, length, covers).collect()
    want = plain_kept(texts, length)
    assert len(rows) == len(texts)
    for r in rows:
        kept, spans = want[r.doc_id]
        assert (bytes(r.kept), [tuple(s) for s in r.spans]) == (kept, spans), r.doc_id
        assert (r.n_spans, r.n_bytes - r.n_removed) == (len(spans), len(kept))


def test_long_texts_are_read_in_parts(monkeypatch):
    """Each start lies in one part, whatever the sizes, and parts are bounded."""
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abcdef", k=k)) for k in (0, 199, 200, 999, 1000, 1199, 1200, 7_777)]
    batch = pa.RecordBatch.from_pydict({"data": pa.array(texts, pa.binary())})
    seen = Counter()
    for held in suffix_dedup._parts(batch, 200):
        assert sum(len(p) for _, _, p in held) < 2400
        for row, start, part in held:
            assert texts[row][start : start + len(part)] == part
            seen.update((row, start + i) for i in range(len(part) - 199))
    assert seen == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - 199))


@pytest.mark.parametrize("width", suffix_dedup.COVERS)
def test_ranges_cover_each_start_once(width):
    rng = random.Random(width)
    parts = [bytes(rng.choices(b"abcdef", k=3_000)), b"a" * 2_000, b"", b"b" * 200]
    found = suffix_dedup.ranges(parts, width, 200)
    lone = ~found["many"]
    sizes = found["hi"] - found["lo"] + 1
    assert sizes.max() <= max(width, 1801) and sizes[lone].sum() == 2801 + 1
    marked = (found["part"] == 1) & (sizes > width)
    assert marked.any()  # a run of one letter comes as few ranges


def test_query_equals_counting(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = plain_kept([d.text for d in docs], 200)
    rows = queries.queries()["op13_suffix_dedup"](spark, SF_DIR).collect()
    assert {tuple(r) for r in rows} == {
        (d.doc_id, len((d.text or "").encode()), sum(b - a for a, b in spans), len(spans),
         hashlib.sha256(kept).hexdigest())
        for d, (kept, spans) in zip(docs, want, strict=True)
    }
    assert sum(r.n_removed > 0 for r in rows) > 10


def test_odd_rows(spark):
    long = "0123456789" * 30
    rows = [(1, None, 1, "a"), (1, "", 2, None), (None, "short", 3, ""), (None, "short", 3, ""),
            (2, "".join(map(chr, range(300, 700))), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, kept string")
    out = suffix_dedup.cleaned(docs)
    assert out.columns[:3] == ["doc_id", "text", "_row"] and out.columns.count("kept") == 1
    got = out.collect()
    assert len(got) == 5 and all(r.n_removed == 0 for r in got)
    assert Counter(bytes(r.kept) for r in got) == Counter((r[1] or "").encode() for r in rows)
    twice = docs.select(F.lit(long).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))))
    assert [bytes(r.kept) for r in suffix_dedup.cleaned(twice).collect()] == [b""] * 10
    assert suffix_dedup.cleaned(docs.where("false")).collect() == []
