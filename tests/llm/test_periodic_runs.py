"""Periodic runs against a plain scan of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import periodic_runs, queries

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) by comparing all words at all lags."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = [r for r in runs if all(r[1] * o[2] >= o[1] * r[2] for o in runs)]
    s, length, q = min(best, key=lambda r: (r[0], r[2])) if best else (None,) * 3
    digest = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), s, length, q, 1000 * length // q if q else None,
        hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


def random_texts(rng):
    """Codes of 1 to 4 texts, with nested, broken and unbroken repetition."""
    texts = []
    for _ in range(rng.randint(1, 4)):
        n, kind = rng.randint(0, 150), rng.random()
        if kind < 0.3:
            text = [rng.randint(0, 1) for _ in range(n)]
        elif kind < 0.6:
            base = [rng.randint(0, 3) for _ in range(rng.randint(1, 35))]
            text = [base[i % len(base)] for i in range(n)]
            for _ in range(rng.randint(0, 2) if n else 0):
                text[rng.randrange(n)] = rng.randint(0, 4)
        else:
            inner = [0] * rng.randint(1, 20) + [1] * rng.randint(0, 12) + [2] * rng.randint(0, 3)
            text = [0] * rng.randint(0, 30) + (inner * 8)[: n + 60] + [0] * rng.randint(0, 30)
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words_equal_all_lags(seed):
    rng = random.Random(seed)
    for _ in range(100):
        texts = random_texts(rng)
        sizes = [len(t) for t in texts]
        codes = np.array(sum(texts, []), np.int64)
        got = periodic_runs.block_runs(codes, np.repeat(np.arange(len(texts)), sizes))
        want, first = [], 0
        for text in texts:
            want += [(first + s, first + s + n, q) for s, n, q in plain_runs(text)]
            first += len(text)
        assert [tuple(r) for r in got.tolist()] == want


@pytest.mark.parametrize("period", [1, 7, 1000, 90_000])
def test_long_text_of_one_period(period):
    codes = np.arange(400_000) % period
    got = periodic_runs.block_runs(codes, np.zeros(len(codes), np.int64))
    assert got.tolist() == [[0, len(codes), period]]


def test_equal_exponents_take_the_smallest_start():
    assert periodic_runs.strongest([(3, 8, 2), (0, 12, 3), (0, 16, 4)]) == (0, 12, 3)
    assert periodic_runs.strongest([(0, 12, 3), (20, 13, 3)]) == (20, 13, 3)


def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = {plain_row(d.doc_id, d.text) for d in docs}
    rows = queries.queries()["op11_periodic_runs"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    assert {tuple(r) for r in rows} == want
    assert any(r.n_runs for r in rows)


def test_odd_rows(spark):
    text = "a b " * 6 + "c d e f"
    rows = [(1, None, "x", 1), (None, "", None, 2), (2, text, None, None), (2, text, "x", 3),
            (3, " \n\t", "", 4), (4, "z" * 100_000, "", 5), (5, "w " * 50_000, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n int")
    out = {r["n"]: r for r in periodic_runs.collapsed(docs).collect()}
    assert len(out) == 7 and out[1].text == "" and out[2].runs == []
    assert out[3].text == out[None].text == "a b c d e f"
    assert (out[3].start, out[3].length, out[3].period, out[3].n_runs) == (0, 12, 2, 1)
    assert out[5].n_runs == 0 and out[6].text == "w" and out[6].length == 50_000
    assert periodic_runs.collapsed(docs.where(F.lit(False))).collect() == []
