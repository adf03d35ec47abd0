"""Ranked search against plain Python and SQL."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import lexical_search, queries

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
ODD = [
    None, "", " .,;", "Abc aBC abc", "Straße É é ǅ 12ab３４_x", "a" * 40_000, "one two " * 20_000,
    "it's\x00a\x7fb\x85c d", "K K k",
]


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_ranked(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total = sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for d, b, n in bags:
            m = 10 + 90 * n * len(bags) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1)))
                * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in set(plain_terms(text)) if t in b
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        scores.sort(key=lambda s: s[:3])
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return Counter(out)


def test_terms(spark):
    words = lexical_search.split_terms(pa.array([*ODD, "last"]).slice(1))
    for i, text in enumerate([*ODD[1:], "last"]):
        got = words.vocab.take(pa.array(words.codes[words.starts[i] : words.starts[i + 1]]))
        assert got.to_pylist() == plain_terms(text)


@pytest.mark.parametrize("seed,slice_terms", [(0, 500_000), (1, 500_000), (2, 12), (3, 1)])
def test_equals_scoring_all(spark, seed, slice_terms):
    """Groups of copies, ties, null and repeated ids, items that repeat; one slice and many."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(60)]
    docs = [(rng.choice([None, *range(400)]), rng.choice(texts[:5] * 20 + texts)) for _ in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)]
    items = [(rng.choice([None, *range(9)]), rng.choice(texts + ODD)) for _ in range(25)]
    doc_table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    item_table = spark.createDataFrame(items, "item_id int, text string")
    doc_table = doc_table.withColumn("ids", F.lit(None).cast("int")).withColumn("bag", F.lit("x"))
    got = lexical_search.ranked(doc_table, item_table.withColumn("score", F.lit(1)), 10, slice_terms)
    assert got.dtypes[0] == ("item_id", "int")
    assert Counter(map(tuple, got.collect())) == plain_ranked(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(docs.where("false"), items).collect() == []
    assert lexical_search.ranked(docs, items.where("false")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{Path(SF_DIR) / name}.parquet'")
    want = con.sql(queries.oracle_sql()["op12_lexical_search"]).fetchall()
    got = queries.queries()["op12_lexical_search"](spark, SF_DIR).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
