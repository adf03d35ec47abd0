"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Word n-grams of the test items are looked up in the documents, and counted.
2. For each document, placement of an item in it and stretch of the item, the rarest
   n-gram the document holds there is the seed. What a document shares with an item is
   compared with its own n-grams only, so no count can hide it: a stretch with any
   n-gram has a seed.
3. Each seed names a passage of the document that may hold the item.
4. Item and passage are aligned word by word (Smith-Waterman), so edits,
   insertions and omissions lower the score and don't break the match.

Words are compared in lower case and without punctuation around them. An item of
fewer words than an n-gram has is its own seed and is found wherever it stands as
a whole, however common its words are; leave such items out of `benchmark` if this
isn't wanted. Very long texts are cut into passages no longer than items need, texts
that are null or empty hold nothing, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindery.llm.blocks import (
    Words, ngram_hashes, normalised, signed, sliced, split_words, word_hashes,
)
from bindery.llm.rows import KEY, aside_private, keyed, small
from bindery.session import written

SEED_WORDS = 4
#: Positions of an item that have one seed in common, and words by which placements of an
#: item may differ and count as one; less than the slack of a passage (4 words or more).
STRETCH, PLACE = 8, 4
#: Share of an item's full score that counts as contamination.
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: So many item n-grams (8 bytes each) are sent to the tasks at most; with more,
#: all n-grams of the documents go into the join instead, with the same result.
MOST_SENT = 4_000_000

LEAKS = "_file long, _row long, doc_id long, item_id long, start long, end long, score double"


def _sized_grams(
    words: Words, sizes: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, hashes and positions of all n-grams of the given sizes."""
    hashes = word_hashes(words)
    for size in sizes:
        grams, at = ngram_hashes(hashes, words.starts, size)
        yield size, grams, at


def item_seeds(items: DataFrame, n: int = SEED_WORDS) -> DataFrame:
    """gram, size, item_id, item_pos, item_words: the n-grams of each item.

    An item of fewer than n words is one n-gram as a whole; one without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = normalised(split_words(batch.column("text")))
            own = np.minimum(words.counts, n)
            for size, grams, at in _sized_grams(words, sorted(set(own.tolist()) - {0})):
                owner = np.searchsorted(words.starts, at, "right") - 1
                keep = own[owner] == size
                grams, at, owner = grams[keep], at[keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams)),
                        pa.array(np.full(len(at), size), pa.int32()),
                        batch.column("item_id").take(pa.array(owner)).cast(pa.int64()),
                        pa.array(at - words.starts[owner]),
                        pa.array(words.counts[owner]),
                    ],
                    names=["gram", "size", "item_id", "item_pos", "item_words"],
                )

    schema = "gram long, size int, item_id long, item_pos long, item_words long"
    return items.select("item_id", "text").mapInArrow(run, schema)


def gram_hits(docs: DataFrame, sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """gram, _file, _row, pos: where documents have one of the known n-grams (None: any)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent.value is None else Known(sent.value)
        for batch in sliced(batches, "text"):
            words = normalised(split_words(batch.column("text")))
            for _, grams, at in _sized_grams(words, sizes):
                grams = signed(grams)
                if wanted:
                    keep = wanted.has(grams)
                    grams, at = grams[keep], at[keep]
                owner = np.searchsorted(words.starts, at, "right") - 1
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams), batch.column("_file").take(rows),
                        batch.column("_row").take(rows), pa.array(at - words.starts[owner]),
                    ],
                    names=["gram", "_file", "_row", "pos"],
                )

    schema = "gram long, _file long, _row long, pos long"
    return docs.select("_file", "_row", "text").mapInArrow(run, schema)


def rare_seeds(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """_file, _row, item_id, item_words, begin: one seed for each stretch and placement.

    Rarity is the number of places in all documents. Items share hot n-grams with
    many documents, so the items' side is broadcast where it has been counted to be
    small; beyond that the join shuffles and its skew is split at run time.
    """
    counts = hits.groupBy("gram").agg(F.count("*").alias("places"))
    placed = hits.join(small(seeds.join(counts, "gram")), "gram").select(
        *KEY, "item_id", "item_words", "places",
        (F.col("pos") - F.col("item_pos")).alias("begin"),
        F.floor(F.col("item_pos") / STRETCH).alias("stretch"),
    )
    place = F.floor(F.col("begin") / PLACE).alias("place")
    rarest = F.min(F.struct("places", "begin")).alias("seed")
    found = placed.groupBy(*KEY, "item_id", "item_words", place, "stretch").agg(rarest)
    return found.select(*KEY, "item_id", "item_words", F.col("seed.begin").alias("begin"))


class Known:
    """Membership in a sorted array; a table of bits settles most questions."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.mask = (1 << max(16, int(len(values)).bit_length() + 4)) - 1
        self.table = np.zeros(self.mask + 1, bool)
        self.table[values & self.mask] = True

    def has(self, asked: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(asked), bool)
        maybe = np.flatnonzero(self.table[asked & self.mask])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, asked[maybe]), len(self.values) - 1)
            keep[maybe[self.values[at] == asked[maybe]]] = True
        return keep


def passages(joined: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document with its hits into rows of item and passage."""
    for batch in sliced(joined, "text"):
        words = normalised(split_words(batch.column("text")))
        vocab = words.vocab
        files, rows, ids = (batch.column(c).to_pylist() for c in ("_file", "_row", "doc_id"))
        out = []
        for i, hits in enumerate(batch.column("hits").to_pylist()):
            first, last = int(words.starts[i]), int(words.starts[i + 1])
            spans: dict[int | None, list[list[int]]] = {}
            for item, begin, size in sorted(
                ((h["item_id"], h["begin"], h["item_words"]) for h in hits),
                key=lambda x: (x[0] is None, x[0] or 0, x[1]),
            ):
                slack = size // 4 + 4
                a, b = max(0, begin - slack), min(last - first, begin + size + slack)
                known = spans.setdefault(item, [])
                if known and a <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], b)
                else:
                    known.append([a, b])
            out += [
                (files[i], rows[i], ids[i], item, a, words.codes[first + a : first + b])
                for item, found in spans.items()
                for a, b in found
            ]
        columns = list(zip(*out, strict=True)) or [()] * 6
        parts = pa.array(np.concatenate(columns[5]) if out else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[5]])]), pa.int32()),
            vocab.take(parts),
        )
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:5]), lists],
            names=["_file", "_row", "doc_id", "item_id", "first", "passage"],
        )


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two code sequences, and where it begins and ends in `passage`.

    Row by row; a gap along the row is a running maximum. The start of each cell's
    alignment goes along with its score.
    """
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    above, above_from = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    # score and start in one number, so that a maximum carries the start along
    span = n + 1
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        diagonal = (above[:-1] + step) * span + above_from[:-1]
        up = (above[1:] + GAP) * span + above_from[1:]
        now = np.empty(n + 1, np.int64)
        now[0] = 0
        now[1:] = np.maximum(diagonal, up)
        fresh = np.arange(n + 1)  # score 0, starting here
        now = np.where(now // span > 0, now, fresh)
        run = np.maximum.accumulate((now // span + ramp) * span + now % span)
        scores = run // span - ramp
        above_from = np.where(scores > 0, run % span, fresh)
        above = np.maximum(scores, 0)
        top = int(above.argmax())
        if above[top] > best[0]:
            best = (int(above[top]), int(above_from[top]), top)
    return best


def scored(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align each item with its passage."""
    for batch in pairs:
        rows = []
        for item, passage, first in zip(
            batch.column("item").to_pylist(), batch.column("passage").to_pylist(),
            batch.column("first").to_pylist(), strict=True,
        ):
            names = {w: k for k, w in enumerate(dict.fromkeys(item))}
            a = np.array([names[w] for w in item], np.int64)
            b = np.array([names.get(w, -1) for w in passage], np.int64)
            score, begin, end = smith_waterman(a, b)
            rows.append((first + begin, first + end, score / (MATCH * len(item))))
        start, end, score = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("_file", "_row", "doc_id", "item_id")),
                pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64()),
            ],
            names=[c.split()[0] for c in LEAKS.split(", ")],
        )


def item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = normalised(split_words(batch.column("text")))
            lists = pa.ListArray.from_arrays(
                pa.array(words.starts, pa.int32()), words.vocab.take(pa.array(words.codes))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").cast(pa.int64()), lists], names=["item_id", "item"]
            )

    return items.select("item_id", "text").mapInArrow(run, "item_id long, item array<string>")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_score: float = LEAST_SCORE,
    n: int = SEED_WORDS,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """Where documents hold test items: a row for each aligned passage, as in LEAKS.

    `docs` must be keyed (rows.keyed). start and end count words of the
    normalised document. Null and empty texts on either side match nothing;
    items with the same text are all reported; a null item_id stays null.
    Repeated rows are reported one by one (they differ in `_file` and `_row`).
    """
    rows = docs.select("_file", "_row", F.col(key).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    items = (
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .where(F.col("text").isNotNull())
        .distinct()
    )
    seeds = written(item_seeds(items, n), "seeds")
    few = seeds.count() <= most_sent
    known = None
    if few:
        found = seeds.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)
        known = np.sort(found)
    sizes = [r["size"] for r in seeds.select("size").distinct().orderBy("size").collect()]
    hits = written(gram_hits(rows, sizes, known), "hits")
    rare = rare_seeds(hits, seeds)
    by_row = rare.groupBy(*KEY).agg(
        F.collect_set(F.struct("item_id", "begin", "item_words")).alias("hits")
    )
    cut = rows.join(by_row, list(KEY)).mapInArrow(
        passages,
        "_file long, _row long, doc_id long, item_id long, first long, passage array<string>",
    )
    same = F.col("i.item_id").eqNullSafe(F.col("p.item_id"))
    pairs = cut.alias("p").join(item_words(items).alias("i"), same).select("p.*", "i.item")
    return pairs.mapInArrow(scored, LEAKS).where(F.col("score") >= least_score)


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, score, start, end: the best passage for each of these pairs."""
    best = F.max(F.struct("score", (-F.col("start")).alias("early"), "end")).alias("best")
    return (
        leaks(keyed(docs), benchmark, **how)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id", "item_id", "best.score", (-F.col("best.early")).alias("start"), "best.end"
        )
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no test item, with the columns of `docs`, whatever their
    names. Null and empty texts hold none; equal rows stay or go together."""
    docs, named_back = aside_private(docs)
    rows = keyed(docs)
    bad = leaks(rows, benchmark, **how).select(*KEY).distinct()
    kept = rows.join(bad, list(KEY), "left_anti").select(*[f"`{c}`" for c in docs.columns])
    return named_back(kept)
