"""Ranked lexical search: the best documents of each item, by classes of equal bags.

A term is a run of ASCII letters and digits and of all characters beyond ASCII,
with A to Z in lower case. An item's score of a document depends on the
document's counts of the item's terms and on its length alone. So documents are
restricted to the terms of the items, and those with the same counts and the
same length norm form a class, which is scored once. Each item keeps its best
classes, and the members of these are expanded by ascending id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.llm.blocks import Words, offsets, sliced, split_words
from bindery.session import written

K = 10
#: Terms of items that are held in memory at once; more items take more passes.
SLICE_TERMS = 500_000
#: Scores that a task holds at once.
CELLS = 1 << 22

# Of the length norm and of the saturation of counts.
NORM_BASE, NORM_SLOPE, UNIT, TIMES, DAMPING = 10, 90, 1_000_000_000, 1000, 8

IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Each byte as it is in a term, blank where no term has it.
FOLDED = np.array(
    [b + 32 * (65 <= b <= 90) if IS_TERM[b] else 32 for b in range(256)], np.uint8
)


def split_terms(texts: pa.Array) -> Words:
    """Terms of each text; null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, ends, data = texts.buffers()
    if len(texts) and data:
        folded = pa.py_buffer(FOLDED[np.frombuffer(data, np.uint8)])
        texts = pa.StringArray.from_buffers(len(texts), ends, folded)
    return split_words(texts)


def item_bags(items: DataFrame) -> DataFrame:
    """item_id and `bag`: the distinct terms of each item, sorted, with blanks between."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = split_terms(batch.column("text"))
            terms = words.vocab.to_pylist()
            cuts = zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)
            bags = [" ".join(sorted({terms[c] for c in words.codes[a:b]})) for a, b in cuts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(bags, pa.string())], names=["item_id", "bag"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(task, f"item_id {kind}, bag string")


def document_bags(docs: DataFrame, vocab: pa.Array) -> DataFrame:
    """doc_id, n, and the counts `tfs` of the terms `ids` (ascending places in `vocab`).

    Documents without any term are left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = split_terms(batch.column("text"))
            place = pc.fill_null(pc.index_in(words.vocab, value_set=vocab), -1)
            ids = place.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
            known = ids >= 0
            key = words.owners()[known] * len(vocab) + ids[known]
            pairs, tfs = np.unique(key, return_counts=True)
            held = np.bincount(pairs // max(1, len(vocab)), minlength=batch.num_rows)
            starts = pa.array(offsets(held), pa.int32())
            found = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.counts),
                    *(
                        pa.ListArray.from_arrays(starts, pa.array(values, pa.int32()))
                        for values in (pairs % max(1, len(vocab)), tfs)
                    ),
                ],
                names=["doc_id", "n", "ids", "tfs"],
            )
            yield found.filter(pa.array(words.counts > 0))

    return docs.select("doc_id", "text").mapInArrow(
        task, "doc_id long, n long, ids array<int>, tfs array<int>"
    )


def norm(n_docs: int, n_terms: int) -> Column:
    """m of a document with `n` terms, free of overflow on the way."""
    big = f"cast({NORM_SLOPE} as decimal(38, 0)) * n * {n_docs}"
    return F.expr(f"{NORM_BASE} + ({big}) div {max(1, n_terms)}")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def classes(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Classes of equal counts and norm: m, ids, tfs, and the first `k` `members`.

    The hash spreads and sorts them; the counts themselves are part of the keys,
    so equal hashes of unequal bags stay apart. Each task cuts a class to its
    first members before the shuffle, so a class of any size is no hot key.
    """
    keys = ["hash", "m", "ids", "tfs"]
    m = norm(n_docs, n_terms).alias("m")
    held = bags.where(F.size("ids") > 0).select("doc_id", m, "ids", "tfs")
    held = held.withColumn("hash", F.xxhash64("m", "ids", "tfs"))
    order = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last())
    first = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    return first.groupBy(*keys).agg(members.getField("doc_id").alias("members")).drop("hash")


@dataclass
class Items:
    """A slice of items: their bags and terms, and for each term those that hold it."""

    bags: list[str]
    vocab: pa.Array
    holders: list[np.ndarray]

    @staticmethod
    def of(bags: list[str]) -> Items:
        holders: dict[str, list[int]] = {}
        for i, bag in enumerate(bags):
            for term in bag.split(" "):
                holders.setdefault(term, []).append(i)
        terms = pa.array(list(holders), pa.string())
        return Items(bags, terms, [np.array(h) for h in holders.values()])


class Best:
    """The `k` first classes of each item by score, then least member, seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.item = self.score = self.least = np.empty(0, np.int64)
        self.members: list[list[int | None]] = []
        self.limit = np.ones(len(items.bags), np.int64)

    def add(self, m: np.ndarray, ids: pa.ListArray, tfs: pa.ListArray, members: list[list]) -> None:
        starts = offsets(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        owner = np.repeat(np.arange(len(m)), np.diff(starts))
        term = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        part = self.weights[term] * (UNIT * tf // (TIMES * tf + DAMPING * m[owner]))
        order = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[order])) + 1
        scores = np.zeros((len(self.items.bags), len(m)), np.int64)
        for places in np.split(order, cuts) if len(order) else []:
            scores[np.ix_(self.items.holders[term[places[0]]], owner[places])] += part[places]
        if len(m) > self.k:
            best = np.partition(scores, len(m) - self.k, axis=1)[:, len(m) - self.k]
            self.limit = np.maximum(self.limit, best)
        item, at = np.nonzero(scores >= self.limit[:, None])
        first = np.iinfo(np.int64).max  # a null id comes last
        least = np.array([first if x[0] is None else x[0] for x in members], np.int64)
        pool = [*self.members, *members]
        which = np.concatenate([np.arange(len(self.members)), len(self.members) + at])
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[item[len(self.item) :], at]])
        least = np.concatenate([self.least, least[at]])
        order = np.lexsort((least, -score, item))
        begins = np.searchsorted(item[order], item[order], "left")
        keep = order[np.arange(len(order)) - begins < self.k]
        self.item, self.score, self.least = item[keep], score[keep], least[keep]
        self.members = [pool[i] for i in which[keep].tolist()]

    def rows(self) -> pa.RecordBatch:
        """bag, score and doc_id of the members of the classes kept."""
        sizes = np.array([len(x) for x in self.members], np.int64)
        bags = pa.array(self.items.bags, pa.string()).take(pa.array(np.repeat(self.item, sizes)))
        ids = pa.array([d for x in self.members for d in x], pa.int64())
        scores = pa.array(np.repeat(self.score, sizes))
        return pa.RecordBatch.from_arrays([bags, scores, ids], names=["bag", "score", "doc_id"])


def scored(found: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """bag, score, doc_id: from each task what may be among the `k` first of an item."""
    rows = max(1, CELLS // max(1, len(items.bags)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, weights, k)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                m, ids, tfs, members = (part.column(c) for c in ("m", "ids", "tfs", "members"))
                best.add(m.to_numpy(zero_copy_only=False), ids, tfs, members.to_pylist())
        yield best.rows()

    return found.select("m", "ids", "tfs", "members").mapInArrow(
        task, "bag string, score long, doc_id long"
    )


def ranked(docs: DataFrame, items: DataFrame, k: int = K, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its `k` first documents.

    Documents score above 0; equal scores rank by ascending doc_id, null ids
    last, and repeated ids count row by row. Null and empty texts, of documents
    as of items, have no terms and so no rows, as have empty tables. Each row of
    `items` is answered, repeated ones each for itself. Texts are read whole.
    Other columns of either table are not looked at.

    Items with the same terms are searched once. They are searched in slices
    whose terms number about `slice_terms` (a longer item makes a slice of its
    own size), so what is sent to the tasks is bounded however many there are.
    """
    spark = docs.sparkSession
    asked = written(item_bags(items).where(F.col("bag") != ""), "item-bags")
    distinct = written(asked.select("bag").distinct(), "distinct-bags")
    n_terms = distinct.agg(F.sum(F.size(F.split("bag", " ")))).first()[0] or 0
    slices = max(1, -(-n_terms // slice_terms))
    found = []
    for number in range(slices):
        mine = distinct.where(F.expr(f"pmod(xxhash64(bag), {slices})") == number)
        part = Items.of(sorted(r.bag for r in mine.collect()))
        if not part.bags:
            continue
        bags = written(document_bags(docs, part.vocab), "document-bags")
        n_docs, terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = bags.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
        df = {r["id"]: r["count"] for r in counts}
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(part.vocab))], np.int64)
        found.append(scored(classes(bags, n_docs, terms, k), part, weights, k))
    if not found:
        found = [spark.createDataFrame([], "bag string, score long, doc_id long")]
    best = reduce(DataFrame.union, found)
    order = Window.partitionBy("bag").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(best, "bag").select("item_id", "rank", "doc_id", "score")
