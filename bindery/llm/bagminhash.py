"""Near-duplicates by BagMinHash signatures of 5-word shingle multisets.

Each shingle has, for every unit of weight and every register, a Poisson process
of its own; a register holds the earliest point over all shingles of a document,
so two documents agree in a register with a probability equal to their weighted
Jaccard similarity. Weights are cut into dyadic ranges [0,1), [1,2), [2,4), ...
One process serves a whole range and all registers: its points come in order
of time, each with a register and a level, and count only below the weight.
So a process ends as soon as it is later than what any register needs, and
most shingles end at their first point.

Signatures are cut into bands. Documents that share a band are candidates, and
the overlap of their multisets is then computed exactly. Where blocks hold many that
are not similar, sketches of the multisets tell most of these pairs before.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.blocks import (
    mix, ngram_hashes, normalised, offsets, signed, sliced, split_words, word_hashes,
)
from bindery.llm.linking import linked
from bindery.llm.rows import KEY, aside_private, keyed
from bindery.session import written

SHINGLE = 5
SIMILAR = 0.8
#: At a similarity of 0.8 a pair is found with probability 1 - (1 - 0.8**5)**20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Bytes of text that are signed or compared at once; about a hundred times as much memory.
BLOCK = 3 << 20
#: 64-bit words of a sketch: with 16 it tells pairs of documents of up to some 1500 words.
SKETCH = 16
#: The first time limit leaves a register empty with probability exp(-SLACK).
SLACK = 5.0


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams, repeated ones too, and the text of each.

    A text of fewer than n words has one shingle, all of its words; a text
    without words has none.
    """
    words = normalised(split_words(texts))
    hashes = word_hashes(words)
    grams, at = ngram_hashes(hashes, words.starts, n)
    owners = [np.searchsorted(words.starts, at, "right") - 1]
    parts = [grams]
    for size in range(1, n):
        grams, at = ngram_hashes(hashes, words.starts, size)
        owner = np.searchsorted(words.starts, at, "right") - 1
        short = words.counts[owner] == size
        parts.append(grams[short])
        owners.append(owner[short])
    return np.concatenate(parts), np.concatenate(owners)


def multisets(grams: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (owner, gram) with their counts, in order of owner."""
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return grams[first], owners[first], np.diff(np.append(first, len(grams)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _points(
    keys: np.ndarray, owners: np.ndarray, weights: np.ndarray, limit: np.ndarray, m: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell (owner * m + register), time and identity of all points up to each owner's limit."""
    ranges = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    which = np.repeat(np.arange(len(keys)), ranges)
    level = np.arange(len(which)) - np.repeat(offsets(ranges)[:-1], ranges)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.maximum(low, 1.0)
    state = mix(keys[which] + mix(level))
    owner, weight, end = owners[which], weights[which].astype(np.float64), limit[owners[which]]
    time = np.zeros(len(which))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(state):
        state = mix(state)
        time = time - np.log(_uniform(state)) / (width * m)
        stay = time <= end
        state, time, owner, weight, end, low, width = (
            x[stay] for x in (state, time, owner, weight, end, low, width)
        )
        draw = mix(state ^ np.uint64(0x5851F42D4C957F2D))
        register = ((draw >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        height = low + (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width
        ok = height < weight
        found.append((owner[ok] * m + register[ok].astype(np.int64), time[ok], draw[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(
    keys: np.ndarray, owners: np.ndarray, weights: np.ndarray, count: int, m: int
) -> np.ndarray:
    """count x m identities of the winning points; owners without shingles have zeros."""
    signature = np.zeros(count * m, np.uint64)
    total = np.bincount(owners, weights=weights, minlength=count)
    pending = total > 0
    limit = np.where(pending, (np.log(m) + SLACK) / np.maximum(total, 1), 0)
    while pending.any():
        own = pending[owners]
        cell, time, draw = _points(keys[own], owners[own], weights[own], limit, m)
        best = np.full(count * m, np.inf)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        done = pending & np.isfinite(best.reshape(count, m)).all(axis=1)
        take = np.flatnonzero(won)[done[cell[won] // m]]
        signature[cell[take]] = draw[take]
        pending &= ~done
        limit = limit * 2
    return signature.reshape(count, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    keys = mix(np.arange(bands, dtype=np.uint64))[None, :].repeat(len(signature), 0)
    for k in range(rows):
        keys = mix(keys ^ parts[:, :, k])
    return keys


def overlaps(pairs: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """a, b, similarity: the weighted Jaccard similarity of text_a and text_b."""
    for whole in pairs:
        for batch in sliced([whole], "text_a", BLOCK):
            sides = [shingles(batch.column(c), n) for c in ("text_a", "text_b")]
            grams = np.concatenate([g for g, _ in sides])
            owners = np.concatenate([o for _, o in sides])
            side = np.repeat([0, 1], [len(g) for g, _ in sides])
            order = np.lexsort((grams, owners))
            grams, owners, side = grams[order], owners[order], side[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
            entry = np.cumsum(new) - 1
            kinds = int(new.sum())
            left = np.bincount(entry[side == 0], minlength=kinds)
            right = np.bincount(entry[side == 1], minlength=kinds)
            of = owners[new]
            low = np.bincount(of, np.minimum(left, right), minlength=batch.num_rows)
            high = np.bincount(of, np.maximum(left, right), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(low / np.maximum(high, 1))],
                names=["a", "b", "similarity"],
            )


def parities(grams: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """count x SKETCH words: of each bit, whether an odd number of a text's shingles fall on it.

    Each shingle that one of two multisets has more often flips one bit, so no more
    bits differ than the multisets do.
    """
    place = mix(grams) >> np.uint64(32)
    word = owners * SKETCH + (place % np.uint64(SKETCH)).astype(np.int64)
    out = np.zeros(count * SKETCH, np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (place >> np.uint64(26)))
    return out.reshape(count, SKETCH)


def sketched(texts: DataFrame, n: int) -> DataFrame:
    """node, sketch (parities), total (shingles) for each row of (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BLOCK):
            grams, owners = shingles(batch.column("text"), n)
            sketch = parities(grams, owners, batch.num_rows)
            ends = pa.array(np.arange(batch.num_rows + 1) * SKETCH, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"),
                    pa.ListArray.from_arrays(ends, pa.array(signed(sketch.ravel()))),
                    pa.array(np.bincount(owners, minlength=batch.num_rows)),
                ],
                names=["node", "sketch", "total"],
            )

    return texts.mapInArrow(run, "node binary, sketch array<long>, total long")


def may_be_similar(similar: float) -> Column:
    """Whether the sketches of a pair leave it possible.

    With a weighted Jaccard similarity s, multisets of A and B shingles have
    (A + B) * s / (1 + s) in common, so they differ in (A + B) * (1 - s) / (1 + s).
    """
    apart = [
        F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH)
    ]
    most = (F.col("a_total") + F.col("b_total")) * ((1 - similar) / (1 + similar)) + 1e-6
    return functools.reduce(operator.add, apart) <= most


def banded(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """cls, keys for each row of (cls, text) whose text has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BLOCK):
            grams, owners, weights = multisets(*shingles(batch.column("text"), n))
            signature = signatures(grams, owners, weights, batch.num_rows, bands * rows)
            some = np.bincount(owners, minlength=batch.num_rows) > 0
            keys = band_keys(signature[some], bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls").filter(pa.array(some)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(keys) + 1) * bands, pa.int32()),
                        pa.array(signed(keys.ravel())),
                    ),
                ],
                names=["cls", "keys"],
            )

    return texts.mapInArrow(run, "cls binary, keys array<long>")


def groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    n: int = SHINGLE,
    similar: float = SIMILAR,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """_file, _row, doc_id, root for every row of keyed `docs`.

    Rows with equal texts are one class (`cls`, a digest) from the start;
    classes that are similar, directly or over others, share a root. A text
    that is null has a null root and belongs to no group; texts without words
    are near to nothing but their exact copies.
    """
    t = F.col(text).cast("string")
    rows = docs.select(
        *KEY, F.col(key).alias("doc_id"), t.alias("text"), F.unhex(F.md5(t)).alias("cls")
    )
    some = rows.where(F.col("text").isNotNull())
    classes = banded(some.select("cls", "text"), n, bands, band_rows).dropDuplicates(["cls"])
    blocks = classes.select(F.explode("keys").alias("key"), F.col("cls").alias("node"))
    first = some.groupBy("cls").agg(F.min(F.struct(*KEY)).alias("at"))
    held: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not held:  # the first round has every node that any later one has
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
            # one row of each class; the row's key in the join spreads its copies
            wanted = first.join(nodes, "cls").select("cls", "at.*")
            texts = some.join(wanted, ["cls", *KEY]).select("cls", "text")
            held.append(written(texts, "texts"))
        a = held[0].select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
        b = held[0].select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b")
        schema = "a binary, b binary, similarity double"
        return both.mapInArrow(lambda x: overlaps(x, n), schema).where(
            F.col("similarity") >= similar
        )

    found = linked(
        blocks, verify, "bagminhash", lambda: sketched(held[0], n), may_be_similar(similar)
    )
    return (
        rows.select(*KEY, "doc_id", "cls")
        .join(found, F.col("cls") == F.col("node"), "left")
        .select(*KEY, "doc_id", "cls", F.coalesce("root", "cls").alias("root"))
    )


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (least id of the group), group_rows: one row per document."""
    rows = written(groups(keyed(docs), **how), "groups")
    sizes = rows.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("group_rows")
    )
    return rows.join(sizes, "root", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("group_rows", F.lit(1)).alias("group_rows"),
    )


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of each group, that of the least (id, file, row), with the columns of `docs`.

    Rows without text all stay. Of a group whose ids are all null, or the same,
    the first row in its file stays. Columns may have any names, and an empty
    table stays empty.
    """
    docs, named_back = aside_private(docs)
    rows = keyed(docs)
    found = written(groups(rows, **how), "groups").where(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    kept = found.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("size"))
    kept = kept.where(F.col("size") > 1).select(
        "root", F.col("kept._file").alias("kept_file"), F.col("kept._row").alias("kept_row")
    )
    gone = found.join(kept, "root").where(
        (F.col("_file") != F.col("kept_file")) | (F.col("_row") != F.col("kept_row"))
    )
    return named_back(
        rows.join(gone.select(*KEY), list(KEY), "left_anti").select(
            *[f"`{c}`" for c in docs.columns]
        )
    )
