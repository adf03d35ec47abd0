"""Stupid-backoff scores of all documents, from n-gram counts over all documents.

Documents are dealt into blocks. Each block sends its distinct n-grams with
their counts to the buckets that their hashes fall into; a bucket adds up what
all blocks have sent and answers each block; the block then scores its
documents. So the count tables are partitioned by hash, an n-gram crosses the
network once for a block and not once for an occurrence, and what is gathered
grows with the corpus while each block and bucket stays small.

A document is scored by the counts of all the others: its own occurrences are
taken off, else every n-gram would have been seen and nothing would back off.
Exact copies are other documents.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from bindery.llm.blocks import Words, mix, ngram_hashes, normalised, split_words, word_hashes
from bindery.llm.rows import KEY, keyed

ORDER = 3
ALPHA = 0.4
#: Bytes of text in a block; pieces sent number blocks x buckets, so take more on large machines.
BLOCK_BYTES = 10 << 20

SENT = "block long, bucket long, grams binary, counts binary"
SCORES = "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long"


def packed(numbers: np.ndarray) -> bytes:
    """Integers by byte planes; high planes of small numbers vanish."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def grams_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside texts and their positions; n = 0: zero for each word."""
    if n == 0:
        return np.zeros(len(words.codes), np.uint64), np.arange(len(words.codes))
    grams, at = ngram_hashes(word_hashes(words), words.starts, n)
    return mix(grams + np.uint64(n)), at


def ask(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """The distinct n-grams of a block, sorted, cut into pieces by bucket."""
    words = normalised(split_words(table.column("text").combine_chunks()))
    found = [np.unique(grams_of(words, n)[0], return_counts=True) for n in range(order + 1)]
    grams = np.concatenate([g for g, _ in found])
    counts = np.concatenate([c for _, c in found])
    by = np.argsort(grams, kind="stable")
    grams, counts = grams[by], counts[by]
    block = table.column("block")[0].as_py()
    cuts = bucket_cuts(grams, buckets)
    some = np.flatnonzero(np.diff(cuts))
    pieces = [slice(int(cuts[b]), int(cuts[b + 1])) for b in some]
    first = [np.diff(grams[p], prepend=np.uint64(0)) for p in pieces]
    return pa.table(
        {
            "block": pa.array([block] * len(some), pa.int64()),
            "bucket": pa.array(some, pa.int64()),
            "grams": pa.array([packed(x) for x in first], pa.binary()),
            "counts": pa.array([packed(counts[p]) for p in pieces], pa.binary()),
        }
    )


def bucket_cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes begins in sorted hashes."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    inner = np.searchsorted(grams, np.array(edges, np.uint64), "left")
    return np.concatenate([[0], inner, [len(grams)]])


def answer(table: pa.Table) -> pa.Table:
    """Total counts of a bucket's n-grams, in the order in which each block asked."""
    asked = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    counts = [unpacked(x) for x in table.column("counts").to_pylist()]
    grams, entry = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(grams), np.uint64)
    np.add.at(total, entry, np.concatenate(counts))
    ends = np.cumsum([len(x) for x in asked])
    replies = [packed(total[e]) for e in np.split(entry, ends[:-1])]
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "totals": pa.array(replies, pa.binary()),
        }
    )


class Sorted:
    """The n-grams of a block in order of hash, and then of place."""

    def __init__(self, words: Words, n: int):
        grams, self.at = grams_of(words, n)
        self.order = np.argsort(grams, kind="stable")
        grams = grams[self.order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        self.distinct, self.entry = grams[new], np.cumsum(new) - 1
        # within an n-gram places rise, so those of one document are together
        owner = words.owners()[self.at[self.order]]
        new[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(grams)))
        self.own = np.repeat(size, size)

    def others(self, size: int, totals: np.ndarray) -> np.ndarray:
        """For each position the count in other documents of the n-gram that begins there, else -1."""
        out = np.full(size, -1, np.int64)
        out[self.at[self.order]] = totals[self.entry] - self.own
        return out


def counts_elsewhere(words: Words, order: int, parts: list[bytes]) -> dict[int, np.ndarray]:
    """By n what `Sorted.others` gives; `parts`: the buckets' answers in order of hash."""
    found = {n: Sorted(words, n) for n in range(1, order + 1)}
    # the one 0-gram has the least hash, 0, and stands for every word
    known = np.sort(np.concatenate([x.distinct for x in found.values()]))
    totals = [unpacked(x).astype(np.int64) for x in parts]
    totals = np.concatenate(totals) if totals else np.empty(0, np.int64)
    if len(totals) != len(known) + bool(len(words.codes)):
        raise ValueError("a block got fewer answers than it asked for")
    count = {0: (totals[0] if len(totals) else 0) - np.repeat(words.counts, words.counts)}
    for n in list(found):
        x = found.pop(n)
        count[n] = x.others(len(words.codes), totals[1 + np.searchsorted(known, x.distinct)])
    return count


def score(table: pa.Table, replies: pa.Table, order: int, alpha: float) -> pa.Table:
    """Sum the log scores of each document of a block."""
    words = normalised(split_words(table.column("text").combine_chunks()))
    parts = replies.sort_by("bucket").column("totals").to_pylist()
    count = counts_elsewhere(words, order, parts)
    here = np.arange(len(words.codes)) - np.repeat(words.starts[:-1], words.counts)
    logs = np.full(len(words.codes), np.nan)
    backed = np.zeros(len(words.codes), np.int64)
    for n in range(order, 0, -1):
        # the n-gram that ends at a position begins n - 1 before it
        ends = np.flatnonzero(np.isnan(logs) & (here >= n - 1))
        hits = count[n][ends - n + 1]
        seen = hits > 0
        at = ends[seen]
        context = count[n - 1][at - n + 1]
        logs[at] = np.log(hits[seen]) - np.log(context) + backed[at] * np.log(alpha)
        backed[ends[~seen]] += 1
    # a word no other document has: as if it had been seen less than once
    rest = np.flatnonzero(np.isnan(logs))
    logs[rest] = backed[rest] * np.log(alpha) - np.log(np.maximum(count[0][rest], 0) + 1)
    sums = [float(logs[a:b].sum()) for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
    sizes = words.counts
    steps = np.concatenate([[0], np.cumsum(backed > 0)])
    means = [s / n if n else None for s, n in zip(sums, sizes.tolist(), strict=True)]
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(sizes, pa.int64()),
            "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array(means, pa.float64()),
            "n_backed_off": pa.array(np.diff(steps[words.starts]), pa.int64()),
        }
    )


def scored(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    order: int = ORDER,
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_backed_off: one row per document.

    Words are compared in lower case without punctuation around them. Texts
    that are null or have no words score 0 with a null mean. Repeated rows are
    scored one by one. With no documents there are no rows.
    """
    rows = keyed(docs).select(
        *KEY, F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(
        F.pmod(F.xxhash64(*KEY), F.lit(blocks)).alias("block"), "doc_id", "text"
    ).repartition(parts, "block")
    sent = dealt.groupBy("block").applyInArrow(lambda t: ask(t, order, blocks), SENT)
    schema = "block long, bucket long, totals binary"
    replies = sent.groupBy("bucket").applyInArrow(answer, schema)
    return (
        dealt.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(lambda t, r: score(t, r, order, alpha), SCORES)
    )
