"""Words of whole batches of texts as arrays.

A word is a run of characters other than ASCII white space. A block of texts is
split and dictionary-encoded by Arrow, so work on characters is done once for
each distinct word of the block, and work on positions is done by numpy.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 6 << 20


def sliced(
    batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece have `max_bytes` at most.

    A text that is larger by itself makes a piece of its own. Memory that is held
    for later is given back, as workers live on from task to task.
    """
    try:
        for batch in batches:
            yield from _sliced(batch, column, max_bytes)
            pa.default_memory_pool().release_unused()
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _sliced(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        first, base = 0, 0
        while first < len(ends):
            last = max(int(np.searchsorted(ends, base + max_bytes, "right")), first + 1)
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])


@dataclass
class Words:
    """codes: the word at each position, as an index of `vocab`; the words of
    text i are those from starts[i] to starts[i + 1]."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """The text of each position."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def kept_positions(starts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """New starts after the positions with a false `keep` are left out."""
    return offsets(keep)[starts]


def _encoded(lists: pa.Array) -> Words:
    flat = lists.flatten()
    codes = flat.dictionary_encode()
    starts = offsets(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return Words(codes.indices.to_numpy().astype(np.int64), starts, codes.dictionary)


def without(words: Words, drop: np.ndarray) -> Words:
    """Leave out the words whose vocabulary entry is flagged."""
    if not drop.any():
        return words
    keep = ~drop[words.codes]
    return Words(words.codes[keep], kept_positions(words.starts, keep), words.vocab)


def split_words(texts: pa.Array) -> Words:
    """Words of each text; null is taken as empty."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = _encoded(pc.ascii_split_whitespace(texts))
    return without(words, pc.equal(words.vocab, "").to_numpy(zero_copy_only=False))


def split_lines(texts: pa.Array) -> Words:
    """Lines between line feeds, empty ones included; null is taken as empty."""
    return _encoded(pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n"))


def normalised(words: Words) -> Words:
    """Words in lower case without punctuation around them; bare punctuation goes."""
    if not len(words.vocab):
        return words
    lower = pc.utf8_lower(words.vocab)
    plain = pc.replace_substring_regex(lower, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    coded = plain.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)[words.codes]
    words = Words(codes, words.starts, coded.dictionary)
    return without(words, pc.equal(words.vocab, "").to_numpy(zero_copy_only=False))


# -- hashing ------------------------------------------------------------------

# The increment and multipliers of the SplitMix64 finaliser.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64: spread 64-bit numbers."""
    x = np.asarray(x, np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of UTF-8 strings: bytes times one random factor a position."""
    strings = pa.concat_arrays([strings]) if strings.offset else strings
    if not len(strings):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    factors = mix(np.arange(int(sizes.max(initial=0)) + 1)) | np.uint64(1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * factors[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64) * _M1)


def word_hashes(words: Words) -> np.ndarray:
    """The hash of the word at each position."""
    return hash_strings(words.vocab)[words.codes]


def ngram_hashes(
    hashes: np.ndarray, starts: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside single texts, and the position of each."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        grams = mix(grams * _M2 + hashes[k : len(hashes) - n + 1 + k])
    ends = np.repeat(starts[1:], np.diff(starts))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + n <= ends)
    return grams[at], at


def signed(hashes: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return hashes.view(np.int64)
