"""Cost-balanced packing of token ids into training sequences.

A document of n tokens costs ``linear * n + quadratic * n**2`` (feed-forward and
attention). Documents are packed in blocks of neighbouring rows, each block by
itself and inside one task, so nothing is shuffled and the ids are needed once.

In a block, whole sequences are first cut from documents longer than one. What
is left of the documents is assigned in descending order, each to the sequence
of least cost among those with room for it. Pieces that fit nowhere are cut to
fill the room that is left. The last, incomplete sequence of a block is split
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from bindery.llm.blocks import give_back, offsets, sliced, split_words

CAPACITY = 4096
PACK_BYTES = 8 << 20
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Bytes of words whose ids a task remembers, with what Python needs for each; then
#: it starts anew.
REMEMBERED, PER_WORD = 24 << 20, 120
NO_SEQUENCE = (float("inf"), -1)

#: A word of Latin letters and the marks behind it are split by the tokenizer
#: anyway, and letters of this range are lowered one by one.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, cost double"
)


class Ids:
    """Token ids of texts, worked out once for each distinct word.

    The tokenizer takes white space out and never joins characters across it,
    so the ids of a text are those of its words in a row.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self._starts, self._flat = np.zeros(1024, np.int64), np.empty(4096, np.int32)

    @property
    def starts(self) -> np.ndarray:
        return self._starts[: len(self.known) + 1]

    @property
    def flat(self) -> np.ndarray:
        return self._flat[: self.starts[-1]]

    def _learn(self, keys: list[str], plain: bool) -> None:
        if plain:  # one word each, so the merges alone are needed
            merges = self.model.model.tokenize
            spelt = (k if k.isascii() else k.translate(self.bytes) for k in keys)
            lists = [[t.id for t in merges(k)] for k in spelt]
        else:
            lists = [e.ids for e in self.model.encode_batch_fast(keys, add_special_tokens=False)]
        base, size = len(self.known), len(self.flat)
        ends = size + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        self._starts = _grown(self._starts, base + 1 + len(keys))
        self._starts[base + 1 : base + 1 + len(keys)] = ends
        self._flat = _grown(self._flat, int(ends[-1]))
        self._flat[size : ends[-1]] = np.fromiter((x for y in lists for x in y), np.int32)
        self.known.update(zip(keys, range(base, base + len(keys)), strict=True))
        self.held += sum(map(len, keys)) + PER_WORD * len(keys)

    def _lookup(self, keys: pa.Array, plain: bool) -> np.ndarray:
        coded = keys.dictionary_encode()
        names = coded.dictionary.to_pylist()
        find = self.known.get
        at = np.array([find(k, -1) for k in names], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([names[i] for i in new], plain)
        return at[coded.indices.to_numpy()]

    def _entries(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word one or two entries in a row, and where each word's begin."""
        parts = pc.extract_regex(vocab, PLAIN)
        is_plain = parts.is_valid().to_numpy(zero_copy_only=False)
        pairs = np.full((len(vocab), 2), -1)
        if is_plain.any():
            parts = parts.filter(pa.array(is_plain))
            pairs[is_plain, 0] = self._lookup(pc.utf8_lower(parts.field("word")), True)
            marks = parts.field("marks")
            marked = pc.not_equal(marks, "").to_numpy(zero_copy_only=False)
            found = self._lookup(marks.filter(pa.array(marked)), True)
            pairs[np.flatnonzero(is_plain)[marked], 1] = found
        if not is_plain.all():
            pairs[~is_plain, 0] = self._lookup(vocab.filter(pa.array(~is_plain)), False)
        return pairs[pairs >= 0], offsets(1 + (pairs[:, 1] >= 0))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text starts."""
        if self.held > REMEMBERED:
            self.forget()
        words = split_words(texts)
        entries, first = self._entries(words.vocab)
        sizes = np.diff(self.starts)[entries]
        at = offsets(sizes)
        flat = self.flat[spans(self.starts[entries], sizes)]
        begins, counts = at[first[:-1]], np.diff(at[first])
        lengths = counts[words.codes]
        return flat[spans(begins[words.codes], lengths)], offsets(lengths)[words.starts]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """With room for `size`: at least doubled, so growing costs little on the whole."""
    return array if size <= len(array) else np.resize(array, max(size, 2 * len(array)))


def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for as long as lengths[0] says, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)


@lru_cache(1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cost(length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * length + quadratic * length * length


class Rooms:
    """Sequences by the room they have; finds the least (cost, sequence) with room for n.

    A tree over rooms holds in each node the least entry of those below it.
    """

    def __init__(self, count: int, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least = [NO_SEQUENCE] * (2 * self.size)
        self.heaps[capacity] = [(0.0, b) for b in range(count)]
        self._update(capacity)

    def _update(self, room: int) -> None:
        at = self.size + room
        self.least[at] = self.heaps[room][0] if self.heaps[room] else NO_SEQUENCE
        while at > 1:
            at //= 2
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def find(self, n: int) -> tuple[float, int]:
        """The least entry with a room of n or more."""
        at = self.size + n
        best = self.least[at]
        while at > 1:
            if at % 2 == 0:
                best = min(best, self.least[at + 1])
            at //= 2
        return best

    def fill(self, room: int, n: int, spent: float) -> None:
        """Put n into the least sequence of this very room."""
        was, b = heapq.heappop(self.heaps[room])
        heapq.heappush(self.heaps[room - n], (was + spent, b))
        self._update(room)
        self._update(room - n)


def assign(
    lengths: np.ndarray, capacity: int, linear: float, quadratic: float
) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length).

    All but the last are full; only documents that fit nowhere whole, or are
    longer than a sequence, are cut.
    """
    whole, rest = [], []
    for doc, n in enumerate(lengths.tolist()):
        full = n // capacity
        whole += [[(doc, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(n for n, _, _ in rest) // capacity)
    open_: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    room = [capacity] * bins
    rooms = Rooms(bins, capacity)
    over = []
    for n, doc, start in rest:
        _, b = rooms.find(n)
        if b < 0:
            over.append((n, doc, start))
            continue
        open_[b].append((doc, start, n))
        rooms.fill(room[b], n, cost(n, linear, quadratic))
        room[b] -= n
    b = 0
    order = sorted(range(bins), key=lambda x: room[x])
    for n, doc, start in over:
        while n:
            while not room[order[b]]:
                b += 1
            take = min(n, room[order[b]])
            open_[order[b]].append((doc, start, take))
            room[order[b]] -= take
            n, start = n - take, start + take
    # one sequence holds all the room that is left: shift pieces from the end into gaps
    gaps = sorted((x for x in range(bins) if room[x]), key=lambda x: room[x])
    while len(gaps) > 1:
        last, gap = gaps[-1], gaps[0]
        doc, start, n = open_[last].pop()
        take = min(n, room[gap])
        open_[gap].append((doc, start, take))
        room[gap] -= take
        room[last] += take
        if n > take:
            open_[last].append((doc, start + take, n - take))
        gaps = [x for x in gaps if room[x] and open_[x]]
        gaps.sort(key=lambda x: room[x])
    return whole + [open_[x] for x in range(bins) if open_[x] and not room[x]] + [
        open_[x] for x in range(bins) if open_[x] and room[x]
    ]


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Split an incomplete sequence into ones whose lengths are powers of two."""
    total = sum(n for _, _, n in pieces)
    left = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    now: list[tuple[int, int, int]] = []
    for doc, start, n in pieces:
        while n:
            take = min(n, left[0] - sum(x[2] for x in now))
            now.append((doc, start, take))
            n, start = n - take, start + take
            if sum(x[2] for x in now) == left[0]:
                yield now
                now, left = [], left[1:]


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    block_bytes: int = PACK_BYTES,
) -> DataFrame:
    """One row for each piece, as in PIECES; `docs` may have any other columns.

    A null text counts as empty, so its only id is the end mark. Repeated rows
    are packed once each. Sequence ids are unique: the task's number and a
    count. They follow the partitions of `docs`, which for files are the same
    on a retry; give a stored table where they have to be the same for ever.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_for = ids_of(tokenizer)
        try:
            yield from packed_pieces(batches, ids_for)
        finally:  # the worker lives on with other work
            ids_for.forget()
            give_back()

    def packed_pieces(
        batches: Iterator[pa.RecordBatch], ids_for: Ids
    ) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        for batch in sliced(gathered(batches, text, block_bytes), text, block_bytes):
            ids, starts = ids_for(batch.column(text))
            count = np.diff(starts)
            # the end mark behind each document
            marked = np.full(len(ids) + len(count), END_ID, "<u4")
            marked[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
            begins, lengths = starts[:-1] + np.arange(len(count)), count + 1
            names = batch.column(key).cast(pa.int64()).to_pylist()
            rows = []
            packed = assign(lengths, capacity, linear, quadratic)
            full = sum(n for _, _, n in packed[-1]) in (0, capacity) if packed else True
            whole, last = (packed, []) if full else (packed[:-1], packed[-1])
            raw = memoryview(marked.tobytes())
            for pieces in [*whole, *powers_of_two(last)]:
                size = sum(n for _, _, n in pieces)
                spent = sum(cost(n, linear, quadratic) for _, _, n in pieces)
                place = 0
                for doc, start, n in pieces:
                    first = 4 * (int(begins[doc]) + start)
                    crc = zlib.crc32(raw[first : first + 4 * n])
                    rows.append(
                        (names[doc], start, n, crc, int(lengths[doc]), sequence, place, size, spent)
                    )
                    place += n
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64()] * 8 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[p.split()[0] for p in PIECES.split(", ")],
            )

    return docs.select(key, text).mapInArrow(run, PIECES)


def gathered(
    batches: Iterator[pa.RecordBatch], text: str, least: int
) -> Iterator[pa.RecordBatch]:
    """Join small batches until they hold `least` bytes of text, or none are left."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if size >= least:
            yield from joined(held)
            held, size = [], 0
    yield from joined(held)


def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
