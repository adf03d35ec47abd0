"""Exact substring dedup: bytes of strings of a given length that occur twice.

Suffixes are sorted by way of a cover, as difference-cover sorting does it, with
two changes that make it fit for a cluster. The cover is set by content and not
by position: the sample of a string is its least hashed 8-gram among its first
`w`, so equal strings have equal samples wherever they lie, and a sample stands
for a whole range of starts. And only the order of prefixes of the given length
matters, so names that are unique are dropped at once and never sorted again.

1. Sample: all starts with the same sampled place make one range. It gets a
   triple of names: what all strings sampled there have in common, everything
   the range covers, and the place.
2. Sort the triples and compare neighbours. If a whole range is found twice, all
   its strings are; if not even the common part is, none is.
3. Recurse on what is left with a denser cover, over the few slices of text that
   are still open, until each range is a single string.
4. Merge the verdicts of all levels back into the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from bindery.llm.blocks import mix
from bindery.llm.rows import KEY, aside, keyed
from bindery.session import written

LENGTH = 200
#: Bytes that one place of a sample is hashed from.
GRAM = 8
#: Places that a sample is chosen from, level by level; the last is each string itself.
COVERS = (160, 16, 1)
#: Bytes of text that a task works on at once; a longer text is read in overlapping parts.
PART = 1 << 20

# Odd factors of two independent families of names.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

RANGE = "core long, full long, _file long, _row long, lo int, hi int, many boolean"
ADDED = (
    "n_bytes long, n_removed long, n_spans long, "
    "spans array<struct<start: long, end: long>>, kept binary"
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Names:
    """Names of any strings of GRAM bytes and more within a stretch of bytes."""

    def __init__(self, data: bytes):
        n = len(data)
        padded = np.frombuffer(data + bytes(GRAM), np.uint8)
        self.grams = mix(np.ndarray((n,), "<u8", padded.data, strides=(1,)).copy())
        self.sums, self.backs = [], []
        for base in BASES:
            terms = self.grams * _powers(base, n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self.backs.append(_powers(pow(base, -1, 1 << 64), n))

    def of(self, first: np.ndarray, end: np.ndarray, family: int, salt: np.ndarray) -> np.ndarray:
        sums, back = self.sums[family], self.backs[family]
        name = (sums[end - GRAM + 1] - sums[first]) * back[first]
        return mix(mix(name) ^ salt.astype(np.uint64))

    def sampled(self, width: int) -> np.ndarray:
        """For each place the place of the least gram among `width`; the last one of equals."""
        n = len(self.grams)
        if width == 1:
            return np.arange(n)
        back = np.arange(n - 1, -1, -1).astype(np.uint64)
        least, span = (self.grams & np.uint64(0xFFFFFFFF00000000)) | back, 1
        while span < width and len(least):
            step = min(span, width - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        return n - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ranges(parts: list[bytes], width: int, length: int) -> dict[str, np.ndarray]:
    """Ranges of starts with one sample, each with its names, of each part.

    Of equal ranges within a part the first stands for all, marked `many`; the
    starts of all of them come once more, joined where they touch, as ranges of
    names of their own.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    names = Names(b"".join(parts))
    sample = names.sampled(width)
    at = np.arange(len(sample))
    part = np.repeat(np.arange(len(parts)), sizes)[: len(sample)]
    at = at[at + length <= ends[part]]
    sample, part = sample[at], part[at]
    if not len(at):
        none = np.empty(0, np.int64)
        return dict.fromkeys(("core", "full", "part", "lo", "hi", "many"), none)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(sample) != 0) | (np.diff(part) != 0)]))
    lo, hi = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    place, part = sample[new], part[new]
    core = names.of(place, place + length + 1 - width, 0, np.zeros(len(new)))
    full = names.of(lo, hi + length, 1, (place - lo) * 2 * length + hi - lo)
    order = np.lexsort((lo, full, core, part))
    a, b = order[:-1], order[1:]
    same = (part[a] == part[b]) & (core[a] == core[b]) & (full[a] == full[b])
    later = np.concatenate([[False], same])
    twice = later | np.concatenate([same, [False]])
    firsts = order[~later]
    many = np.zeros(len(new), bool)
    many[order[twice]] = True
    # starts of ranges found again in their part, joined where they touch
    at = np.flatnonzero(many)
    apart = (np.diff(part[at]) != 0) | (lo[at[1:]] != hi[at[:-1]] + 1)
    cut = np.flatnonzero(np.concatenate([[True], apart]))[: len(at)]
    last = at[np.concatenate([cut[1:] - 1, [len(at) - 1]])] if len(at) else at
    first = at[cut]
    own = mix(core[first] ^ mix(full[first]))
    begin = (ends - sizes)[np.concatenate([part[firsts], part[first]])]
    return {
        "core": np.concatenate([core[firsts], own]).view(np.int64),
        "full": np.concatenate([full[firsts], mix(lo[first])]).view(np.int64),
        "part": np.concatenate([part[firsts], part[first]]),
        "lo": np.concatenate([lo[firsts], lo[first]]) - begin,
        "hi": np.concatenate([hi[firsts], hi[last]]) - begin,
        "many": np.concatenate([many[firsts], np.ones(len(first), bool)]),
    }


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, place in the text, bytes) of up to PART bytes at a time."""
    held, size = [], 0
    for row, data in enumerate(batch.column("data")):
        buffer = data.as_buffer()
        for start in range(0, max(0, len(buffer) - length + 1), PART):
            part = buffer[start : start + PART + length - 1].to_pybytes()
            if held and size + len(part) > PART:
                yield held
                held, size = [], 0
            held.append((row, start, part))
            size += len(part)
    if held:
        yield held


def named(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The ranges of all pieces (KEY, base, data), as RANGE."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in KEY]
            base = batch.column("base").to_numpy()
            for held in _parts(batch, length):
                found = ranges([p for _, _, p in held], width, length)
                row = np.array([r for r, _, _ in held])[found["part"]]
                first = np.array([s for _, s, _ in held])[found["part"]] + base[row]
                columns = [
                    found["core"], found["full"], *(k[row] for k in keys),
                    (found["lo"] + first).astype(np.int32), (found["hi"] + first).astype(np.int32),
                    found["many"].astype(bool),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=[p.split()[0] for p in RANGE.split(", ")]
                )
            pa.default_memory_pool().release_unused()

    return pieces.select(*KEY, "base", "data").mapInArrow(task, RANGE)


def judged(found: DataFrame) -> DataFrame:
    """KEY, lo, hi of ranges that are `gone`, being found twice, or still `open`.

    Ranges are sorted by their names and compared with their neighbours. Of
    equal ranges one stays open if a range with the same common part does.
    """
    same_core = Window.partitionBy("core")
    order = same_core.orderBy("full", "many", *KEY, "lo")
    before = F.lag("full").over(order).eqNullSafe(F.col("full"))
    after = F.lead("full").over(order).eqNullSafe(F.col("full"))
    found = found.withColumns({"_before": before, "_gone": F.col("many") | before | after})
    found = found.withColumns(
        {
            "_lone": F.max(~F.col("_gone")).over(same_core),
            "_kinds": F.min("full").over(same_core) != F.max("full").over(same_core),
        }
    )
    open_ = ~F.col("_before") & F.col("_kinds") & F.col("_lone")
    return found.select(*KEY, "lo", "hi", F.col("_gone").alias("gone"), open_.alias("open")).where(
        "gone OR open"
    )


def _by_text(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))


def _joined_ranges(found: list[dict], length: int = 1) -> list[tuple[int, int]]:
    """Ranges [lo, hi + length), sorted and joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted((r["lo"], r["hi"] + length) for r in found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def cut(pieces: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The slices of `pieces` that hold the strings of the open ranges."""
    spec = "_file long, _row long, base int, data binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, row, base = (batch.column(c).to_pylist() for c in (*KEY, "base"))
            data, found = batch.column("data"), batch.column("_ranges").to_pylist()
            out = []
            for i, spans in enumerate(found):
                text = data[i].as_buffer()
                starts = len(text) - length + 1
                for lo, end in _joined_ranges(spans):
                    a, b = max(lo - base[i], 0), min(end - base[i], starts)
                    if a < b:
                        piece = text[a : b + length - 1].to_pybytes()
                        out.append((file[i], row[i], base[i] + a, piece))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[*KEY, "base", "data"],
            )

    both = pieces.join(_by_text(open_), list(KEY))
    return both.select(*KEY, "base", "data", "_ranges").mapInArrow(task, spec)


def repeated(docs: DataFrame, length: int, covers: tuple[int, ...]) -> DataFrame:
    """KEY, lo, hi: the starts of the strings that also start elsewhere."""
    data = F.col("text").cast("binary").alias("data")
    pieces = docs.where(F.octet_length("text") >= length).select(*KEY, F.lit(0).alias("base"), data)
    gone = []
    widths = [w for w in covers if w + GRAM - 1 <= length]
    for width in widths:
        verdicts = written(judged(named(pieces, width, length)), "verdicts")
        gone.append(verdicts.where("gone").select(*KEY, "lo", "hi"))
        if width > 1:
            pieces = written(cut(pieces, verdicts.where("open"), length), "slices")
    return reduce(DataFrame.union, gone)


def cleaned(
    docs: DataFrame, length: int = LENGTH, covers: tuple[int, ...] = COVERS
) -> DataFrame:
    """`docs` without the bytes of strings of `length` bytes that occur twice.

    Every byte goes that lies in a string of `length` bytes which also starts
    anywhere else, in the same text or another, be it overlapping; none is kept
    as a first one. Strings never cross texts. Added are n_bytes, n_removed,
    n_spans, the maximal `spans` removed (start, end in bytes) and the bytes
    `kept`, which need not be whole characters.

    A null text counts as empty; texts shorter than `length` are kept. Repeated
    rows are rows of their own, so all but short ones of them go. Ids are not
    looked at. Very long texts are read in overlapping parts. Columns of these
    names in `docs` are replaced, others go along, and an empty table stays
    empty. Equality is that of 128 bits of hashes.
    """
    if length < 2 * GRAM or covers[-1] != 1:
        raise ValueError("strings need 16 bytes, and the last cover is 1")
    added = StructType.fromDDL(ADDED)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in added.names])
    docs, named_back = aside(docs, *KEY, "_ranges")
    own = docs.schema.fields
    docs = keyed(docs)
    found = _by_text(repeated(docs, length, covers))
    schema = StructType([*own, *added])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            sizes = pc.binary_length(texts).to_pylist()
            spans = [_joined_ranges(r or [], length) for r in batch.column("_ranges").to_pylist()]
            kept = []
            for text, gone in zip(texts, spans, strict=True):
                data, end, left = text.as_buffer(), 0, []
                for a, b in gone:
                    left.append(data[end:a])
                    end = b
                kept.append(b"".join([*left, data[end:]]))
            new = [
                pa.array(sizes, pa.int64()),
                pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()),
                pa.array(list(map(len, spans)), pa.int64()),
                pa.array(
                    [[{"start": a, "end": b} for a, b in s] for s in spans],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ),
                pa.array(kept, pa.binary()),
            ]
            columns = [batch.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)
            pa.default_memory_pool().release_unused()

    whole = docs.join(found, list(KEY), "left").select(*[f"`{f.name}`" for f in own], "_ranges")
    return named_back(whole.mapInArrow(task, schema))
