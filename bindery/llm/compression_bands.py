"""Quality rules by compression: zstandard ratios within bands that depend on length.

Repetitive text compresses too well, random text too badly. Each text is
compressed whole and in fixed chunks, and judged by the limits of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from bindery.llm.blocks import Words, mix, offsets, sliced, split_lines, split_words

LEVEL = 3
#: Bytes of texts that are worked on at once.
BLOCK_BYTES = 2 << 20
CHUNK = 4096
#: (bytes from which the row holds, least and greatest compressed / raw ratio)
#: Greatest ratios lie between those of clean prose and of noise of 64 symbols
#: (base64), which don't meet from 192 bytes on; noise of 16 symbols is like prose.
BANDS = (
    (0, 0.25, 1.30), (128, 0.25, 0.98), (192, 0.25, 0.92), (256, 0.25, 0.87), (512, 0.25, 0.77),
    (1024, 0.25, 0.72), (2048, 0.20, 0.70), (16384, 0.15, 0.65),
)
#: The same for chunks, which are compressed alone and so never see what lies before.
CHUNK_BANDS = ((0, 0.15, 0.70),)
#: Share of the chunks that may lie outside their band.
BAD_CHUNKS = 0.25

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()),
    ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()),
)
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


def limits(size: int, bands: tuple[tuple[int, float, float], ...]) -> tuple[float, float]:
    least, low, high = next(b for b in reversed(bands) if size >= b[0])
    return low, high


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(offsets(values)[starts])


def _symbols(texts: pa.Array) -> np.ndarray:
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    if not texts.buffers()[2]:
        return np.zeros(len(texts), np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    return _summed(is_symbol[np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]], ends)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    lines = split_lines(texts)
    blank = pc.equal(pc.ascii_trim_whitespace(lines.vocab), "").to_numpy(zero_copy_only=False)
    keep = ~blank[lines.codes]
    owner = lines.owners()[keep]
    pairs = np.unique(owner * max(1, len(lines.vocab)) + lines.codes[keep])
    distinct = np.bincount(pairs // max(1, len(lines.vocab)), minlength=len(texts))
    return np.bincount(owner, minlength=len(texts)) - distinct


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words in windows that are found twice or more in their text, the first included."""
    n = len(words.codes) - window + 1
    if n <= 0:
        return np.zeros(len(words.starts) - 1, np.int64)
    owner = words.owners()
    grams = mix(owner[:n].astype(np.uint64) ^ np.uint64(1 << 40))
    for k in range(window):
        grams = mix(grams ^ words.codes[k : n + k].astype(np.uint64))
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    order = at[np.argsort(grams[at], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    found = np.zeros(n, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    marks = np.zeros(len(words.codes) + 1, np.int64)
    marks[:n] += found
    marks[window:] -= found
    return _summed(np.cumsum(marks[:-1]) > 0, words.starts)


class Compressor:
    def __init__(self, level: int = LEVEL, chunk: int = CHUNK):
        self.chunk = chunk
        self.zstd = zstandard.ZstdCompressor(
            level=level, write_checksum=False, write_content_size=False
        )

    def ratio(self, data: bytes) -> float:
        return len(self.zstd.compress(data)) / len(data) if data else 1.0

    def judge(self, data: bytes) -> tuple[float, int, int, bool]:
        """Ratio, chunks, chunks outside their band, and whether the text stays."""
        ratio = self.ratio(data)
        low, high = limits(len(data), BANDS)
        fits, bad, chunks = low <= ratio <= high, 0, 0
        if len(data) > self.chunk:
            chunks = len(data) // self.chunk  # the last one takes what is left over
            for k in range(chunks):
                piece = data[k * self.chunk : (k + 1) * self.chunk if k + 1 < chunks else None]
                low, high = limits(len(piece), CHUNK_BANDS)
                bad += not low <= self.ratio(piece) <= high
        return ratio, chunks, bad, fits and bad <= BAD_CHUNKS * chunks


def measured(texts: pa.Array, judge: Compressor) -> list[pa.Array]:
    """The columns of FIELDS for a block of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words = split_words(texts)
    counts = words.counts
    chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False)
    repeats = repeated_words(words)
    failed = (counts < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * counts)
    raw = texts.cast(pa.binary()).to_pylist()
    ratio, chunks, bad, fits = zip(*map(judge.judge, raw), strict=True) if raw else ([],) * 4
    columns = (
        counts, _summed(chars[words.codes], words.starts), _symbols(texts), _repeated_lines(texts),
        repeats, list(map(len, raw)), ratio, chunks, bad, failed, ~failed & np.array(fits, bool),
    )
    return [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)]


def quality(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs`, followed by the measures and the verdict.

    A null or empty text has no words, so it fails. Measures are named as in
    SCHEMA with `prefix` before; choose one where `docs` has such columns.
    Map-only: rows are judged alone, whatever copies or ties there are.
    """
    schema = docs.schema
    names = [prefix + n for n, _ in FIELDS]
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}; give a prefix")
    added = ", ".join(f"`{prefix}{part.split()[0]}` {part.split()[1]}" for part in SCHEMA.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compressor()
        for batch in sliced(batches, text, BLOCK_BYTES):
            found = measured(batch.column(text), judge)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL(added).fields]))


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with the columns of `docs`."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return quality(docs, text, prefix).where(f"`{prefix}kept`").select(*docs.columns)
