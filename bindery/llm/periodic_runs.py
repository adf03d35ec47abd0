"""Periodic runs of words, by recursive frequency splitting and lag scans.

A run is a stretch of words that repeats with a smallest period q, at least four
times over and over at least six words, as far as it goes. Each word of a run
then stands four times or more in it, so a word that occurs less often within a
segment can't belong to a run there and splits the segment. This is repeated on
the pieces until none changes. What survives is scanned by lag: lags below eight
word by word, others by blocks, whose matches name the lags worth extending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from bindery.llm.blocks import mix, offsets, sliced, split_words

#: A run has `LEAST` words and `TIMES` periods at least.
LEAST, TIMES = 6, 4
#: Lags from here on are found by blocks; a power of two.
BLOCK = 8

COLUMNS = (
    "n_runs long, start long, length long, period long, "
    "runs array<struct<start: long, length: long, period: long>>"
)

#: (ids, words of each text) -> for each text None or the word to take at each place.
Rewrite = Callable[[list, np.ndarray], list]


def surviving(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in stable segments, ascending, and the segment of each.

    `owner` is the text of each position. Only segments that have lost a word
    are looked at again, so words of settled segments are counted once.
    """
    at, seg = np.arange(len(codes)), owner
    done, labels, label = [], [], 0
    while len(at):
        key = seg * (int(codes.max()) + 1) + codes[at]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        stays = counts[which] >= TIMES
        lost = np.bincount(seg[~stays], minlength=int(seg[-1]) + 1) > 0
        at, seg = at[stays], seg[stays]
        if not len(at):
            break
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(seg) != 0)])
        piece = np.cumsum(new) - 1
        long_enough = np.bincount(piece) >= LEAST
        open_ = lost[seg] & long_enough[piece]
        settled = ~lost[seg] & long_enough[piece]
        done.append(at[settled])
        labels.append(piece[settled] + label)
        label += int(piece[-1]) + 1
        at, seg = at[open_], piece[open_]
        if len(seg):  # densely numbered again
            seg = np.concatenate([[0], np.cumsum(np.diff(seg) != 0)])
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, seg = np.concatenate(done), np.concatenate(labels)
    order = np.argsort(at)
    return at[order], seg[order]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each stretch of true flags."""
    edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _short_lags(codes: np.ndarray, seg: np.ndarray) -> dict[tuple[int, int], int]:
    """(first place, one past the last) -> period of the runs with periods below BLOCK."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(BLOCK, len(codes))):
        first, last = _stretches((codes[lag:] == codes[:-lag]) & (seg[lag:] == seg[:-lag]))
        long_enough = last + lag - first >= max(LEAST, TIMES * lag)
        for s, e in zip(first[long_enough].tolist(), last[long_enough].tolist(), strict=True):
            found.setdefault((s, e + lag), lag)  # a lag found before divides this one
    return found


def _agreeing(codes: np.ndarray, i: int, j: int) -> int:
    """How many places from i and from j > i on agree."""
    n, size = 0, 64
    while (size := min(size, len(codes) - j - n)) > 0:
        same = codes[i + n : i + n + size] == codes[j + n : j + n + size]
        if not same.all():
            return n + int(same.argmin())
        n, size = n + size, size * 2
    return n


def _long_lags(codes: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Add the runs with periods of BLOCK and more of one segment to `found`.

    A run of period q, size <= q < 2 * size, has four periods and so holds a
    block of 2 * size words that starts at a multiple of `size` and returns q
    words on. Each such block is compared with the blocks at those distances, in
    all about as many as there are words. Hashes only propose; what they propose
    is extended word by word. Blocks inside a run of a period p below `size`
    return at each multiple of p; of these only the distances that bring its
    start or its end upon that of another run can belong to a longer period.
    """
    n, size = len(codes), BLOCK
    hashes, span = mix(codes.astype(np.uint64)), 1
    back = codes[::-1]
    while TIMES * size <= n:
        while span < 2 * size:
            hashes = mix(hashes[: len(hashes) - span] * np.uint64(3) + hashes[span:])
            span *= 2
        starts = np.full(len(hashes), -1)
        ends = np.full(len(hashes), -1)
        for s, e in found:
            if e - span >= s:
                starts[s : e - span + 1], ends[s : e - span + 1] = s, e
        firsts = np.arange(0, len(hashes) - size, size)
        places = firsts[:, None] + np.arange(size, 2 * size)
        inside = places < len(hashes)
        places = np.minimum(places, len(hashes) - 1)
        row, lag = np.nonzero((hashes[places] == hashes[firsts][:, None]) & inside)
        x, lag = firsts[row], lag + size
        y = x + lag
        periodic = ends[x] >= 0
        moved = (ends[y] - ends[x] == lag) | (starts[y] - starts[x] == lag)
        open_ = ~periodic | ((ends[y] >= 0) & moved)
        x, lag = x[open_], lag[open_]
        order = np.lexsort((x, lag))
        seen = (0, 0)  # a lag and one past the last place it was followed to
        for i, q in zip(x[order].tolist(), lag[order].tolist(), strict=True):
            if q == seen[0] and i < seen[1]:
                continue
            last = i + _agreeing(codes, i, i + q)
            first = i - _agreeing(back, n - i - q, n - i)
            seen = (q, last)
            if last + q - first >= TIMES * q:
                found.setdefault((first, last + q), q)
        size *= 2


def block_runs(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows of first place, one past the last, and period; ordered by place, then period."""
    at, seg = surviving(codes, owner)
    kept = codes[at]
    runs = [(s, e, q) for (s, e), q in _short_lags(kept, seg).items()]
    short = sorted(runs)
    first = np.flatnonzero(np.concatenate([[True], np.diff(seg) != 0])) if len(seg) else []
    ends = [*first[1:], len(seg)] if len(seg) else []
    begins = np.array([s for s, _, _ in short], np.int64)
    for s, e in zip(first, ends, strict=True):
        if e - s >= TIMES * BLOCK:
            lo, hi = np.searchsorted(begins, [s, e])
            found = {(a - int(s), b - int(s)): q for a, b, q in short[lo:hi]}
            known = len(found)
            _long_lags(kept[s:e], found)
            runs += [(a + int(s), b + int(s), q) for (a, b), q in list(found.items())[known:]]
    table = np.array(sorted((int(at[s]), int(at[e - 1]) + 1, q) for s, e, q in runs), np.int64)
    table = table.reshape(-1, 3)
    return table[np.lexsort((table[:, 2], table[:, 0]))]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The (start, length, period) of the greatest length / period, compared exactly."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
        elif run[1] * best[2] == best[1] * run[2] and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


def _joined(vocab: pa.Array, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    words = vocab.cast(pa.large_string()).take(pa.array(codes))
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _pieces(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[dict[str, pa.Array]]:
    words = split_words(batch.column("text"))
    codes, starts = words.codes, words.starts
    if rewrite:
        ids = batch.column("doc_id").to_pylist()
        for i, taken in enumerate(rewrite(ids, words.counts)):
            if taken is not None:
                codes[starts[i] : starts[i + 1]] = codes[starts[i] + taken]
    table = block_runs(codes, words.owners())
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, table[:, 0] + table[:, 2], 1)
    np.add.at(marks, table[:, 1], -1)
    keep = np.cumsum(marks[:-1]) == 0
    text = np.searchsorted(starts, table[:, 0], "right") - 1
    cuts = np.searchsorted(text, np.arange(len(starts)))
    local = np.stack([table[:, 0] - starts[text], table[:, 1] - table[:, 0], table[:, 2]])
    top = [
        strongest(list(zip(*local[:, a:b].tolist(), strict=True))) if b > a else (None,) * 3
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    ]
    fields = [pa.array(row, pa.int64()) for row in local]
    names = ["start", "length", "period"]
    yield {
        "text": _joined(words.vocab, codes[keep], offsets(keep)[starts]).cast(pa.string()),
        "n_runs": pa.array(np.diff(cuts)),
        **{n: pa.array([t[k] for t in top], pa.int64()) for k, n in enumerate(names)},
        "runs": pa.ListArray.from_arrays(
            pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, names)
        ),
    }


def collapsed(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """`docs` with periodic runs of words collapsed to their first period.

    `text` is what is left of the words, joined by single spaces. Added are
    n_runs, all `runs` by start and period, and start, length and period of the
    strongest one (greatest length / period; ties: smallest start, then period),
    null if there is none. Places are word numbers from 0. `rewrite` may change
    the words by doc_id before they are searched.

    Null and empty texts have no runs and come out empty. Texts are searched
    whole, whatever their length; one text is never split between tasks, and a
    task holds a few MB of texts or one larger text at a time. Repeated rows and
    ids are treated row by row. Columns of these names in `docs` are replaced;
    others, also those with null, go along. An empty table stays empty.
    """
    added = StructType.fromDDL(COLUMNS)
    own = [f for f in docs.schema if f.name not in added.names and f.name != "text"]
    schema = StructType([*own, docs.schema["text"], *added])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for new in _pieces(batch, rewrite):
                named = {f.name: batch.column(f.name) for f in own} | new
                yield pa.RecordBatch.from_pydict({n: named[n] for n in schema.names})

    return docs.select(*[f"`{f.name}`" for f in own], "text").mapInArrow(task, schema)
