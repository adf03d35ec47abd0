"""Language of each word in running text by a linear-chain conditional random field.

Words have features (prefixes, suffixes, character n-grams, the word itself, and
which language's lexicon has it) with a learned weight for each language, and
neighbouring words have learned transitions. Forward-backward gives each word's
posterior over languages, so text that switches between languages is labelled
word by word; a document's language is the one with the largest share.

The model is fitted on the driver to a bounded sample of labelled rows (at most
SAMPLE rows of at most SAMPLE_BYTES each), and then sent to the tasks, which
read all documents whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.blocks import (
    Words, hash_strings, mix, normalised, offsets, sliced, split_words, without,
)

#: Bounds of the labelled sample that the model is fitted to.
SAMPLE, SAMPLE_BYTES = 2000, 20_000
SLOTS = 1 << 16
AFFIX = 4
NGRAM = 3
#: Most characters of a word; longer runs are cut into pieces that are words of their own.
LETTERS = 24
#: Scripts where a longer run is cut first; all other characters go together.
SCRIPTS = re.compile(
    "[A-Za-z\u00aa-\u024f\u1e00-\u1eff]+|[\u0370-\u03ff\u1f00-\u1fff]+|[\u0400-\u052f]+|[\u0590-\u05ff]+"
    "|[\u0600-\u077f]+|[\u0900-\u097f]+|[\u0e00-\u0e7f]+|[\u3040-\u30ff]+|[\u3400-\u9fff]+|[\uac00-\ud7af]+"
    "|[^A-Za-z\u00aa-\u024f\u1e00-\u1eff\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u0590-\u05ff\u0600-\u077f"
    "\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+"
)
#: A word belongs to a language's lexicon if so many of its sample documents have it.
LEXICON_DOCS = 3
STEPS, BATCH, LENGTH, RATE, PENALTY = 240, 128, 32, 0.15, 1e-4
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # slot x language; the last rows are lexicons
    change: np.ndarray  # from x to
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # word x language: in that lexicon


def letter_words(texts: pa.Array) -> Words:
    """Normalised words that have a letter, long runs in pieces."""
    words = in_pieces(normalised(split_words(texts)))
    if not len(words.vocab):
        return words
    bare = pc.invert(pc.match_substring_regex(words.vocab, r"\p{L}"))
    return without(words, bare.to_numpy(zero_copy_only=False))


def pieces(run: str) -> list[str]:
    """A run cut where the script changes, and into even parts of LETTERS at most."""
    out = []
    for part in SCRIPTS.findall(run):
        count = -(-len(part) // LETTERS)
        cuts = [len(part) * k // count for k in range(count + 1)]
        out += [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def in_pieces(words: Words) -> Words:
    """Runs of more than LETTERS characters as several words, so that all of them counts."""
    long = pc.greater(pc.utf8_length(words.vocab), LETTERS).to_numpy(zero_copy_only=False)
    if not long.any():
        return words
    cut = [pieces(x) for x in words.vocab.filter(pa.array(long)).to_pylist()]
    short = words.vocab.filter(pa.array(~long))
    parts = pa.array([x for y in cut for x in y], words.vocab.type)
    coded = pa.concat_arrays([short, parts]).dictionary_encode()
    # each entry of the old vocabulary is `sizes` words of the new list, from `first` on
    sizes = np.ones(len(long), np.int64)
    sizes[long] = [len(x) for x in cut]
    first = np.cumsum(~long) - 1
    first[long] = len(short) + offsets(sizes[long])[:-1]
    counts = sizes[words.codes]
    at = offsets(counts)
    place = np.arange(at[-1]) - np.repeat(at[:-1] - first[words.codes], counts)
    codes = coded.indices.to_numpy().astype(np.int64)[place]
    return Words(codes, at[words.starts], coded.dictionary)


def _codes(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points by word and place, 0 behind the end; and lengths."""
    words = np.array(vocab.to_pylist(), dtype=f"U{LETTERS}")
    codes = np.ascontiguousarray(words).view(np.uint32).reshape(len(words), LETTERS)
    return codes.astype(np.uint64), (codes > 0).sum(axis=1)


def features(vocab: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one kind and place of feature at a time: the words that have it, and its slots."""
    if not len(vocab):
        return
    mask = np.uint64(SLOTS - 1)
    every = np.arange(len(vocab))
    yield every, (mix(hash_strings(vocab)) & mask).astype(np.int64)
    codes, sizes = _codes(vocab)
    for k in range(1, AFFIX + 1):
        for name, first in ((1, np.zeros(len(sizes), np.int64)), (2, sizes - k)):
            has = np.flatnonzero(sizes >= k)
            value = np.full(len(has), name * 16 + k, np.uint64)
            for j in range(k):
                value = mix(value ^ codes[has, first[has] + j])
            yield has, (value & mask).astype(np.int64)
    for n in range(1, NGRAM + 1):
        for at in range(LETTERS - n + 1):
            has = np.flatnonzero(sizes >= at + n)
            if not len(has):
                break
            value = np.full(len(has), 64 + n, np.uint64)
            for j in range(n):
                value = mix(value ^ codes[has, at + j])
            yield has, (value & mask).astype(np.int64)


def lexicon_of(model: Model, vocab: pa.Array) -> np.ndarray:
    """word x language flags."""
    flags = np.zeros((len(vocab), len(model.langs)), bool)
    if len(model.lexicon) and len(vocab):
        hashes = hash_strings(vocab)
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        hit = model.lexicon[at] == hashes
        flags[hit] = model.entries[at[hit]]
    return flags


def emissions(model: Model, vocab: pa.Array) -> np.ndarray:
    """Score of each word for each language; longer words have more features, so a mean."""
    score = np.zeros((len(vocab), len(model.langs)))
    count = np.zeros(len(vocab))
    for has, slots in features(vocab):
        score[has] += model.weights[slots]
        count[has] += 1
    scale = 1 / np.sqrt(np.maximum(count, 1))
    return score * scale[:, None] + lexicon_of(model, vocab) @ model.weights[SLOTS:]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def posteriors(
    scores: np.ndarray, starts: np.ndarray, change: np.ndarray, start: np.ndarray
) -> np.ndarray:
    """Forward-backward over sequences laid end to end; rows sum to 1.

    Sequences go in step, longest first, so each step is one operation on those
    that are still running. Values are probabilities scaled at every step.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], starts[:-1][order]
    longest = int(sizes.max(initial=0))
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # sizes > t
    move = np.exp(change - change.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    forward = np.empty_like(emit)
    now = None
    for t in range(longest):
        n = int(running[t])
        at = begins[:n] + t
        now = emit[at] * (np.exp(start - start.max()) if t == 0 else now[:n] @ move)
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    back = np.ones((len(sizes), scores.shape[1]))
    out = np.empty_like(emit)
    for t in range(longest - 1, -1, -1):
        n = int(running[t])
        at = begins[:n] + t
        both = forward[at] * back[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
        back[:n] = (emit[at] * back[:n]) @ move.T
        back[:n] /= back[:n].sum(axis=1, keepdims=True)
    return out


def _sequences(
    words: Words, labels: np.ndarray, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """BATCH x LENGTH words and labels; half of the rows switch language once or twice."""
    long = np.flatnonzero(words.counts >= 4)
    picked = rng.choice(long, (BATCH, 3))
    at = words.starts[picked] + (rng.random((BATCH, 3)) * words.counts[picked]).astype(np.int64)
    cuts = np.sort(rng.integers(1, LENGTH, (BATCH, 2)), axis=1)
    cuts[: BATCH // 2] = LENGTH
    place = np.arange(LENGTH)[None, :]
    part = (place >= cuts[:, :1]).astype(int) + (place >= cuts[:, 1:])
    rows = np.arange(BATCH)[:, None]
    doc = picked[rows, part]
    # texts shorter than the row go round
    offset = at[rows, part] - words.starts[doc] + place
    position = words.starts[doc] + offset % words.counts[doc]
    return words.codes[position], labels[doc]


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Maximise the conditional likelihood by AdaGrad over sampled sequences."""
    names = sorted(set(langs))
    labels = np.array([names.index(x) for x in langs], np.int64)
    words = letter_words(pa.array(texts, pa.string()))
    size = len(names)
    own = np.unique(words.owners() * max(1, len(words.vocab)) + words.codes)
    docs, codes = np.divmod(own, max(1, len(words.vocab)))
    seen = np.zeros((len(words.vocab), size), np.int64)
    np.add.at(seen, (codes, labels[docs]), 1)
    member = (seen >= LEXICON_DOCS) & (seen * 2 >= seen.sum(axis=1, keepdims=True))
    some = member.any(axis=1)
    hashes = hash_strings(words.vocab)[some] if len(words.vocab) else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    model = Model(
        names, np.zeros((SLOTS + size, size)), np.zeros((size, size)), np.zeros(size),
        hashes[order], member[some][order],
    )
    if size < 2 or not (words.counts >= 4).any():
        return model
    # features of each vocabulary word, end to end
    parts = list(features(words.vocab))
    owner = np.concatenate([h for h, _ in parts])
    slot = np.concatenate([s for _, s in parts])
    by = np.argsort(owner, kind="stable")
    owner, slot = owner[by], slot[by]
    first = np.searchsorted(owner, np.arange(len(words.vocab) + 1))
    scale = 1 / np.sqrt(np.maximum(np.diff(first), 1))
    rng = np.random.default_rng(seed)
    grown = [np.full(x.shape, 1e-6) for x in (model.weights, model.change, model.start)]
    for _ in range(STEPS):
        seq, gold = _sequences(words, labels, rng)
        kinds, inverse = np.unique(seq, return_inverse=True)
        counts = np.diff(first)[kinds]
        which = np.repeat(np.arange(len(kinds)), counts)
        slots = slot[np.concatenate([np.arange(first[k], first[k + 1]) for k in kinds])]
        flags = member[kinds].astype(float)
        score = np.zeros((len(kinds), size))
        np.add.at(score, which, model.weights[slots])
        score = score * scale[kinds][:, None] + flags @ model.weights[SLOTS:]
        emit = score[inverse.ravel()].reshape(BATCH, LENGTH, size)
        error, moves, starts = _gradient(emit, gold, model.change, model.start)
        by_kind = np.zeros((len(kinds), size))
        np.add.at(by_kind, inverse.ravel(), error.reshape(-1, size))
        change = np.zeros_like(model.weights)
        np.add.at(change, slots, (by_kind * scale[kinds][:, None])[which])
        change[SLOTS:] = flags.T @ by_kind
        for value, delta, total in zip(
            (model.weights, model.change, model.start), (change, moves, starts), grown, strict=True
        ):
            delta = delta / BATCH - PENALTY * value
            total += delta**2
            value += RATE * delta / np.sqrt(total)
    return model


def _gradient(
    emit: np.ndarray, gold: np.ndarray, change: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood, by emissions, transitions and start scores."""
    rows, length, size = emit.shape
    alpha = np.empty_like(emit)
    beta = np.zeros_like(emit)
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + change, 1) + emit[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _log_sum(change + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    whole = _log_sum(alpha[:, -1], 1)[:, None]
    own = np.eye(size)[gold]
    error = own - np.exp(alpha + beta - whole[:, :, None])
    pair = (
        alpha[:, :-1, :, None] + change + (emit + beta)[:, 1:, None, :] - whole[:, :, None, None]
    )
    moves = np.einsum("rti,rtj->ij", own[:, :-1], own[:, 1:]) - np.exp(pair).sum(axis=(0, 1))
    return error, moves, error[:, 0].sum(axis=0)


def label(model: Model, texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Letter words of each text, and for each position the posterior by language."""
    words = letter_words(texts)
    scores = emissions(model, words.vocab)[words.codes]
    return words, posteriors(scores, words.starts, model.change, model.start)


def documents(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language with the largest share of each text's words, and that share."""
    size = len(model.langs)
    words = letter_words(texts)
    some = words.counts > 0
    shares = np.zeros((len(words.counts), max(1, size)))
    if size and some.any():
        words, found = label(model, texts)
        sums = np.concatenate([np.zeros((1, size)), np.cumsum(found, axis=0)])
        sums = sums[words.starts[1:]] - sums[words.starts[:-1]]
        shares = sums / np.maximum(words.counts, 1)[:, None]
    best = shares.argmax(axis=1)
    known = some & bool(size)
    langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return langs, np.where(known, np.clip(shares.max(axis=1), 0, 1), 0.0)


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit to a bounded sample of the rows whose fold isn't 0, even over languages.

    Rows are chosen by a hash of their id and text, so the sample is the same
    whatever the partitions.
    """
    rows = docs.select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.lit("sample"), key, text).alias("_hash"), fold(F.col(key)).alias("_fold"),
    )
    rows = rows.where(
        "_fold <> 0 and lang is not null and text is not null "
        f"and octet_length(text) <= {sample_bytes}"
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    each = max(1, sample // len(counts))
    share = [F.when(F.col("lang") == k, min(1.0, each / n)) for k, n in counts.items()]
    rank = F.pmod(F.col("_hash"), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(rank < F.coalesce(*share)).select("lang", "text", "_hash")
    found = chosen.orderBy("_hash").limit(2 * sample).collect()
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def predicted(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    A text that is null or has no letter is `und` with score 0. Texts are read
    whole; equal texts get equal results. A null id is in no fold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            langs, scores = documents(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, "
    return rows.mapInArrow(run, schema + "lang_pred string, score double")


def identified(docs: DataFrame, **columns: str) -> DataFrame:
    """Fit to the training folds of `docs` and predict every row of it."""
    model = train(docs, **columns)
    return predicted(docs, model, **{k: v for k, v in columns.items() if k != "lang"})
