"""Operators that judge or change single texts, against plain Python."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bindery.llm import compression_bands, crf_language, html_text, packing
from bindery.llm.blocks import hash_strings, normalised, split_words

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "a", "It's  İstanbul's <|endoftext|>abc ÀÉ éa  'rea''ll 12ab３４ ", "x" * 30_000,
    " ΣΑΣ Straße ǅ à \x85 it's'll b", "one two\nthree\n\nthree\n  \nthree", "spam " * 5000,
    "# $ % & | < > * #", "the quick brown fox jumps over the lazy dog " * 3,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()
    return ODD + [r.text for r in rows]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids and texts, repeated rows, and columns whose names operators use."""
    rows = [(i if i % 4 else None, t, "en", i) for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence_id long")


def test_words_are_runs_without_ascii_space(texts):
    words = split_words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        got = words.vocab.take(pa.array(words.codes[words.starts[i] : words.starts[i + 1]]))
        assert got.to_pylist() == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_normalised_words():
    words = normalised(split_words(pa.array(["The (Cat)! -- sat,", None, "..."])))
    assert words.vocab.take(pa.array(words.codes)).to_pylist() == ["the", "cat", "sat"]
    assert words.starts.tolist() == [0, 3, 3, 3]


def test_string_hashes_tell_strings_apart():
    strings = list(dict.fromkeys([f"w{i}" for i in range(20_000)] + ["", "\0", "\0\0", "ab", "ba"]))
    hashes = hash_strings(pa.array(strings))
    assert len(set(hashes.tolist())) == len(strings)
    assert (hash_strings(pa.array(strings).slice(5, 7)) == hashes[5:12]).all()


# -- quality ------------------------------------------------------------------


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed,
    )


def test_quality_measures(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = compression_bands.quality(docs).collect()
    assert len(rows) == len(texts)
    judge = compression_bands.Compressor()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain_quality(r.text)
        fits = judge.judge((r.text or "").encode())[3]
        assert r.kept == (not r.base_failed and fits)


def test_bands_reject_both_ends():
    judge = compression_bands.Compressor()
    rng = np.random.default_rng(1)
    noise = "".join(chr(33 + x) for x in rng.integers(0, 94, 20_000)).encode()
    assert not judge.judge(noise)[3]
    assert not judge.judge(b"all work and no play " * 900)[3]
    half = noise[:8192] + b"plain words of some kind here " * 10
    assert judge.judge(half)[2] > 0


@pytest.mark.parametrize("size", [200, 300, 800, 1500, 3000, 20_000])
def test_base64_is_rejected_and_prose_of_its_length_kept(spark, size):
    symbols = np.frombuffer(
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8
    )
    rng = np.random.default_rng(size)
    junk = symbols[rng.integers(0, 64, size)].tobytes()
    judge = compression_bands.Compressor()
    assert not judge.judge(junk)[3]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(60).collect()
    prose = " ".join(r.text for r in docs).encode()[:size]
    assert len(prose) == size and judge.judge(prose)[3]
    if size == 20_000:
        mixed = junk[:14_000] + prose[:6000]
        assert judge.judge(junk)[2] == judge.judge(junk)[1]
        assert not judge.judge(mixed)[3] and judge.judge(mixed)[2] >= 3


def test_filter_keeps_columns_and_order_of_verdicts(spark, odd_docs):
    kept = compression_bands.filtered(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in compression_bands.quality(odd_docs).collect())
    assert compression_bands.filtered(odd_docs.limit(0)).count() == 0


# -- packing ------------------------------------------------------------------


def pieces_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return packing.pack(docs, PATH, **how).collect()


def test_packing_holds_each_id_once(spark, texts):
    model = Tokenizer.from_file(PATH)
    found = {}
    rows = pieces_of(spark, list(enumerate(texts)))
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = model.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)


def test_sequences_are_gapless_and_full_or_powers_of_two(spark, texts):
    sequences = {}
    for r in pieces_of(spark, list(enumerate(texts)), capacity=256, block_bytes=1 << 16):
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_length <= 256
        assert at & (at - 1) == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 3000, 4000)
    packed = packing.assign(lengths, 4096, 1.0, 1 / 2048)
    costs = [sum(packing.cost(n) for _, _, n in p) for p in packed[:-1]]
    in_order, now = [], 0.0
    room = 4096
    for n in lengths.tolist():  # the same documents cut in the order they come
        while n:
            take = min(n, room)
            now, room, n = now + packing.cost(take), room - take, n - take
            if not room:
                in_order.append(now)
                now, room = 0.0, 4096
    assert np.std(costs) < 0.6 * np.std(in_order)
    assert all(sum(n for _, _, n in p) == 4096 for p in packed[:-1])


def test_only_what_fits_nowhere_is_cut():
    """Many sequences of low cost and little room come before those with room."""
    lengths = np.array([3500] * 300 + [1300] * 900 + [500] * 300)
    room = {b: 4096 for b in range(-(-int(lengths.sum()) // 4096))}
    spent = dict.fromkeys(room, 0.0)
    nowhere = 0
    for n in lengths.tolist():
        fits = [(spent[b], b) for b in room if room[b] >= n]
        if fits:
            b = min(fits)[1]
            room[b], spent[b] = room[b] - n, spent[b] + packing.cost(n)
        nowhere += not fits
    packed = packing.assign(lengths, 4096, 1.0, 1 / 2048)
    pieces = np.bincount([doc for p in packed for doc, _, _ in p])
    # and the gaps that are left take pieces of a few
    assert (pieces > 1).sum() <= nowhere + 4 and pieces[:300].max() == 1


def test_packing_of_odd_rows(spark, odd_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0


# -- HTML ---------------------------------------------------------------------

PAGES = [
    (None, None), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>One<p>Two", "One\n\nTwo"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>One<li>Two<ul><li>in</ul></ul>x", "- One\n- Two\n  - in\n\nx"),
    ("<ol start=3><li>c<li value=7>g<li>h</ol>", "3. c\n7. g\n8. h"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
    ("<table><tr><td rowspan=2>x<td>a<tr><td>b</table>", "x  a\n   b"),
    ("<table><tr><td colspan=2>wide cell<tr><td>p<td>q</table>", "wide cell\np  q"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("a <b> b</b>  c", "a b c"),
    ("<style>p{}</style><script>'</p>'</script>x<noscript>n</noscript>", "x"),
    ("<div hidden>no</div><span style='color:red; display : none'>no</span>yes", "yes"),
    ("<details><summary>S</summary>no</details><details open>yes</details>", "S\nyes"),
    ("x<!-- no --><!-- <p> -->y", "xy"), ("1 < 2 <3", "1 < 2 <3"), ("a<b title='>'>b</b>", "ab"),
    ("kept <a href='unfinished", "kept"), ("</p></div>x</td>", "x"),
    ("<head><title>t</title></head><body>b", "b"), ("<dl><dt>T<dd>D</dl>", "T\n  D"),
    ("<p><b>text<p>more", "text\n\nmore"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<td>loose", "loose"), ("a&nbsp;b&#233;", "a bé"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_rendering(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p class="x"">Rest <b>of it</b>', "Rest of it"), ("<a title=5\">five</a> \"inch\"", 'five "inch"'),
        ("<div data-x=it's>shown</div> isn't it", "shown\nisn't it"), ("<p '>a</p 'x>b", "a\n\nb"),
        ("<p title='a>b' class=x>c", "c"), ('<p title = "a>b">c', "c"), ("<p title=>c", "c"),
        ("<p title=\"x>c <b>d</b>", "c d"), ("<div class='a'hidden>no</div>yes", "yes"),
        ("<a href=/x/>y</a>", "y"), ("<a href='x>y' z", "y' z"),
    ],
)
def test_stray_quotes_hide_no_text(page, want):
    assert html_text.render(page) == want


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 20_000 + "x").strip() == "x"
    assert html_text.render("<p>" + "word " * 200_000).count("word") == 200_000
    assert html_text.render("<" * 5000).startswith("<")


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = html_text.extracted(pages).collect()
    assert len(rows) == pages.count()
    for r, page in zip(
        sorted(rows, key=lambda r: r.page_id), sorted(pages.collect(), key=lambda r: r.page_id),
        strict=True,
    ):
        bare = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", page.html)
        import html

        want = html.unescape(re.sub(r"<[^>]*>", " ", bare)).replace("\xa0", " ").split()
        got = [w for w in re.sub(r"(?m)^\s*- ", "", r.text).split()]
        assert "".join(got) == "".join(want)


# -- language -----------------------------------------------------------------


@pytest.fixture(scope="module")
def small_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, crf_language.train(docs, sample=400)


def test_held_out_accuracy(small_model):
    docs, model = small_model
    rows = crf_language.predicted(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_switching_text(small_model):
    _, model = small_model
    words, found = crf_language.label(model, pa.array(["the of that with und nicht die das que los por"]))
    names = [model.langs[i] for i in found.argmax(axis=1)]
    assert names[:3] == ["en"] * 3 and "de" in names[4:8] and names[-1] == "es"
    assert np.allclose(found.sum(axis=1), 1)


def test_every_character_of_a_long_run_counts(small_model):
    _, model = small_model
    en, de = "thatwithfromthisthehaveand" * 4, "nichteinederdieundschlichtzwischen" * 4
    words, found = crf_language.label(model, pa.array([en + de, "short one", en[:24], None]))
    parts = words.vocab.take(pa.array(words.codes)).to_pylist()
    size = int(words.starts[1])
    assert "".join(parts[:size]) == en + de and max(map(len, parts)) <= 24
    assert parts[size:] == ["short", "one", en[:24]] and words.counts.tolist()[2:] == [1, 0]
    other, _ = crf_language.label(model, pa.array([en[:24] + de]))
    assert other.counts[0] > 1
    mixed = crf_language.pieces("словословословословослово漢字漢字latin")
    assert mixed[-2:] == ["漢字漢字", "latin"] and "".join(mixed[:2]) == "слово" * 5
    names = [model.langs[i] for i in found[:size].argmax(axis=1)]
    assert names[0] == "en" and names[-1] == "de"


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(5)
    scores, change, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([0, 4, 4, 7])
    got = crf_language.posteriors(scores, starts, change, start)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            value = start[path[0]] + sum(scores[a + t, s] for t, s in enumerate(path))
            value += sum(change[x, y] for x, y in zip(path, path[1:], strict=False))
            for t, s in enumerate(path):
                want[t, s] += np.exp(value)
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_texts_without_letters(spark, small_model):
    _, model = small_model
    docs = spark.createDataFrame(
        [(1, None, "en"), (None, "123 ?!", None), (3, "", "de"), (4, "the and of", None)],
        "doc_id long, text string, lang string",
    )
    rows = crf_language.predicted(docs, model).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en"]
    assert [r.score for r in rows[:3]] == [0, 0, 0]
    assert {r.lang_pred for r in crf_language.identified(docs.where("lang is null")).collect()} == {"und"}


def test_html_time_grows_with_the_page():
    """Open elements are found by tag, so neither unclosed nor stray tags walk the stack."""

    def seconds(page):
        begun = time.process_time()
        html_text.render(page)
        return time.process_time() - begun

    for form in (lambda n: "<div>x" * n, lambda n: "<div>x" * n + "</span>" * n,
                 lambda n: "<p><b>x" * n + "</i></div>" * n):
        small, large = seconds(form(10_000)), seconds(form(80_000))
        assert large < 8 * 4 * max(small, 0.05)
