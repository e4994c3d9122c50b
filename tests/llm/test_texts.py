"""Decontamination, classifier, HTML, chat, tokens, packing, separators and range coder."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderpulse.llm import chat, decontaminate, html, packing, quality, rangecoder, separators
from orderpulse.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", None, " ", "a  b", " a b", "a b ", "x\n y", "it's. A,b.. ", "don't, we'll.", "foo<|endoftext|> bar", "a b", "é ́x", "İstanbul. ΣΑΣ.", "a.b, c.,. d", "日本 語。", "\U0001f600 ok.,", "word " * 3000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination(spark):
    long = " ".join(f"x{k}" for k in range(40))
    bench = [(1, long), (2, "Short item here"), (10, long.upper()), (3, None), (4, "..."), (None, "null id item words that count as a window of ten"), (5, "same words same words same words same words same words same words")]
    docs = [
        (1, "intro " + long + " outro"), (2, "x1 x2 x3"), (3, "a short, ITEM-here b"), (3, "a short, ITEM-here b"), (4, None), (5, ""), (None, "short item here"),
        (6, "same words " * 30), (7, " ".join(f"x{k}" for k in range(3, 13))), (8, " ".join(f"x{k}" for k in range(3, 12))), (9, "null id item words that count as a window of ten"), (10, "clean é É text"),
    ]
    d = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id long, text string, n_hit int, items string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in bench:
        w = split(t)
        for k in range(len(w) - min(10, len(w)) + 1) if w else []:
            windows[tuple(w[k:k + min(10, len(w))])].add(i)
    want = []
    for i, t in docs:
        w, hit, items = split(t), set(), set()
        for k in range(len(w)):
            for size in range(1, 11):
                if tuple(w[k:k + size]) in windows and k + size <= len(w):
                    hit.update(range(k, k + size))
                    items |= windows[tuple(w[k:k + size])]
        want.append((i, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, old = limit, decontaminate.BROADCAST_WINDOWS
        try:
            rows = decontaminate.scan(d, b).collect()
        finally:
            decontaminate.BROADCAST_WINDOWS = old
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows for _ in range(r["copies"])]
        assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 8, 10]
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs) and decontaminate.scan(d.limit(0), b).count() == 0


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_decontamination_of_a_long_text(spark, monkeypatch, bound):
    """20,000 words, all but the first and last hit, met at every place by windows of two items that repeat."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    cycle = [f"w{k}" for k in range(25)]
    text = " ".join(["first", *(cycle * 800)[:19_998], "last"])
    docs = spark.createDataFrame([(1, text), (1, text), (1, "w0 w1 other"), (2, " ".join(cycle[:10])), (3, " ".join(cycle[:9]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(cycle * 2)), (8, " ".join(cycle[5:20]))], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["copies"], r["items"]) for r in decontaminate.scan(docs, items).collect())
    assert got == [(1, 3, 0, 1, []), (1, 20_000, 19_998, 2, ["7", "8"]), (2, 10, 10, 1, ["7"]), (3, 9, 0, 1, [])]


def test_decontamination_is_native(spark):
    d, b = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = decontaminate.scan(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("Scan arrow", "")


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(f"word{x} and" for x in rng.integers(0, 500, 40))
    bad = lambda: " ".join(f"word{x}&&& ***" for x in rng.integers(0, 500, 40))
    docs = [(i, good() if i % 2 else bad(), 0.5) for i in range(400)] + [(400, None, 0.1), (401, "", 0.1), (401, "", 0.1), (None, "word1 and", 0.1)]
    labels = [(i, i % 2, 0) for i in range(300)] + [(301, 0, 0), (301, 1, 0), (302, None, 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(4)
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = quality.fit(d, la)
    got = quality.score(d, weights, "p").collect()
    assert len(got) == len(docs) and all(0 <= r["p"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and 0 <= r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["p"] >= 0.3) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    kept = quality.keep(d, la)
    assert kept.columns == d.columns and 150 < kept.count() < 260
    assert set(r["p"] for r in quality.score(d, quality.fit(d, la.limit(0)), "p").collect()) == {0.5}
    assert quality.keep(d.limit(0), la).count() == 0
    # Labels of held-out documents change nothing.
    flipped = la.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, quality.fit(d, flipped))


def test_ftrl_dot_is_sparse_and_exact():
    at, value = quality.features("A word, a WORD!! again again")
    assert len(set(at.tolist())) == len(at) and at[0] == 0 and value[0] == 1 and (value[1:] ** 2).sum() == pytest.approx(1)
    assert [x.tolist() for x in quality.features("")] == [[0], [1.0]] == [x.tolist() for x in quality.features(None)]


def test_ftrl_against_dense_loops(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 4)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(17, 4, replace=False))
        rows.append((at, rng.normal(size=4), float(at[0] % 2)))
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, value, label in rows:
            w = {int(i): weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(at, value))))
            for i, v in zip(at, value):
                g = (p - label) * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - step * w[int(i)]
                n[i] += g * g
    assert quality.train(rows) == pytest.approx([weight(i) for i in range(17)], abs=1e-9)


def test_a_repeated_labelled_id_is_learnt_once(spark):
    texts = {i: f"good words {i} and more of them" if i % 2 else f"### {i} $$ %%" for i in range(1, 60)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    once = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    often = once.union(spark.range(100_000).selectExpr("7L", f"'{texts[7]}'"))
    assert np.array_equal(quality.fit(once, labels), quality.fit(often, labels))


PAGES = {
    "plain": ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>one  two\n three<br>four</p></article><footer>f</footer>", "T & U\n\none two three four"),
    "soup": ('<body><ul><li><a>Home page</a><li><a>Other page</a></ul><p>First para with a <a href="x">link in</a> it and words.<p>Second para &eacute; with more words here.</p></body>', "First para with a link in it and words.\n\nSecond para é with more words here."),
    "notes": ('<main><h1>A</h1><div class="cookie-notice">we use</div><p>body words here</p><section id="comments"><article class="comment"><p>reader says a lot of things</p></article></section></main>', "A\n\nbody words here"),
    "script": ('<div title="a > b"><script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><p>only this text</p></div>', "only this text"),
    "cut": ("<article><p>unfinished words here <b>bo", "unfinished words here bo"),
    "none": ("<nav>a b c</nav>", ""), "null": (None, ""), "empty": ("", ""), "text": ("just words < 5 & more", "just words < 5 & more"),
}


def test_html(spark):
    rows = [(k, name, source, "x") for k, (name, (source, _)) in enumerate(PAGES.items())] + [(None, None, "<p>" * 3000 + "deep words", "x"), (1, "soup", PAGES["soup"][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    weights = html.fit(pages)
    assert weights["word"] > 0 > weights["tag:p"] and weights["out:nav"] < 0
    got = html.main_text(pages, weights).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["url"]:
            assert r["text"] == PAGES[r["url"]][1]
        else:
            assert r["text"] == "deep words"
    assert html.main_text(pages.limit(0), html.fit(pages.limit(0))).count() == 0
    assert html.extract("<div class='text'><p>works without weights</p></div>", {}) == "works without weights"


_BODY = "<h1>The long title of this page</h1>" + "".join(f"<p>Paragraph {k} has some words of the body here.</p>" for k in range(4))
_TEXT = "The long title of this page\n\n" + "\n\n".join(f"Paragraph {k} has some words of the body here." for k in range(4))


@pytest.mark.parametrize("page", [
    '<div class="content no-sidebar">%s</div>', '<div class="page-with-sidebar">%s</div>', '<div id="main-widget">%s</div>', '<div class="col related-posts-on">%s</div>',
    '<form id="aspnetForm"><div class="sidebar"><p>some left words</p></div><fieldset>%s</fieldset></form>', '<body class="comments-open"><div>%s</div></body>', '<main><form>%s</form></main>',
    '<div class="widget">%s</div><div class="cookie-notice">we use them</div>', '<div>%s</div><div id="comments"><p>' + "a reader says " * 90 + "</p></div>", '<article>%s<div class="ad">buy now</div></article>',
])
def test_html_hints_leave_the_main_text(page):
    """A hint or a form around the main text doesn't empty the page; what it sets apart beside the main text stays out."""
    assert html.extract(page % _BODY, {}) == _TEXT


def test_html_hints_in_running_text_and_in_parts():
    assert html.extract('<article><p class="ad-hoc">An ad-hoc list.</p><h2 id="related-work">Related work</h2><p>is old</p></article>', {"word": 3.0}) == "An ad-hoc list.\n\nRelated work\n\nis old"
    part = '<div class="widget"><p>%s words that fill a part of the page</p></div>'
    assert html.extract("".join(part % x for x in "abc") + '<div class="ad">d</div>', {"word": 3.0}) == "\n\n".join(f"{x} words that fill a part of the page" for x in "abc")


def test_html_sample_is_of_marked_pages(spark):
    """Two marked pages among 300 teach a sample of two."""
    plain = [(k, f"<div><p>unmarked page {k} of some words, no &lt;article></p><articles>x</articles></div>") for k in range(300)]
    marked = [(k, f"<nav>menu</nav><ARTICLE class=a><p>marked page {k} of some words</p></ARTICLE>") for k in (300, 301)]
    make = lambda rows: spark.createDataFrame(rows, "page_id long, html string")
    found = html.fit(make(plain + marked), 2)
    assert found == html.fit(make(marked)) and found["word"] > 0.5 and "out:nav" in found


def test_best_region_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(0, 12)).tolist()
        a, z = html.best_region(x)
        assert sum(x[a:z]) == max([0, *[sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]])


def test_preference_pairs(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "x <|end|>"), (2, 1, "assistant", "one"), (2, 1, "assistant", "one"), (3, 0, "user", "alone"), (None, 0, "user", "no"), (4, None, None, None), (5, 0, "user", "q"), (5, 1, "assistant", "a")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "x <|end|>"), (2, 1, "assistant", "two"), (4, None, None, None), (6, 0, "user", "only rejected"), (5, 1, "assistant", "a"), (5, 0, "user", "q")]
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, turn long, role string, text string, n int").repartition(3)
    got = {r["pair_id"]: r for r in chat.preference_pairs(frame(a), frame(b)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nno<|end|>\n" and got[1]["usable"]
    assert got[2]["prompt"] == "<|user|>\nx <\\|end|><|end|>\n" and got[2]["chosen_turns"] == 2
    for r in got.values():
        for side in ("chosen", "rejected"):
            spans = [r[side][s["a"]:s["z"]] for s in r[side + "_mask"]]
            assert spans == [x + "<|end|>" for x in re.findall(r"<\|assistant\|>\n(.*?)<\|end\|>\n", r[side], re.S)]
    assert got[5]["chosen"] == got[5]["rejected"] == "" and not got[5]["usable"] and got[4]["prompt_turns"] == 1 and got[6]["prompt"] == "" and not got[3]["usable"]
    assert chat.preference_pairs(frame(a).limit(0), frame(b).limit(0)).count() == 0


@pytest.mark.parametrize("path, prefixed", [(BYTE, True), (WORD, False)])
def test_tokens_are_the_librarys(path, prefixed, monkeypatch):
    monkeypatch.setattr("orderpulse.llm.tokens.KEPT", 3)
    monkeypatch.setattr("orderpulse.llm.tokens.STEP", 50)
    rng = np.random.default_rng(0)
    parts = [" ", "  ", "\n", "a", "B.", "it's", "é", "12", ".,", "'", "　", "<|", "x,", "́"]
    texts = ODD + ["".join(rng.choice(parts, 12)) for _ in range(300)]
    flat, n = Encoder(path, prefixed).encode(pa.array(texts, pa.string()))
    own, at = Tokenizer.from_file(path), 0
    for t, k in zip(texts, n):
        assert flat[at:at + k].tolist() == own.encode(t or "", add_special_tokens=False).ids
        at += k
    assert at == len(flat)


def frame(spark, texts):
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(2, "again"), (2, "again")] and [(i, t, 3) for i, t in enumerate(texts)] + [(2, "again", 3), (2, "again", 3), (None, "null id", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)


def coded(path, rows, end, special=False):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = special
    return [(i, [*own.encode(t or "", add_special_tokens=False).ids, end]) for i, t, _ in rows]


def test_packing(spark):
    rng = np.random.default_rng(1)
    rows, docs = frame(spark, ODD + [" ".join(f"w{x}" for x in rng.integers(0, 999, rng.integers(1, 300))) for _ in range(120)])
    got = packing.pack(docs, BYTE, 0, 64, with_ids=True).collect()
    want = coded(BYTE, rows, 0)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) == 64 and sum(64 - n for n in sizes if n & (n - 1)) == 0
    assert sum(sizes) == sum(len(ids) for _, ids in want)
    for (doc, tokens), found in pieces.items():
        same = [ids for i, ids in want if i == doc and len(ids) == tokens]
        assert sorted(sum((x for _, x in sorted(found, key=lambda p: p[0])), [])) == sorted(sum(same, []))
        if len(same) == 1:
            assert sum((x for _, x in sorted(found)), []) == same[0]
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_best_fill_is_closest():
    rng = np.random.default_rng(4)
    for _ in range(300):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6))}
        room = int(rng.integers(0, 80))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        use = packing.best_fill(sorted(counts, reverse=True), counts, room)
        assert all(0 < k <= counts[n] for n, k in use.items())
        assert sum(n * k for n, k in use.items()) == max(s for s in sums if s <= room)


def test_separators(spark, tmp_path):
    rows, docs = frame(spark, ODD + ["tail"])
    want = coded(BYTE, rows, 50256, True)
    for block, group in ((7, 2), (1 << 18, 1024)):
        separators.GROUP, old = group, separators.GROUP
        try:
            blocks, names = separators.write_flat(docs, BYTE, 50256, block)
            found = separators.documents(blocks, 50256)
            got = found.join(names, ["file", "ordinal"]).collect()
            assert found.where("not ended").count() == 0
        finally:
            separators.GROUP = old
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(((i, len(x)) for i, x in want), key=str)
        for file in {r["file"] for r in got}:
            at = 0
            for r in sorted((r for r in got if r["file"] == file), key=lambda r: r["ordinal"]):
                assert r["start"] == at
                at += r["n_tokens"]
    flat = np.array([5, 9, 9, 1, 1, 1, 9, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(np.array([3, 3, 3], "<u2").tobytes())
    blocks = separators.read_flat(spark, str(tmp_path), 2, 3)
    got = sorted((r["file"][-5:], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in separators.documents(blocks, 9).collect())
    assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 2, 1, True), ("a.bin", 2, 3, 4, True), ("a.bin", 3, 7, 1, False), ("c.bin", 0, 0, 3, False)]
    assert separators.documents(blocks.limit(0), 9).count() == 0
    (tmp_path / "d.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        separators.read_flat(spark, str(tmp_path / "d.bin"), 2).collect()


def test_flat_files_beyond_two_gigabytes(spark, tmp_path):
    """A file of 5 GB, all hole but for three ends, is read by byte ranges in many tasks."""
    size, ends = 5 << 30, [10, (1 << 30) + 3, (5 << 28) - 2]
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
        for k in ends:
            f.seek(4 * k)
            f.write(np.array([7], "<u4").tobytes())
    read = separators.read_flat(spark, str(tmp_path), 4, 1 << 24)
    assert read.select(F.spark_partition_id()).distinct().count() > 4
    got = sorted(tuple(r)[1:] for r in separators.documents(read, 7).collect())
    at = [0, *(k + 1 for k in ends), size // 4]
    assert got == [(k, at[k], at[k + 1] - at[k], k < 3) for k in range(4)]


def test_token_files_are_flat(spark, tmp_path, monkeypatch):
    """The query's files are ids on disk and nothing else, and other attempts' files are not read."""
    monkeypatch.setattr(separators, "shared_path", lambda *_: str(tmp_path / "flat"))
    rows, docs = frame(spark, ODD + ["tail"])
    blocks, names = separators.write_flat(docs, BYTE, 50256, 7)
    files = list((tmp_path / "flat").glob("*.bin"))
    ids = np.concatenate([np.fromfile(f, "<u2") for f in files])
    assert sorted(ids.tolist()) == sorted(x for _, d in coded(BYTE, rows, 50256, True) for x in d)
    (tmp_path / "flat" / "0-999999.bin").write_bytes(b"abc")
    assert separators.documents(blocks, 50256).join(names, ["file", "ordinal"]).count() == len(rows)


def test_cases_lines_and_marks_are_parted_before_words_are_counted():
    encoder = Encoder(WORD, False)
    texts = ["Word. word, WORD;\nword\n\nWord"]
    # A macron below joins h but not H, a caron j but not J: the case of a letter before a mark to join must stay.
    parts = ["H\u0331", "J\u030c", "K\u0301", "h\u0331", "\u212a", "\u0130", "\u1e9e", "\u0149", "\u00c9.", "\u00aa,", "a.b", "Don't.", "X.'s", "'S", "O'St!", "1.", "A1b2", "...", "\n", "\r\n", " ", "C", "\u0345"]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(parts, 9)) for _ in range(400)] + ["".join(rng.choice(parts[9:-1], 9)) for _ in range(400)]
    flat, n = encoder.encode(pa.array(texts[:1]))
    assert set(encoder.kept[""]) == {"word", ".", ",", ";", ""}
    flat, n = encoder.encode(pa.array(texts))
    own, ends = Tokenizer.from_file(WORD), np.cumsum(n)
    for t, a, z in zip(texts, ends - n, ends, strict=True):
        assert flat[a:z].tolist() == own.encode(t, add_special_tokens=False).ids


def test_range_coder_bytes_stay():
    """The bytes of these blocks as they were before both orders were kept in one table."""
    rng = np.random.default_rng(7)
    words = [rng.integers(0, 40_000, 9) for _ in range(60)]
    blocks = [np.concatenate([words[k] for k in rng.zipf(1.4, n) % 60])[:4096].astype(np.uint32) for n in (1, 40, 460, 460, 9)]
    table = rangecoder.Table.of(*np.unique(np.concatenate(blocks), return_counts=True))
    raw = rangecoder.encode(blocks, table)
    assert zlib.crc32(b"".join(raw)) == 2757205438
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode(raw, [len(b) for b in blocks], table)))


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 49408, n).astype(np.uint32) for n in (1, 2, 5, 100, 4096, 777)]
    blocks += [np.full(4096, 7, np.uint32), rng.integers(0, rangecoder.BOUND, 500).astype(np.uint32), np.array([0, rangecoder.BOUND - 1, 0, 1, 3, 4], np.uint32), np.tile(np.arange(5, dtype=np.uint32), 700)]
    raw = rangecoder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode(raw, [len(b) for b in blocks])))
    assert len(raw[6]) < 200 and len(raw[4]) < 2.1 * 4096
    with pytest.raises(ValueError, match="below"):
        rangecoder.encode([np.array([rangecoder.BOUND], np.uint32)])
    # Blocks don't depend on what is coded beside them.
    assert rangecoder.encode([blocks[4]])[0] == raw[4] and np.array_equal(rangecoder.decode([raw[3]], [100])[0], blocks[3])


def test_range_coder_table():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 60_000), 3000).astype(np.uint32) * 17
    table = rangecoder.Table.of(*np.unique(ids, return_counts=True))
    again = rangecoder.Table.load(table.dump())
    assert table.shares.sum() == 1 << table.bits and table.shares.min() >= 1
    assert np.array_equal(again.ids, table.ids) and np.array_equal(again.shares, table.shares) and again.bits == table.bits
    blocks = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
    raw = rangecoder.encode(blocks, table)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode(raw, [len(b) for b in blocks], again)))
    # Independent ids cost little more than their entropy: the guesses of orders 1 and 2 tell nothing and take a share.
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert sum(map(len, raw)) * 8 / len(ids) < 1.1 * -(share * np.log2(share)).sum()
    one = np.full(9, 5, np.uint32)
    alone = rangecoder.Table.of(*np.unique(one, return_counts=True))
    assert np.array_equal(rangecoder.decode(rangecoder.encode([one], alone), [9], alone)[0], one)
    with pytest.raises(ValueError, match="lacks"):
        rangecoder.encode([np.array([5, 6], np.uint32)], alone)
    every = rangecoder.Table.plain()
    assert len(every.ids) == rangecoder.BOUND and every.shares.min() >= 1 and every.shares.sum() == 1 << every.bits


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_range_coder_bits_of_documents(spark, sf):
    """Whole files with their tables stay below 9 bits an id, where a static code of the ids alone needs 8.36."""
    files = rangecoder.write(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), WORD, 1)
    sizes = files.select(
        F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.octet_length(b["data"])).alias("b"), F.octet_length(F.col("head")["data"]).alias("h"),
        F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n).alias("n"),
    ).agg(F.sum(F.col("b") + F.col("h")), F.sum("n")).first()
    assert sizes[0] * 8 / sizes[1] < 9


def test_token_files(spark, monkeypatch):
    rows, docs = frame(spark, ODD + ["tail"])
    want = sorted(coded(WORD, rows, 1), key=lambda r: (r[0] is not None, r[0] or 0))
    files = rangecoder.write(docs, WORD, 1)
    got = sorted(rangecoder.read(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), hashlib.sha1(bytes(r["ids"])).hexdigest()) for r in got) == sorted((str(i), hashlib.sha1(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want)
    assert rangecoder.read(rangecoder.write(docs.limit(0), WORD, 1)).count() == 0
    with pytest.raises(Exception, match="table of shares"):
        rangecoder.read(files.withColumn("head", F.struct((F.col("head")["crc"] + 1).alias("crc"), F.col("head")["data"].alias("data")))).collect()
    broken = files.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["n"].alias("n"), (b["crc"] + 1).alias("crc"), b["data"].alias("data"))))
    with pytest.raises(Exception, match="checksum"):
        rangecoder.read(broken).collect()


@pytest.mark.parametrize("part, text", [
    ("We get <math>x = 2</math> here.", "We get x = 2 here."), ("Press <button>OK</button> now.", "Press OK now."), ("The <label>total</label> is 5.", "The total is 5."),
    ("See <object data=a.swf>the fallback</object> or <video src=v>your browser</video> text.", "See the fallback or your browser text."), ("Mark <em><button>Yes</button></em> there.", "Mark Yes there."),
])
def test_html_words_of_a_sentence_stay(part, text):
    assert html.extract(f"<article><h1>Title</h1><p>{part}</p><p>Some more words follow.</p></article>", {"word": 3.0}) == f"Title\n\n{text}\n\nSome more words follow."


def test_html_controls_beside_the_text_go():
    body = "<p>" + "Many words stand in this paragraph of the page. " * 8 + "</p>"
    page = f"<article>{body}<button>Share</button><div><label>Mail</label></div><form><p><label>Name</label> <button>Send</button></p></form>{body}</article>"
    text = ("Many words stand in this paragraph of the page. " * 8).strip()
    assert html.extract(page, {"word": 3.0}) == f"{text}\n\n{text}"
