import base64
import hashlib
import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandkit.llm import bpe, html_text, licenses, mixing, pii, quality, queries, simhash, suffixes, syncmers, warc
from tests.llm.fixtures import PROSE, SCHEMA, awkward, nothing

SF = "/root/testdata/sf0.001"
OPERATORS = {
    "pii": pii.find, "bpe": bpe.encode_and_decode, "licenses": licenses.scan, "mixing": mixing.mix, "simhash": simhash.near_duplicates,
    "syncmers": syncmers.edited_fingerprints, "suffixes": suffixes.repeated_bytes, "quality": quality.judge,
}
STAGES = {"keep_good": quality.keep_good, "keep_first": simhash.keep_first, "redact": pii.redact, "emit": mixing.emit}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    out = OPERATORS[name](docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    by_id = {}
    for r in out:
        if r["doc_id"] == 4:
            by_id.setdefault(4, set()).add(r if name not in ("mixing", "syncmers") else None)
    assert len(by_id[4]) == 1  # repeated rows get equal results
    assert OPERATORS[name](nothing(spark)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = awkward(spark)
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert set(r["doc_id"] for r in out.collect()) <= set(r["doc_id"] for r in docs.collect())
    assert STAGES[name](nothing(spark)).count() == 0


# -- personal data
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = [
    "a@b.com_x@y.com.z", "1.2.3.4.5.6.7.8", "300.1.1.1 255.255.255.0255", "4111 1111 1111 1111-4111 1111 1111 1111", "é😀 ann@x.de é ++1 222 333 4444.",
    "4111111111111111", "5  4111-1111-1111-1111 7", "x@y @z.com a.b@c-d.e-f", "+1 (961) 555-6946 +12 3", "a@b.c@d.e", "0.0.0.0.", "@@ ..@.. %@-.-",
]


def test_base_spans_equal_the_plain_patterns(spark, documents, texts):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    every = texts | {10_000 + i: t for i, t in enumerate(HARD)}
    for r in pii.find(docs).collect():
        want = base_spans(every[r["doc_id"]])
        line = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), every[r["doc_id"]]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_labelers_add_written_out_data_and_leave_prose(spark):
    rows = [(i, f"mail me: ann{i}@mail.example.com or card 4111 1111 1111 1111") for i in range(40)]
    rows += [(100, "Please send an e-mail: ann.lee [at] example [dot] com today"), (101, "phone: 00 49 30 1234567 please"), (102, "we met at noon. And version 1.2.3 is out at last")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100]["spans"].startswith("email:") and found[100]["n_email"] == 0
    assert found[102]["spans"] == ""
    masked = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 3").first()["text"]
    assert masked == "mail me: <EMAIL> or card <CARD>"


def test_em_learns_which_labeler_errs():
    good, bad = [1, 1, 1, 1, 0], [1, 1, -1, 1, 0]
    accuracy, posterior = pii.estimate_accuracies([(0, good, 50), (0, bad, 50), (0, [0, -1, 1, -1, 0], 40)])
    assert accuracy[2] < accuracy[1] and posterior[0] > 0.5 > posterior[2]


# -- encoding
def test_encoding_equals_the_library(texts):
    vocab = bpe.vocabulary()
    library = bpe._tokenizer(vocab.path)
    rng = np.random.default_rng(3)
    odd = ["", "<|endoftext|>a <|endoftext|>", "a" * 3000, "ab" * 400, " \n\n x", "\U000187f8 ՘ ²½", "don't we'll I'M"]
    odd += ["".join(chr(c) for c in rng.integers(1, 0xD7FF, 20)) for _ in range(200)] + ["".join(rng.choice(list("abcdeinorst"), 90)) for _ in range(100)]
    batch = [*texts.values(), *odd]
    want = library.encode_batch(batch, add_special_tokens=False)
    got = vocab.encode(batch)
    assert all(list(g) == w.ids for g, w in zip(got, want))
    assert all(vocab.decode(g) == library.decode(w.ids, skip_special_tokens=False) for g, w in zip(got, want))


def test_border_check_equals_merging():
    vocab = bpe.vocabulary()
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, len(vocab.ids), (2, 4000))
    holds = vocab.borders_hold(a, b)
    for x, y, h in zip(a.tolist(), b.tolist(), holds):
        assert h == (vocab.merge(vocab.token_bytes[x] + vocab.token_bytes[y]) == [x, y])


def test_decode_table(spark, documents, texts):
    encoded = bpe.encode_and_decode(documents, with_ids=True).select("doc_id", "ids")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == texts


# -- near duplicates
def brute_components(prints, ids, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            root[find(int(j))] = find(i)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def test_fingerprint_equals_plain_votes(texts):
    import xxhash

    for t in [*list(texts.values())[:30], "A b", "x" * 100, "ÀB c d e f"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
        votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize("limit", [simhash.BUCKET_ROWS, 8])
def test_components_equal_all_pairs(spark, limit):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, np.int64)
    flips = [int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 8)))) for c in centres for _ in range(15)]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(flips)], "id long, fp long")
    found = simhash.components(rows.withColumnRenamed("id", "doc_id"), "doc_id", limit=limit)
    got = {r["doc_id"]: r["name"] for r in rows.withColumnRenamed("id", "doc_id").join(found, "fp").collect()}
    assert got == brute_components(np.array(flips, np.int64).view(np.uint64), list(range(len(flips))), simhash.RADIUS)


def test_masks_cover_every_difference():
    rng = np.random.default_rng(2)
    masks = simhash.covering_masks()
    assert len(masks) == 31
    for _ in range(2000):
        difference = sum(1 << int(b) for b in rng.choice(64, simhash.RADIUS, replace=False))
        assert any(m & difference == 0 for m in masks)


def test_dedup_keeps_one_of_each_group(documents):
    groups = simhash.near_duplicates(documents)
    kept = simhash.keep_first(documents)
    assert sorted(r[0] for r in groups.select("component_id").distinct().collect()) == sorted(r["doc_id"] for r in kept.collect())


# -- mixing
def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 1000, 1), ("b", 10, 1), ("c", 500, 1), (None, 3, 1)], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, weight = 1513.0, {"a": 1, "b": 2, "c": 3, None: 1}
    assert got["b"] == 30 and got[None] == 9
    assert got["a"] == pytest.approx((left - 39) / 4) and got["c"] == pytest.approx((left - 39) * 3 / 4)


def test_mix_stays_near_targets(spark, documents):
    rows = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.max(F.expr("taken - 3 * size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["m"] + 1 and r["over"] <= 0 for r in per)
    total = documents.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert sum(r["g"] for r in per) == pytest.approx(total)
    assert sorted(mixing.mix(documents).collect()) == sorted(mixing.mix(documents.repartition(7)).collect())
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in rows.collect() if r["size"]}
    emitted = Counter(r["doc_id"] for r in mixing.emit(documents).collect())
    assert all(emitted[i] == n for i, n in copies.items())


# -- pages
def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = raw[r["page_id"]]
        body = body[body.index("<article>") + 9 : body.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &lt;words&gt; &amp &copy;", "plain <words> & ©"), ("<p>a<p>b <b>c</b>\n d</p>", "a\nb c d"),
    ("<body><nav><a href=x>menu</a></nav><main><h1>T</h1><p>short</p><aside>side</aside><p>end</p></main><footer>f</footer>", "T\nshort\nend"),
    ("<article><p>x<script>var a='</p>'</script> y</p><form><input>q</form><div class='comments'><article>c</article></div></article>", "x y"),
    ("<div class=\"cookie-notice\">we use cookies</div><div id=content><p>" + "text " * 60 + "</p></div><div class=ad>buy</div>", ("text " * 60).strip()),
    ("<div><a href=1>one</a> <a href=2>two</a></div><div>x</div><hr><p>" + "long text here. " * 20 + "</p>", None),
    ("<article><header><h1>Head</h1></header><p>a<br>b</p><ul><li>1<li>2</ul></article><header>site</header>", "Head\na b\n1\n2"),
])
def test_page_shapes(page, text):
    found = html_text.main_text(page)
    assert found == text if text is not None else "one" not in found and found.endswith("here.")


STORY = "<h1>Title</h1><p>" + "The story goes on. " * 20 + "</p>"
STORY_TEXT = "Title\n" + ("The story goes on. " * 20).strip()


PARAGRAPHS = ["One long paragraph. " * 20, "Another one here. " * 22, "And one more text. " * 21]
SHARE = "<div class=share><a href=x>post</a></div>"
MENU = "".join(f"<div><a href={i}>Menu entry {i}</a></div>" for i in range(5))


@pytest.mark.parametrize("wrapper", ["<body>{}</body>", "<body><div id=content>{}</div></body>"])
@pytest.mark.parametrize("before, after, lines", [
    (f"<h1>Title</h1>{SHARE}", "", ["Title", None]),
    ("", "<div class=ad>buy</div><p>The end.</p>", [None, "The end."]),
    (f"<h1>Title</h1>{SHARE}{MENU}", f"{MENU}<p>The end.</p>", ["Title", None, "The end."]),
])
def test_short_stretches_stay(wrapper, before, after, lines):
    page = wrapper.format(before + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + after)
    story = [p.strip() for p in PARAGRAPHS]
    assert html_text.main_text(page).split("\n") == [x for line in lines for x in ([line] if line else story)]


def test_short_stretch_between_paragraphs_and_references():
    notes = "".join(f"<li><a href={i}>Work number {i}</a></li>" for i in range(6))
    block = "".join(f"<div><p>{p}</p></div>{MENU}<div><p>Short {i}.</p></div>{MENU}" for i, p in enumerate(PARAGRAPHS[:2]))
    assert html_text.main_text(f"<body>{MENU}{block}<div><p>{PARAGRAPHS[2]}</p><ol>{notes}</ol></div>{MENU}<div>Far away</div></body>").split("\n") == [
        PARAGRAPHS[0].strip(), "Short 0.", PARAGRAPHS[1].strip(), "Short 1.", PARAGRAPHS[2].strip(), *[f"Work number {i}" for i in range(6)]]


@pytest.mark.parametrize("names", [
    "content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-banner", "elementor-widget", "site", "widget", "sidebar", "modal overlay", "banner",
])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_wrappers_keep_the_article(names, inner):
    if inner == "div" and names in ("widget", "sidebar", "modal overlay", "banner"):
        pytest.skip("a marked name, and nothing says that the text in it is the article")
    for attribute in ("class", "id"):
        page = f"<body><div class=cookie-notice>we use cookies</div><div {attribute}='{names}'><nav>menu</nav><{inner}>{STORY}<div class='ad-2'>buy</div></{inner}><aside>side</aside></div></body>"
        assert html_text.main_text(page) == STORY_TEXT


@pytest.mark.parametrize("page, text", [
    # the wrapper stands in main, or is a form or hidden element
    (f"<main><p>Over it</p><div class=widget><article>{STORY}</article></div></main>", "Over it\n" + STORY_TEXT),
    (f"<form><main>{STORY}</main></form>", STORY_TEXT), (f"<div hidden><main>{STORY}</main></div>", STORY_TEXT),
    # comments stay out, whatever they stand in
    (f"<article>{STORY}</article><div class=comments><article>{'c' * 999}</article></div>", STORY_TEXT),
    (f"<main>{STORY}<div class=comments><article>{'c' * 999}</article></div></main>", STORY_TEXT),
    (f"<div>{STORY}</div><div class=widget><div class=related><article>{'c' * 999}</article></div></div>", STORY_TEXT),
    (f"<div>{STORY}</div><div class=sidebar><article>A short one</article></div>", STORY_TEXT),
    (f"<main>{STORY}<article class=comment>{'c' * 999}</article></main>", STORY_TEXT),
    (f"<div class=widget><main>{STORY}<div class=comment-2>c</div></main><main class=comments>d</main></div>", STORY_TEXT),
])
def test_marked_elements_around_and_inside(page, text):
    assert html_text.main_text(page) == text


# -- archives
def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}\r\n", t) for i, t in enumerate(["<p>a</p>", "", None, "é" * 3000, "<p>a</p>", "b", "<p>a</p>"])] + [(None, None, "b"), (5, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    payload = {i: (t or "").encode() for i, _, t in rows}
    assert len(got) == len(rows)
    last = {}
    for i, p in payload.items():
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    for r in got:
        p = payload[r["page_id"]]
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        want = (None, "response") if r["page_id"] in (None, last[p]) else (last[p], "revisit")
        assert (r["refers_to"], r["record_type"]) == want and (r["payload"] is None or bytes(r["payload"]) == p)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.read(warc.write(empty)).count() == 0
    assert {r["record_type"] for r in warc.read(warc.write(pages, min_bytes=10_000)).collect()} == {"response"}


def test_frames_are_found_by_the_seek_table(tmp_path):
    import io

    class Kept(io.BytesIO):
        def close(self):
            pass

    stream = Kept()
    bundle = warc.Bundle(stream)
    records = [warc.record(i, "u", bytes([i % 256]) * 200_000) for i in range(20)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    table = warc.seek_table(stream)
    assert len(table) == len(bundle.frames) > 2
    for r, (frame, offset, length) in zip(records, places):
        assert warc.read_frame(stream, table[frame])[offset : offset + length] == r


# -- fingerprints
def test_edited_texts_follow_descending_ids(documents, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(documents).collect()}
    for i, doc in enumerate(order):
        body, following = texts[doc], texts[order[(i + 1) % len(order)]]
        half = len(body) // 2
        edited = body[: len(body) - half] + following[:half]
        r = got[doc]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(body)
        assert r["fingerprint"] == syncmers.written(syncmers.anchors(body)[1]) and r["edited_fingerprint"] == syncmers.written(syncmers.anchors(edited)[1])
        assert 0 <= r["near_next"] <= 1 and (body != following or r["near_next"] == 1)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.25 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_anchors_do_not_depend_on_context():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh ijklm"), 2000))
    at, hashes = syncmers.anchors(text)
    moved, again = syncmers.anchors("prefix" * 9 + text + "suffix")
    inner = set(zip(at.tolist(), hashes.tolist()))
    assert inner <= {(p - 54, h) for p, h in zip(moved.tolist(), again.tolist())}
    assert np.diff(at).max() <= syncmers.K - syncmers.S
    assert (54, 0, 2000) in [(s, 0, 2000) for s, _, _ in syncmers.matches(text, "prefix" * 9 + text)]


# -- repeated strings
def brute_repeats(rows):
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = {}
    for doc, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[doc] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 50_000}])
def test_repeats_equal_brute_force(spark, documents, texts, sizes):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefghij "), 231))
    extra = [passage, "é" + passage[:200], passage[31:] + "!", passage[:199], "ab" * 300, "x" * 500, ""] + [passage[k:] + str(k) * 3 + passage for k in (1, 5, 132)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = [(i, t.encode()) for i, t in texts.items()] + [(10_000 + i, t.encode()) for i, t in enumerate(extra)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_bytes(docs, **sizes).collect()}
    assert got == brute_repeats(rows)


def test_samples_of_blocks_equal_plain_counting():
    lengths = np.array([5, 0, 300_000, 1, 2_500_000, 700, 0, 400_000])
    chunk = suffixes.Chunk(bytes(int(lengths.sum())), lengths)
    want = [s + i for s, n in zip(chunk.starts.tolist(), lengths.tolist()) for i in range(n - 67) if i % suffixes.PERIOD in suffixes.COVER]
    assert chunk.samples(68).tolist() == want


def test_difference_cover():
    assert suffixes.is_cover(suffixes.COVER, suffixes.PERIOD) and max(suffixes.COVER) < suffixes.PERIOD < suffixes.LENGTH


# -- rules and licences
def test_cascade_order_and_short_circuit():
    order = quality.order_rules([(0b01, 50, [1.0, 10.0]), (0b10, 60, [1.0, 10.0]), (0, 100, [2.0, 20.0])], ["cheap", "dear"])
    assert order == ["cheap", "dear"]
    m = quality.Measures("word")
    assert quality.rejected_by(m, ["too_short", "repeats_itself"]) == "too_short" and "n_repeat_words" not in m.__dict__


def test_measures():
    m = quality.Measures("a b c a b c d\n#x\n#x\n\n")
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (9, 11, 2, 1, 6)


def test_licence_rules(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT."
    )
    rows = [(1, "Released under the MIT License.\n" + mit), (2, "Licensed under the Apache License, Version 2.0. All rights reserved."), (3, "the license to sing"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, mit.split("\n")[-1])]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT:text", 2: "Apache-2.0:notice,reserved:notice", 3: "", 4: "GPL-3.0:notice", 5: ""}
    for sentence in licenses.TEXT_SENTENCES.values():
        assert re.search(licenses.CUES, sentence)


WRAPPED = {
    "MIT:text": """MIT License
Copyright (c) 2020 Ann Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "Apache-2.0:text": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause:text,reserved:notice": """Copyright (c) 2020, Ann Example
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3.0-or-later:text": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "ISC:text": """Copyright (c) 2020 Ann Example
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0:notice": "The tool is small.\nThis program is licensed under the terms of the\nMozilla Public License,\nVersion 2.0",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", ";; ", "dnl ", "REM "])
def test_wrapped_licence_texts(spark, mark):
    rows = [(wanted, ending.join(mark + line for line in text.split("\n"))) for wanted, text in WRAPPED.items() for ending in ("\n", "\r\n")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["licenses"]) for r in got] == [(wanted, wanted) for wanted, _ in rows]


def test_lines_apart_are_no_sentence(spark):
    rows = [(1, "Licensed under the\n\nMIT License"), (2, "Licensed under the.\nMIT License"), (3, "Licensed under the MIT License\nand more words here"), (4, "\n" * 50_000 + "Licensed under the MIT\nLicense" + " \n" * 50_000)]
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, ""), 2: (0, ""), 3: (1, "MIT:notice"), 4: (1, "MIT:notice")}


def test_spdx_tags(spark):
    rows = [(f"{licence}:notice", f"{before} {name}{after}") for licence, names in licenses.NAMES.items() for name in names[-1:] for before, after in (("# SPDX-License-Identifier:", "\nimport os"), ("/* SPDX-License-Identifier:\t", " */"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["licenses"]) for r in got] == [(wanted, wanted) for wanted, _ in rows]


# -- queries and the pipeline
@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    import duckdb

    from tools.check import rows_of

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_pipeline_against_plain_python(spark, documents, texts):
    out = corpus_pipeline.run(spark, SF).collect()
    good = {i: t for i, t in texts.items() if quality.rejected_by(quality.Measures(t), list(quality.RULES)) is None}
    ids = list(good)
    parts = brute_components(np.array([simhash.fingerprint(good[i]) for i in ids], np.uint64), ids, simhash.RADIUS)
    first = {i: t for i, t in good.items() if parts[i] == i}
    rows = spark.createDataFrame(list(first.items()), "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    for i, t in first.items():
        want, at = "", 0
        for a, k, e in base_spans(t):
            if a >= at:
                want, at = want + t[at:a] + f"<{KINDS[k].upper()}>", e
        assert masked[i] == want + t[at:]
    sources = {r["doc_id"]: r["source"] for r in documents.collect()}
    frame = spark.createDataFrame([(i, t, sources[i]) for i, t in masked.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(frame).collect()}
    assert Counter(r["doc_id"] for r in out) == Counter({i: n for i, n in copies.items() if n})
    vocab = bpe.vocabulary()
    want = {i: list(x) for i, x in zip(masked, vocab.encode(list(masked.values())))}
    assert all(r["ids"] == want[r["doc_id"]] for r in out)


def test_stages_cover_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "token_ids"]
    assert PROSE and SCHEMA.names[0] == "doc_id"
