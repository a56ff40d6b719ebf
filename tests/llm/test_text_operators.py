import hashlib
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from spanledger.llm import decontam, html, langid, licences, lm, packing, toxicity
from spanledger.llm.common import read

ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (3, " \n\t "), (4, "Ünïcode \U0001f600 " * 3000), (None, "the end")]


def docs_of(spark, given, extra=True):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(given, "doc_id BIGINT, text STRING")
    return df.withColumns({c: F.lit("x") for c in ("h", "words", "score", "row", "n", "line", "toxic", "lang")}) if extra else df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = sentences(rng, words, 40).split()
        for _ in range(rng.randint(1, 5) if bad else 0):
            text.insert(rng.randrange(len(text)), "grobian" + rng.choice(["e", "en", "isch", ""]))
        texts.append(" ".join(text))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_separates_and_orders_grades(insults):
    texts, toxic = insults
    model = toxicity.fit(pa.table({"text": texts[:200], "toxic": toxic[:200]}))
    p = model.grades(pa.array([*texts[200:], None, ""]))
    assert np.allclose(p.sum(1), 1) and (np.diff(model.cuts) >= 0).all() and p.shape[1] == 3
    flagged = 1 - p[:100, 0] >= 0.25
    assert (flagged == (np.array(toxic[200:]) == 1)).all()
    severity = p @ np.arange(3)
    many, one = model.grades(pa.array(["grobian grobiane grobianen grobianisch w1", "grobian w1"])) @ np.arange(3)
    assert many > one > severity[:100][~flagged].max()


def test_ordinal_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    grade = np.array([0, 1, 2] * 50)
    rows, cols = np.arange(150), grade + 3 * rng.integers(0, 2, 150)
    w, cuts = toxicity.fit_ordinal(rows, cols, 6, grade, 0.0, 1e-4, 300, np.ones(150))
    up = 1 / (1 + np.exp(-(cuts[None, :] - w[cols][:, None])))
    p = np.diff(np.hstack([np.zeros((150, 1)), up, np.ones((150, 1))]))
    assert (p.argmax(1) == grade).mean() > 0.95


def test_toxicity_odd_rows_and_empty_tables(spark, insults):
    texts, toxic = insults
    docs = docs_of(spark, [*enumerate(texts[:60]), *[(i and i + 100, t) for i, t in ODD]])
    labels = spark.createDataFrame([*[(i, t) for i, t in enumerate(toxic[:60])], (None, 1), (7, None), (999, 1)], "doc_id BIGINT, toxic INT")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 60 + len(ODD) and all(0 <= r.severity <= 2 for r in got)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert {r.severity for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = read(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs, ~held)
    got = langid.predict(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = docs_of(spark, [*ODD, (9, "1234 ... !!"), (9, "1234 ... !!")])
    seen = langid.predict(odd, model).collect()
    assert len(seen) == 9 and all((r.lang_pred, r.score) == ("und", 0.0) for r in seen if r.doc_id in (1, 2, 3, 9))
    kept = langid.identified(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == 2
    bare = langid.train(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, bare).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_ngram_counts_match_a_plain_count():
    text = "Straße AB ab 日本語の文 ж"
    got = next(langid.counts(pa.array([text])))
    assert got.sum() == sum(len(text) - k + 1 for k in langid.ORDERS)
    apart = list(langid.counts(pa.array(["xy", None, text, "日本", "ж"])))
    assert (apart[2] == got).all() and apart[1].sum() == 0 and apart[0].sum() == 1 and apart[3].sum() == 1 and apart[4].sum() == 0
    # equal grams of characters share a bucket wherever they stand
    grams = [t[i:i + k] for t in (text.replace("A", "a").replace("B", "b").replace("S", "s"),) for k in langid.ORDERS for i in range(len(t) - k + 1)]
    assert sorted(got[got > 0]) == sorted(Counter(grams).values())


def test_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 8, replace=False)) + 1
        rows = rng.integers(1, 50, 8)

        def padding(bounds):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, rows))

        best = min(padding([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
        assert padding(packing.boundaries(lengths, rows, 3)) == best


def test_packing_places_every_row_once(spark):
    rng = random.Random(4)
    given = [(i, "a " * rng.randint(0, 300)) for i in range(400)] + [(i and i + 1000, t) for i, t in ODD] + [(5000, "b " * 5000)]
    got = packing.pack(docs_of(spark, given), budget=512, buckets=6, cell_rows=50).toPandas()
    assert len(got) == len(given) and (got.padding >= 0).all() and got.bucket_len.nunique() <= 6
    assert not got.duplicated(["bucket_len", "batch_id", "place"]).any() and (got.place < got.batch_capacity).all()
    assert ((got.batch_capacity * got.bucket_len <= 512) | (got.batch_capacity == 1)).all()
    for _, batch in got.groupby("bucket_len"):
        assert sorted(batch.batch_id * batch.batch_capacity + batch.place) == list(range(len(batch)))
    expected = sorted(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t in given)
    assert sorted(got.n_tokens) == expected
    assert packing.pack(docs_of(spark, []).limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><a href="/">home</a></nav>
<div class="cookie-notice">accept all</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
 two<br>three &eacute;<p>Next &#x41;</p><form><input>send</form><aside>side</aside><div id="comments"><p>first!</p></div></article><footer>&copy; x</footer>"""


def test_article_text_and_broken_markup(spark):
    given = [(1, "http://a.org/1", PAGE), (1, "http://a.org/1", PAGE), (2, None, None), (None, "nonsense", ""), (3, "http://a.org/2", "<p>open <b>and <i>lost"), (4, "http://b.org", "plain <unended")]
    pages = spark.createDataFrame(given, "page_id BIGINT, url STRING, html STRING").withColumns({c: F.lit(1) for c in ("row", "host", "text", "content")})
    got = {(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()}
    text = "Head & line\n\nOne bold two three é\n\nNext A"
    assert got == {(1, text, len(text)), (2, "", 0), (None, "", 0), (3, "open and lost", 13), (4, "plain", 5)}
    assert html.extract(pages).count() == 6 and html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard_tokens", [20, 1 << 20])
def test_host_runs_match_brute_force(spark, shard_tokens):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(30)]
    menu = sentences(rng, words, 12)
    streams = {}
    for i in range(40):
        own = sentences(rng, [f"{i}u{k}" for k in range(20)], 25)
        streams[i] = f"{menu if i % 4 else sentences(rng, words, 9)} {own} {menu[:40]}"
    streams[40] = streams[3]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", f"<p>{s}</p>") for i, s in streams.items()], "page_id BIGINT, url STRING, html STRING")
    held = {}
    for i, s in streams.items():
        w = s.split()
        for k in range(len(w) - 7):
            held.setdefault((i % 2, tuple(w[k:k + 8])), set()).add(s)
    for r in html.extract(pages, shard_tokens=shard_tokens).collect():
        w = streams[r.page_id].split()
        gone = {j for k in range(len(w) - 7) if len(held[(r.page_id % 2, tuple(w[k:k + 8]))]) > 1 for j in range(k, k + 8)}
        assert r.text == " ".join(x for j, x in enumerate(w) if j not in gone)


@pytest.mark.parametrize("given, text", [
    ("<div class='layout with-sidebar'><article>body</article><div class=sidebar>x</div></div>", "body"),
    ("<div class=widget><p>w</p><article>in<div class=share>s</div></article></div>", "in"),
    ("<article><p class='ad-free'>keep</p><p class='ad'>no</p></article>", "keep"),
    ("<h1>Head</h1><div>body</div><article class=teaser>tease</article>", "Head\n\nbody\n\ntease"),
    ("<div class=comments><article>c</article></div><div role='main'>m<nav>n</nav></div>", "m"),
    ("<article>own<article class='comment'>c</article></article><div hidden><main>x</main></div>", "own"),
])
def test_wrappers_and_blocks_beside_an_article(spark, given, text):
    pages = spark.createDataFrame([(1, "http://a.org/1", given)], "page_id BIGINT, url STRING, html STRING")
    assert html.extract(pages).first().text == text


@pytest.mark.parametrize("shard_tokens", [1500, 1 << 20])
def test_articles_against_brute_force(spark, shard_tokens):
    """Notices printed into most articles of a shard go, copied articles and lines that few share stay, loose text goes by runs outside articles."""
    rng = random.Random(12)
    fresh = lambda i, n: sentences(rng, [f"{i}w{k}" for k in range(40)], n)
    notice, line, banner, story = fresh("n", 14), fresh("l", 12), fresh("b", 10), fresh("s", 60)
    made = {}
    for i in range(60):
        body = [fresh(i, 30), fresh(f"{i}x", 20)]
        if i % 10:
            body.insert(1, notice)
        if i % 5 == 0:
            body.insert(0, line)
        if i in (7, 8):
            body = [story, notice]
        made[i] = ([banner, fresh(f"{i}y", 9)], body)
    page = lambda loose, body: "<div>" + "</div><div>".join(loose) + "</div><article><p>" + "<p>".join(body) + "</article>"
    given = [(i, "http://h.org/p", page(*m)) for i, m in made.items()] + [(100 + k, "http://h.org/q", page(*made[3])) for k in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(given, "page_id BIGINT, url STRING, html STRING"), shard_tokens=shard_tokens, common=0.5, common_pages=2).collect()}
    assert len(got) == len(given)
    for i, _, _ in given:
        (_, own), body = made[3 if i >= 100 else i]
        assert got[i] == "\n\n".join([own, *[x for x in body if x != notice]])


@pytest.mark.parametrize("shard_tokens", [200, 900, 3000, 1 << 20])
def test_shares_of_a_host_do_not_depend_on_its_shards(spark, shard_tokens):
    """Of notices with shares about the bound those go that the pages of the whole host hold often enough."""
    rng = random.Random(21)
    fresh = lambda i, n: sentences(rng, [f"{i}w{k}" for k in range(40)], n)
    held = {24: fresh("a", 12), 31: fresh("b", 12), 32: fresh("c", 12), 33: fresh("d", 12), 40: fresh("e", 12)}
    made = {i: [fresh(i, 300 if i == 7 else 90), *[notice for n, notice in held.items() if (i * 7 + n) % 40 < n]] for i in range(40)}
    given = [(i, "http://h.org/p", "<article><p>" + "<p>".join(m) + "</article>") for i, m in made.items()]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(given, "page_id BIGINT, url STRING, html STRING"), shard_tokens=shard_tokens).collect()}
    gone = {notice for n, notice in held.items() if n >= 32}
    assert got == {i: "\n\n".join(x for x in m if x not in gone) for i, m in made.items()}


def test_a_host_of_copied_articles_keeps_them(spark):
    rng = random.Random(13)
    story = sentences(rng, [f"w{k}" for k in range(50)], 80)
    pages = spark.createDataFrame([(i, "http://h.org/", f"<nav>{i}</nav><article>{story}</article>") for i in range(20)], "page_id BIGINT, url STRING, html STRING")
    assert {r.text for r in html.extract(pages).collect()} == {story}


def test_suffix_runs_count_pages():
    a, b = "a b c d e".split(), "x b c d y b c d".split()
    runs, pages = html.suffix_runs([a, b, []], [0, 1, 2], 3)
    assert dict(zip(runs, pages))["b c d"] == 2 and dict(zip(runs, pages))["c d e"] == 1 and "e x b" not in runs


def test_language_model_is_proper_and_base_is_exact(spark):
    rng = random.Random(6)
    given = [(i, sentences(rng, [f"{'ab'[i % 2]}{k}" for k in range(60)], rng.randint(1, 80)).title()) for i in range(80)] + ODD
    docs = docs_of(spark, given)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model, others = lm.fit(docs, ~held, frequent=40, width=8, tails=4, table=70)
    got = sorted(lm.score(docs, model, others).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    cut = lambda t: re.findall(r"[^\x20\x09-\x0d]+", lower(t or "")) + ["\n"]
    c = {}
    for i, t in given:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            for w in cut(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted(((i, cut(t)) for i, t in given), key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    for r, (i, w) in zip(got, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(w), sum(x in c for x in w), n)
        assert np.isclose(r.base_score, sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w))
    h = np.random.default_rng(0).normal(size=(1, 16)).astype(np.float32)
    net = model.net
    frequent = sum(np.exp(net.score(h, np.array([y]))[0]) for y in range(net.frequent))
    tails = sum(np.exp(net.score(h, np.array([net.frequent + j]))[0]) for j in range(net.tails))
    assert np.isclose(frequent + tails, 1, atol=1e-4)
    alone = [lm.document_scores(net, [d])[0] for d in ([0, 3, 5] * 30, [2])]
    assert np.allclose(lm.document_scores(net, [np.array([0, 3, 5] * 30), np.array([2])], window=7), [lm.document_scores(net, [np.array(d)])[0] for d in ([0, 3, 5] * 30, [2])]) and len(alone) == 2
    empty, rest = lm.fit(docs.limit(0), F.lit(True))
    assert {r.base_score for r in lm.score(docs, empty, rest).collect()} == {0.0}


def brute(given, items, size=10):
    cut = lambda t: re.findall(decontam.WORDS, lower(t or ""))
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for i, text in given:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(y) for y in x if y is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)] + ["É", "é"]
    items = [(i, sentences(rng, words, n)) for i, n in enumerate([3, 9, 10, 11, 25, 40, 25])] + [(7, None), (8, "!!"), (None, sentences(rng, words, 12)), (2, "Zq Zr")]
    given = []
    for i in range(60):
        text = sentences(rng, words, rng.randint(0, 60))
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            text += ", " + " ".join(w[rng.randint(0, 2):]).upper() + " " + sentences(rng, words, 5)
        given.append((i, text))
    given += [*ODD, given[0]]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING").withColumn("n", F.lit("clash"))
    docs = docs_of(spark, given)
    found = decontam.contamination(docs, bench)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(given, items)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in brute(given, items))
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_licences_of_whole_documents(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(50)]
    notice = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    given = []
    for i in range(120):
        lines = [sentences(rng, words, 12) for _ in range(3)]
        if i % 4 < 3 and i % 2:
            lines.insert(1, list(notice.values())[i % 3])
        given.append((i, "\n".join(lines)))
    given += [*[(i and i + 1000, t) for i, t in ODD], (200, "licensed to kill " + sentences(rng, words, 5)), (201, "Released under the MIT License.\nAll rights reserved."), (201, "Released under the MIT License.\nAll rights reserved.")]
    docs = docs_of(spark, given)
    model = licences.train(docs, sample=150)
    got = licences.scan(docs, model).collect()
    assert len(got) == len(given)
    named = {r.doc_id: r.licences for r in got if r.doc_id is not None}
    for i, text in given:
        if i is not None:
            assert named[i] == ",".join(sorted(k for k, t in notice.items() if t in (text or "")))
    assert [r.n_licence_lines for r in got if r.doc_id == 201] == [2, 2]
    assert licences.scan(docs.limit(0), licences.train(docs.limit(0))).count() == 0


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the foundation.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
}


def plain_shares(text):
    """Share of each family's best template in `text`, by plain loops."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    words, out = split(text), {}
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            w = split(t)
            share = len(grams(w) & grams(words)) / len(grams(w)) if len(w) >= 5 else float(any(words[i:i + len(w)] == w for i in range(len(words))))
            out[family] = max(out.get(family, 0.0), share)
    return out


def test_wrapped_notices_and_every_line_scored(spark):
    """Notices wrapped at any width, with comment marks, are found; what `required` leaves unscored has no licence; shares match loops."""
    rng = random.Random(21)
    words = [f"v{i}" for i in range(60)]
    given = [(i, "\n".join(sentences(rng, words, 14) + "." for _ in range(3))) for i in range(60)]
    want = {}
    for k, (family, notice) in enumerate(NOTICES.items()):
        for width in (30, 72):
            for mark in ("", "# ", " * "):
                i = 1000 + len(want)
                lines = [mark + x for x in textwrap.wrap(notice, width)]
                given.append((i, "\n".join([sentences(rng, words, 9) + ".", "", *lines, "", sentences(rng, words, 9) + "."]).replace("\n", "\r\n" if k % 2 else "\n")))
                want[i] = family
    # talk of a licence that no template holds
    given += [(2000 + i, f"{sentences(rng, words, 12)}.\nCopyright holders grant you a licence of their own {sentences(rng, words, 3)}.") for i in range(20)]
    docs = docs_of(spark, given)
    model = licences.train(docs, sample=200)
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    assert {i: got[i].licences for i in want} == want and all(got[i].n_licence_lines == 0 for i in range(60))
    assert sum(got[2000 + i].n_unknown == 1 for i in range(20)) >= 19
    every = licences.licence_lines
    found = sorted(tuple(r)[2:4] for r in every(docs, model).collect())
    needed, licences.required = licences.required, lambda *_: None
    try:
        assert sorted(tuple(r)[2:4] for r in every(docs, model).collect()) == found
    finally:
        licences.required = needed
    lines = licences.with_features(licences.lines_of(docs).select("line"))
    for r in licences.template_match(lines, licences.TEMPLATES, 0.8).collect():
        plain = plain_shares(r.line)
        assert max(plain.values()) == pytest.approx(max((s.share for s in r.similarity), default=0.0))


def test_language_model_learns_from_long_texts_and_more_rows(spark):
    """Texts beyond the starting sample's bounds teach what follows what; the network's size is bounded."""
    rng = random.Random(8)
    after = {f"p{k}": f"q{k}" for k in range(20)}
    chain = lambda n: " ".join(f"{w} {after[w]}" for w in rng.choices(list(after), k=n))
    given = [(i, chain(3000)) for i in range(24)] + [(100, chain(200)), (101, " ".join(rng.choices([*after, *after.values()], k=400)))]
    assert all(len(t) > 16384 for i, t in given if i < 100)
    docs = docs_of(spark, given)
    score = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, *lm.fit(docs, F.col("doc_id") < 100)).collect()}
    assert score[100] > score[101] + 0.5 and score[100] > np.log10(1 / 40) + 0.5
    many = docs_of(spark, [(i, " ".join(f"w{k}" for k in range(i * 900, i * 900 + 900))) for i in range(100)])
    model, _ = lm.fit(many, F.lit(True))
    assert model.v == 90001 and model.net.frequent == 4096 and len(model.net.p["in"]) == 4096 + 2048 + 1


def test_rare_words_depend_on_the_state(spark):
    rng = random.Random(9)
    pair = lambda a, b, i: " ".join(f"{x} r{rng.randrange(10**6)}{e}" for x, e in ((a, "aaa"), (b, "zzz")) * 200)
    docs = docs_of(spark, [(i, pair("p0", "p1", i)) for i in range(60)] + [(100, pair("p0", "p1", 0)), (101, pair("p1", "p0", 0))])
    model, others = lm.fit(docs, F.col("doc_id") < 100, frequent=4, width=8, tails=64)
    score = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, model, others).collect()}
    assert score[100] > score[101] + 0.5


def small_network():
    rng = np.random.default_rng(1)
    net = lm.start(rng.integers(1, 9, 13), 9, 4, 4, 5)
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) * (k != "out_b") for k, v in net.p.items()}
    return net


def test_scores_match_a_plain_loop():
    net = small_network()
    docs = [np.array([3, 12, 0, 7, 7, 9, 1]), np.array([0]), np.array([5, 5])]
    sig = lambda x: 1 / (1 + np.exp(-x))
    for doc, got in zip(docs, lm.document_scores(net, docs, window=3)):
        h, x, total = np.zeros(5), 13, 0.0
        for y in doc:
            a, u = net.p["in"][x], h @ net.p["rec"]
            r, z = sig(a[:5] + u[:5]), sig(a[5:10] + u[5:10])
            h = (1 - z) * np.tanh(a[10:] + r * u[10:]) + z * h
            cls = h @ net.p["cls"] + net.p["cls_b"]
            own = h @ net.p["out"][y // 4] + net.p["out_b"][y // 4]
            total += cls[y // 4] - np.log(np.exp(cls).sum()) + own[y % 4] - np.log(np.exp(own).sum())
            x = y
        assert np.isclose(got, total, rtol=1e-5)


def test_gradients_match_differences():
    net = small_network()
    docs = [np.array([3, 12, 0, 7, 7, 9, 1]), np.array([5, 5, 2])]
    own = lm.Learner.of(net)
    told = {}
    own.move = lambda name, at, g, rate: told.setdefault(name, []).append((at, np.array(g, float)))
    own.learn(docs, window=32)
    for name, of in told.items():
        g = np.zeros_like(net.p[name])
        for at, part in of:
            g[at] += part
        flat = net.p[name].reshape(-1)
        for i in np.random.default_rng(2).choice(flat.size, min(40, flat.size), replace=False):
            keep, loss = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = keep + step
                loss.append(-lm.document_scores(net, docs).sum() / 10)
            flat[i] = keep
            assert np.isclose((loss[0] - loss[1]) / 2e-5, g.reshape(-1)[i], atol=2e-5), (name, i)
    assert set(told) == set(net.p)


def test_grouped_sums_and_windows_match_plain_loops():
    rng = np.random.default_rng(3)
    times = np.array([1, 30, 2, 8, 9, 1])
    rows = rng.normal(size=(times.sum(), 3))
    assert np.allclose(lm.grouped(rows, times), [part.sum(0) for part in np.split(rows, np.cumsum(times)[:-1])])
    lengths, starts = np.array([5, 3, 3, 1]), np.array([0, 5, 8, 11])
    sizes, lane, place = lm.window_of(starts, lengths, 1, 4)
    assert sizes.tolist() == [3, 3, 1] and lane.tolist() == [0, 1, 2, 0, 1, 2, 0] and place.tolist() == [1, 6, 9, 2, 7, 10, 3]
    fresh = np.array([False, False, True, False, False, False, False])
    assert lm.starting(fresh, sizes) == [True, False, False]


def test_words_are_looked_up_together_like_one_by_one():
    words = [lm.END, b"the", "\u00e4\u00f6".encode(), b"a"]
    table = lm.Lookup(words, 8)
    for texts in (["The a zz \u00c4\u00f6 x", None, "running \u5b57", "a " * 5], [None], []):
        names, index, bounds = lm.laid(pa.array(texts, pa.string()))
        cut = [[*lower(t or "").encode().split(), lm.END] for t in texts]
        got = table(names)[index]
        assert got.tolist() == [words.index(w) if w in words else len(words) + lm.tail_of(w, 8) for c in cut for w in c]
        assert np.diff(bounds).tolist() == [len(c) for c in cut]


def test_windows_use_their_memory_again():
    """Once it has learned a window, a learner asks for little more: it holds its arrays of steps."""
    rng = np.random.default_rng(4)
    net = lm.start(np.ones(600), 500, 32, 100, 16)
    docs = [rng.integers(0, 600, 64) for _ in range(256)]
    own = lm.Learner.of(net)
    own.learn(docs, lanes=256, window=32)
    tracemalloc.start()
    try:
        own.learn(docs, lanes=256, window=32)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 500 * 8192


def test_texts_of_several_batches_are_scored_together(spark):
    """Every row gets its own score, whether texts wait for those of later Arrow batches or not."""
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choices(["a", "b", "the", "Zq", "rare%d" % i], k=rng.randint(1, 90))) for i in range(21))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b")], "doc_id long, text string").coalesce(1)
    model, others = lm.fit(docs, F.col("doc_id") < 9, frequent=4, width=8, tails=8, table=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        apart, some, whole = ({r.doc_id: r for r in lm.score(docs, model, others, most=most).collect()} for most in (1, 100, 1 << 22))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(apart) == set(some) == set(whole) == {None, *range(len(texts))}
    for other in (some, whole):
        for k, r in apart.items():
            assert np.allclose(r[1:], other[k][1:], rtol=1e-6)


def test_texts_of_several_batches_are_learned_together(spark, tmp_path):
    """A task's texts share their lanes beyond Arrow batches, so that long texts do not leave lanes empty batch after batch."""
    net = lm.start(np.ones(13), 9, 4, 4, 5)
    words = [f"w{k}".encode() for k in range(9)]
    codes = np.arange(13)
    squares = {k: np.zeros_like(v) for k, v in net.p.items()}
    docs = [np.array([0, 1, 2, 3]), np.array([4, 5, 6])] * 20
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in d[:-1]),) for d in docs], "text STRING").coalesce(1)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = lm.train_all(texts, net, squares, words, codes, 200)
        apart = lm.train_all(texts, net, squares, words, codes, 200, most=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    own = lm.Learner.of(net, squares)
    end = codes[9 + lm.tail_of(lm.END, 4)]
    own.learn([np.append(d[:-1], end) for d in docs])
    assert all(np.allclose(got.p[k], own.net.p[k], atol=1e-5) for k in net.p)
    assert not np.allclose(apart.p["out"], own.net.p["out"], atol=1e-5)


def test_every_language_is_learned(spark):
    """More languages than 64, and one whose training texts are all longer than a sample."""
    rng = random.Random(12)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(10)] for k in range(70)}
    given = [(i, sentences(rng, own[f"l{i % 69:02}"], 50), f"l{i % 69:02}") for i in range(69 * 10)]
    given += [(1000 + i, sentences(rng, own["l69"], 12000), "l69") for i in range(2)]
    assert all(len(t) > 32768 for i, t, _ in given if i >= 1000)
    train = spark.createDataFrame(given, "doc_id BIGINT, text STRING, lang STRING")
    model = langid.train(train, F.lit(True))
    new = spark.createDataFrame([(k, sentences(rng, own[f"l{k:02}"], 50)) for k in range(70)], "doc_id BIGINT, text STRING")
    assert model.langs == sorted(own)
    assert [r.lang_pred for r in langid.predict(new, model).orderBy("doc_id").collect()] == sorted(own)
