import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from spanledger.llm import decontam, embeddings, graph, simhash, toxicity, warc
from spanledger.llm.common import read, settle


def joined(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def test_components_reach_the_smallest_id(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "u BIGINT, v BIGINT")).collect()}
    label = joined(260, pairs)
    assert got == {i: label[i] for i in range(260) if label[i] != i}
    assert graph.components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def near_prints(seed, n):
    """Clusters around a few centres, and strangers."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_finds_every_pair():
    prints = np.array(near_prints(2, 300), np.uint64)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(prints[i] ^ prints[j]).bit_count() <= 3}
    for most in (1 << 20, 16):
        got = {(int(i), int(j)) for a, b in simhash.trie_pairs(np.zeros(300, int), prints, 3, most) for i, j in zip(a, b)}
        assert got == want and len(want) > 50
    assert not list(simhash.trie_pairs(np.arange(300), prints, 3))


@pytest.mark.parametrize("most,many", [(8192, 1 << 27), (20, 1 << 27), (8192, 10)])
def test_links_give_the_components_of_brute_force(spark, most, many):
    prints = near_prints(3, 200)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id BIGINT, fp BIGINT")
    found = {r.id: r.component for r in graph.components(simhash.links(settle(rows), 3, most, many)).collect()}
    label = joined(200, [(i, j) for i in range(200) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert [found.get(i, i) for i in range(200)] == label


def test_simhash_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(200))
    given = [(5, text), (3, text.upper()), (3, text.upper()), (9, text + " more"), (None, text), (7, None), (8, " "), (6, "two words"), (None, "quite alone here today"), (4, "x " * 30000)]
    docs = spark.createDataFrame(given, "doc_id BIGINT, text STRING").withColumns({c: F.lit(1) for c in ("fp", "id", "row", "kept_id", "component_id")})
    got = simhash.near_duplicates(settle(simhash.fingerprints(docs))).collect()
    assert len(got) == len(given)
    of = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {v for (i, _), v in of.items() if i in (5, 3)} == {3} and {v for (i, _), v in of.items() if i in (7, 8)} == {7}
    assert sorted(str(v) for (i, _), v in of.items() if i is None) == ["3", "None"]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IN (5, 8)").count() == 0
    # a row without an id goes with its component, and stays where it is alone
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["quite alone here today"]
    # texts under one id are members of their own components
    other = " ".join(f"other{i}" for i in range(200))
    twice = spark.createDataFrame([(1, text), (5, text), (5, other), (7, other + " end"), (None, "no id here at all"), (None, "no id here at all")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(twice).collect()) == [(0, "no id here at all"), (1, text), (5, other)]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [*base, *(base[:30] + 0.02 * rng.normal(size=(30, 16))), base[0], 3 * base[1]]
    given = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (0, [float(x) for x in rows[0]])]
    df = spark.createDataFrame(given, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("n", F.lit(1)).withColumn("label", F.lit(2))
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(given) and not any(r.n_links for r in got if 200 <= r.vec_id <= 204)
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    want = close.sum(1) - 1 + close[:, 0]  # vector 0 is there twice
    by = {r.vec_id: r for r in got}
    hit = sum(by[i].n_links for i in range(len(rows)))
    assert all(by[i].n_links <= want[i] for i in range(len(rows))) and hit >= 0.9 * want.sum()
    assert by[60].component_id == 0 and by[90].component_id == 0 and by[206].component_id == 205 and by[200].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("offset, chunk", [(0.0, 2048), (1.0, 2048), (2.0, 7)])
def test_recall_at_the_threshold(spark, offset, chunk):
    """Pairs with a cosine of 0.95 to 0.97, also of vectors about a common direction, against all pairs."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(500, 64)) / 8 + offset * np.eye(64)[0]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = np.concatenate([base, *[embeddings.at_threshold(base, c, rng) for c in (0.952, 0.96, 0.97)]])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    close = rows @ rows.T >= 0.95
    want = close.sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    assert all(got[i] <= want[i] for i in range(len(rows)))
    assert sum(got.values()) >= 0.95 * want.sum()


def test_vectors_of_extreme_size(spark):
    """Norms beyond the range of a double, and below it, compare like any other."""
    given = [(1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [1e-200, 2e-200]), (5, [-1.0, 2.0]), (6, [5e-324, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(given, "vec_id BIGINT, embedding ARRAY<DOUBLE>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


@pytest.mark.parametrize("ranges", [1, 13])
def test_revisits_match_brute_force(spark, ranges):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        url = rng.choice(["http://www.A.org:80/x/?b=2&a=1#f", "https://a.org/x?a=1&utm_source=q&b=2", "http://b.org/", None, "no url"])
        kind = rng.choice(["response", "revisit", "revisit", "other", None])
        rows.append((i, url, rng.choice([None, *range(20)]), kind, rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d1", "d2"]), rng.choice([None, {"Date": str(i), "Content-Length": "3"}]), f"g{i}"))
    schema = "record_id BIGINT, url STRING, at BIGINT, kind STRING, etag STRING, last_modified STRING, headers MAP<STRING,STRING>, digest STRING"
    df = spark.createDataFrame(rows, schema).withColumn("own", F.lit(1)).withColumn("range", F.lit(1))
    got = {r.record_id: r for r in warc.resolve(df, ranges).collect()}
    name = lambda u: {"h": "a.org/x?a=1&b=2", "b": "b.org"}.get("b" if u and "b.org" in u else "h" if u and "/x" in u else "", None)
    tag = lambda e: e.removeprefix("W/")
    for i, url, at, kind, etag, date, headers, _ in rows:
        r = got[i]
        assert r.canonical_url == name(url)
        if kind != "revisit":
            assert r.outcome == ("response" if kind == "response" else "ignored") and r.response_id is None
            continue
        before = [x for x in rows if x[3] == "response" and name(url) and name(x[1]) == name(url) and at is not None and x[2] is not None and (x[2], x[0]) < (at, i)]
        last = max(before, key=lambda x: (x[2], x[0])) if before else None
        if last is None:
            want = "no_response"
        elif etag and last[4]:
            want = "resolved" if tag(etag) == tag(last[4]) else "mismatch"
        elif date and last[5]:
            want = "resolved" if date == last[5] else "mismatch"
        else:
            want = "unvalidated"
        assert r.outcome == want
        if want == "resolved":
            stored = {k.lower(): v for k, v in (last[6] or {}).items()}
            assert r.response_id == last[0] and r.merged == stored | ({"date": headers["Date"]} if headers else {})
    assert warc.resolve(df.limit(0)).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    labels = read(spark, SF, "labels")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, SF))
        assert after.columns == columns and after.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append((name, docs.count() - after.count()))
        if name == "toxicity":
            clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
            assert clean.join(after, "doc_id", "left_anti").count() <= 0.02 * clean.count()
        if name == "simhash":
            found = simhash.near_duplicates(settle(simhash.fingerprints(docs)))
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in found.collect()}
        if name == "decontamination":
            bad = decontam.contamination(docs, read(spark, SF, "benchmark")).where("contaminated")
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} == {r.doc_id for r in bad.collect()}
        docs = after
    assert dict(sizes)["toxicity"] > 0 and dict(sizes)["simhash"] > 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_toxic_documents_are_caught(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).withColumnRenamed("toxic", "found").join(labels, "doc_id").toPandas()
    assert scored.found[scored.toxic == 0].mean() < 0.02 and scored.found[scored.toxic == 1].mean() > 0.8


def odd_corpus(spark, root, documents):
    """Documents with clashing further columns, labels and benchmark items, as tables under `root`."""
    known = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    extra = {c: F.lit(1) for c in ("row", "letter", "fp", "th", "kept_id", "batch", "toxic", "h")}
    documents.withColumns(extra).write.parquet(f"{root}/documents.parquet")
    known.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id BIGINT, toxic INT")).write.parquet(f"{root}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").write.parquet(f"{root}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    top = plain.agg(F.max("doc_id")).first()[0]
    names = ["doc_id", "text", "lang", "source"]
    word = "plain words about rivers and the long road to the sea with many stones "
    odd = spark.createDataFrame(
        [(top + 1, None, "en", "s"), (top + 2, "", "en", "s"), (top + 3, "  \n ", None, None), (None, word * 3 + "unnamed", "en", "s"), (top + 4, word * 4000, "en", "s"), (top + 4, word * 4000, "en", "s")],
        ", ".join(f"{c} {'BIGINT' if c == 'doc_id' else 'STRING'}" for c in names))
    given = plain.select(*names).unionByName(odd)
    odd_corpus(spark, str(tmp_path), given)
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()
    # texts without a letter have no language; a repeated row stays once
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and not {top + 1, top + 2, top + 3} & set(ids) and len(ids) > 100


def test_pipeline_on_an_empty_table(spark, tmp_path):
    odd_corpus(spark, str(tmp_path), spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
