import binascii
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from spanledger.llm import covertree, runs, topk
from spanledger.llm.queries import ORACLES, QUERIES


def slow_runs(words, least=12):
    """Every period by itself: stretches where words q apart agree, and the smallest period of each stretch."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loops(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 8, 40]))}é" for _ in range(rng.randrange(120))]
        if words and rng.random() < 0.5:
            a, p = rng.randrange(len(words)), rng.randrange(1, 25)
            words = words[:a] + [words[a:a + p][i % len(words[a:a + p])] for i in range(len(words) - a)]
        if rng.random() < 0.4:
            part = words[:rng.randrange(1, 20)]
            words = words + part * rng.randrange(1, 7) + words[:9] + part * 4
        yield words


def test_runs_match_every_period_tried():
    for seed, most in ((1, 300), (2, 7)):
        docs = list(loops(seed, 300))
        for at in range(0, len(docs), most):
            part = docs[at:at + most]
            bounds = np.append(0, np.cumsum([len(d) for d in part])).astype(np.int64)
            flat = [f"{i}:{w}" for i, d in enumerate(part) for w in d]
            symbols = np.unique(flat, return_inverse=True)[1].astype(np.int64) if flat else np.zeros(0, np.int64)
            start, end, period = runs.find(symbols, bounds)
            got = [[] for _ in part]
            for s, e, q in zip(start, end, period):
                i = int(np.searchsorted(bounds, s, "right")) - 1
                got[i].append((int(s - bounds[i]), int(e - s), int(q)))
            assert got == [slow_runs(d) for d in part]


def test_a_nonterminal_is_looked_at_once():
    words = np.array(list(range(40)) * 64)
    bounds = np.array([0, len(words)])
    grammar = runs.Grammar(words, bounds)
    # a grammar of a repeated block: far fewer nodes than words, and each made at all its places
    assert grammar.n < 200 and sum(len(p) for p in grammar.place) > 40 * 40
    assert [tuple(int(v[0]) for v in runs.find(words, bounds))] == [(0, 2560, 40)]


def test_runs_of_odd_rows(spark):
    long = " ".join(f"v{i % 977}" for i in range(60000))
    given = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (None, "x y " * 8), (6, long), (6, long), (7, "a b " * 20), (8, "one two three")]
    docs = spark.createDataFrame(given, "doc_id BIGINT, text STRING").withColumns({c: F.lit(1) for c in ("runs", "collapsed", "n_words", "start")})
    got = runs.runs(docs, most=1000).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in given)
    of = {r.doc_id: r for r in got}
    assert [of[i].n_words for i in (1, 2, 3, 4, 5, None, 6, 7)] == [0, 0, 0, 11, 12, 16, 60000, 20]
    assert of[4].runs == [] and of[4].collapsed == "a" + " a" * 10 and of[5].collapsed == "a"
    assert [tuple(r) for r in of[None].runs] == [(0, 16, 2)] and [tuple(r) for r in of[6].runs] == [(0, 60000, 977)]
    assert of[6].collapsed == " ".join(f"v{i}" for i in range(977)) and of[7].collapsed == "a b" and of[1].collapsed == ""
    assert runs.runs(docs.limit(0)).count() == 0
    # words that come again without any run
    again = spark.createDataFrame([(1, " ".join(f"a{i} the" for i in range(40)))], "doc_id BIGINT, text STRING")
    assert [r.runs for r in runs.runs(again).collect()] == [[]]


def test_runs_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), binascii.crc32(str(doc_id).encode())
        if n > 3000:
            continue  # the restatement takes the square of the words
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = slow_runs(words)
        r = got[doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_collapse(words, want).encode()).hexdigest()
        some += len(want)
    assert some > 20


ODD = [(900, None), (901, [float("nan")] * 4), (902, [None] * 4), (903, [float("inf")] * 4), (None, [1.0] * 4), (904, []), (905, [1.0]), (906, [0.0] * 4), (907, [1.0, 2.0, 3.0, 4.0, 5.0])]


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e120 for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def vectors(seed, n, big=1.0, sparse=False):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, 4)), 1) * big
    if sparse:
        v *= rng.random(v.shape) < 0.4
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(v)] + ODD + [(10, [0.5] * 4), (10, [0.5] * 4), (20, [-0.5] * 4)]


def held(score):
    return max(-(1 << 63), min((1 << 63) - 1, score))


@pytest.mark.parametrize("pack,bin,big,sparse", [(16384, 1024, 1.0, False), (17, 3, 1.0, True), (50, 5, 1e4, False), (40, 4, 1e9, True), (300, 9, 1e15, False)])
def test_topk_matches_brute_force(spark, pack, bin, big, sparse):
    given = vectors(pack, 150, big, sparse)
    df = spark.createDataFrame(given, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumns({c: F.lit(1) for c in ("row", "pack", "score", "vec")})
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 4, pack=pack, bin=bin).collect()
    rows = [(i, whole(v)) for i, v in given if i is not None and usable(v)]
    want = []
    for at, (i, v) in enumerate(rows):
        if i % 10 == 0:
            best = sorted((-held(dot(v, w)), j) for k, (j, w) in enumerate(rows) if k != at)[:4]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


def test_topk_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    asked = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, topk.top_k(df, asked, 5).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(df.limit(0), asked, 5).count() == 0 and topk.top_k(df, F.lit(False), 5).count() == 0


def slow_negatives(rows, anchors, least=30, most=90):
    out = []
    for at, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        scores = [(-held(dot(v, w)), j, k) for k, (j, _, w) in enumerate(rows)]
        near = sorted((s, j) for s, j, k in scores if rows[k][1] == label and k != at)[:5]
        for s, p in near:
            chosen = sorted((t, j) for t, j, k in scores if rows[k][1] != label and least * -s <= -100 * t <= most * -s)[:10]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(chosen)]
    return sorted(out)


@pytest.mark.parametrize("pack,bin,big,labels,spread", [(8192, 256, 1.0, 3, 1.0), (23, 4, 1.0, 2, 0.05), (60, 7, 1e4, 50, 1.0), (40, 5, 1e8, 3, 0.3)])
def test_negatives_match_brute_force(spark, pack, bin, big, labels, spread):
    rng = np.random.default_rng(pack)
    centres = rng.normal(size=(6, 4))
    v = (centres[rng.integers(6, size=240)] + spread * rng.normal(size=(240, 4))) * big
    given = [(int(i), int(rng.integers(labels)), [float(x) for x in np.round(row, 1)]) for i, row in enumerate(v)]
    given += [(i, 1, x) for i, x in ODD] + [(5, None, [1.0] * 4), (10, 1, [0.5] * 4), (10, 1, [0.5] * 4), *given[:5]]
    df = spark.createDataFrame(given, "vec_id BIGINT, label INT, embedding ARRAY<DOUBLE>").withColumns({c: F.lit(1) for c in ("row", "pack", "node", "place")})
    got = covertree.hard_negatives(df, F.col("vec_id") % 10 == 0, pack=pack, bin=bin).collect()
    rows = [(i, k, whole(x)) for i, k, x in given if i is not None and k is not None and usable(x)]
    want = slow_negatives(rows, lambda i: i % 10 == 0)
    got = sorted(map(tuple, got))
    assert [r for r in got if r not in set(want)] == [] and [r for r in want if r not in set(got)] == []
    assert got == want and len(want) > 100
    assert covertree.hard_negatives(df.limit(0), F.lit(True)).count() == 0


def test_cover_tree_levels_and_bounds():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(400, 5)) * 40)
    x[:50] = x[0]
    unit, most = covertree.augmented(x)
    assert np.allclose((unit * unit).sum(1), 1) and most == pytest.approx(np.sqrt((x * x).sum(1)).max())
    order, radius, first, count = covertree.grow(unit)
    assert sorted(order) == list(range(400))
    below = [[] for _ in order]
    for node in range(399, -1, -1):
        for child in range(first[node], first[node] + count[node]):
            below[node] += [child, *below[child]]
        angles = np.arccos(np.clip(unit[order[below[node]]] @ unit[order[node]], -1, 1))
        assert (angles <= radius[node]).all()
    assert sorted([0, *below[0]]) == list(range(400))


def test_clusters_outside_the_windows_are_skipped(spark):
    """Of well separated clusters only few rows are scored."""
    rng = np.random.default_rng(8)
    rows = np.floor(256 * (np.repeat(np.eye(8), 200, 0) + 0.01 * rng.normal(size=(1600, 8))))
    import pyarrow as pa
    table = pa.table({"pack": pa.array([0] * 1600, pa.int32()), "row": range(1600), "vec_id": range(1600), "label": [0] * 1600, "vec": (rows / 256).tolist()})
    forest = covertree.Forest(covertree.plant(table), 8, True)
    scored = 0
    plain = forest.x

    class Counted:
        def __getitem__(self, at):
            nonlocal scored
            scored += len(at)
            return plain[at]

    forest.x = Counted()
    best = forest.search(rows[0], forest.roots, [(None, None)], 5, 0)[0]
    want = sorted((-int(rows[0] @ rows[j]), j) for j in range(1, 1600))[:5]
    assert [(-s, i) for s, i in best] == want and scored < 500


@pytest.mark.parametrize("name", ["op12_topk", "op13_negatives"])
def test_searches_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = QUERIES[name](spark, SF).columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == sorted(want) and want
