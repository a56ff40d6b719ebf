"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import covertree, decontam, embeddings, html, langid, licences, lm, packing, runs, simhash, topk, toxicity, warc
from .common import crc_of_id, read, settle


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_of_id(F.col("doc_id")) % 4 == 2
    model = langid.train(docs, ~held)
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(settle(simhash.fingerprints(read(spark, sf_dir, "documents"))))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_of_id(F.col("doc_id")) % 7 == 2
    scored = lm.score(docs, *lm.fit(docs, ~held))
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full response for each page, and two later revisits under other spellings of its URL.

    Of the revisits some carry a stale entity tag, some only a date, some no validator at all.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("digest"))
    turn = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("turn")
    rows = pages.select("page_id", "url", "digest", turn).withColumn("r", F.pmod(F.col("page_id") + F.col("turn"), F.lit(7)))
    again = F.col("turn") > 0
    date = F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    return rows.select(
        (F.col("page_id") * 3 + F.col("turn")).alias("record_id"),
        F.when(F.col("turn") == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).when(F.col("turn") == 2, F.regexp_replace("url", "^https?:", "HTTP:")).otherwise(F.col("url")).alias("url"),
        (F.col("page_id") + F.col("turn") * 1000).alias("at"), F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again & (F.col("r") == 3), '"stale"').when(again & F.col("r").isin(4, 5), None).otherwise(tag).alias("etag"),
        F.when(again & (F.col("r") == 5), None).otherwise(date).alias("last_modified"),
        F.when(again, F.create_map(F.lit("Date"), F.col("turn").cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")))
        .otherwise(F.create_map(F.lit("date"), F.lit("0"), F.lit("content-length"), F.lit("9"), F.lit("content-type"), F.lit("text/html"))).alias("headers"),
        "digest",
    )


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return warc.resolve(captures(spark, sf_dir)).select("record_id", "canonical_url", "at", "kind", "outcome", "response_id", "response_digest", merged.alias("merged_headers"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = runs.runs(docs.select("doc_id", runs.periodised(F.col("doc_id"), F.col("text")).alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    longest = found.withColumn("top", top).withColumns({"length": F.col("top").getField("length"), "start": -F.col("top").getField("col2"), "period": -F.col("top").getField("col3")})
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return longest.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", F.floor(F.col("length") * 1000 / F.col("period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return covertree.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_language": op2_language, "op3_packing": op3_packing, "op4_html": op4_html, "op5_lm": op5_lm, "op6_decontam": op6_decontam,
    "op7_revisits": op7_revisits, "op8_simhash": op8_simhash, "op9_embeddings": op9_embeddings, "op10_licences": op10_licences,
    "op11_runs": op11_runs, "op12_topk": op12_topk, "op13_negatives": op13_negatives,
}
_WHOLE = """
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
"""
ORACLES: dict[str, str] = {
    "op12_topk": f"""
        WITH e AS ({_WHOLE}), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
    """,
    "op13_negatives": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_WHOLE}) WHERE label IS NOT NULL), pairs AS (
            SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS own, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0
        ), near AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT n.anchor_id, n.positive_id, row_number() OVER (PARTITION BY n.anchor_id, n.positive_id ORDER BY p.score DESC, p.vec_id)::INTEGER AS rank,
            p.vec_id AS negative_id, n.positive_score, p.score AS negative_score
        FROM near n JOIN pairs p ON p.anchor_id = n.anchor_id AND NOT p.own AND 30 * n.positive_score <= 100 * p.score AND 100 * p.score <= 90 * n.positive_score
        QUALIFY rank <= 10
    """,
}
