"""Queries over cumulative metric points and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters
from . import bridge
from .bridge import with_histograms, with_points

EDITS = "copilot_chat.edit.acceptance.count"
OPERATIONS = "gen_ai.client.operation.duration"
SHOWN = ["feed", "session", "start_ms", "metric"]


def _series(spark, d):
    return counters.counter_series(bridge.points(spark, d))


def _mixed(spark, d):
    """Token usage of both kinds: counters as they are, histograms as usage of a model named after their metric."""
    kind = F.when(F.col("metric").contains("tool"), "output").otherwise("input")
    named = F.map_concat("attrs", F.create_map(F.lit("gen_ai.response.model"), "metric", F.lit("gen_ai.token.type"), kind))
    usage = bridge.histograms(spark, d).withColumns({"attrs": named, "metric": F.lit(counters.TOKEN_USAGE), "is_hist": F.lit(True)})
    return bridge.points(spark, d).withColumn("is_hist", F.lit(False)).unionByName(usage, allowMissingColumns=True)


def _tag():
    return F.coalesce(*[F.col("attrs")[k] for k in ("gen_ai.token.type", "copilot_chat.edit.outcome", "type", "success")])


def _named(series):
    return series.select(
        *SHOWN, _tag().alias("tag"), F.col("attrs")["gen_ai.response.model"].alias("resp"),
        F.col("attrs")["gen_ai.request.model"].alias("req"), "total", "updated_ms",
    )


def _increase(spark, d):
    """Growth of series without a start time, restarts banked."""
    return _named(_series(spark, d).where(F.col("start_ms") == 0))


def _quantiles(spark, d):
    runs = counters.histogram_runs(bridge.histograms(spark, d))
    return counters.hist_quantiles(runs, [0.5, 0.95])


def _chat_quantiles(spark, d):
    runs = counters.histogram_runs(bridge.histograms(spark, d))
    return counters.hist_quantiles(counters.matching(runs, OPERATIONS, {"gen_ai.operation.name": "chat"}), [0.5, 0.95])


QUERIES = {
    "series_latest": lambda spark, d: _named(_series(spark, d).where(F.col("start_ms") > 0)),
    "counter_increase": _increase,
    "late_points": lambda spark, d: counters.judged(bridge.points(spark, d))[1].where("late").select("feed", "session", "metric", "seq", "at_ms"),
    "metric_validity": lambda spark, d: counters.metric_validity(counters.judged(bridge.points(spark, d))[1]),
    "metric_total": lambda spark, d: counters.metric_total(_series(spark, d), EDITS, {"copilot_chat.edit.outcome": "accepted"}).select("total"),
    "metric_observations": lambda spark, d: _series(spark, d).groupBy("metric").agg(F.sum("count").alias("observations")),
    "metric_mean": lambda spark, d: counters.histogram_series(counters.histogram_runs(bridge.histograms(spark, d), buckets=False))
        .groupBy("metric").agg(F.sum("total").alias("total"), F.sum("count").alias("observations"),
                               F.try_divide(F.sum("total"), F.sum("count")).alias("mean")),
    "metric_has_attr": lambda spark, d: counters.has_attribute(_series(spark, d), "gen_ai.response.model"),
    "tokens_by_model": lambda spark, d: counters.tokens_by_model(_series(spark, d)).drop("share"),
    "tokens_by_model_both_kinds": lambda spark, d: counters.tokens_by_model(counters.series(_mixed(spark, d))).drop("share"),
    "model_token_share": lambda spark, d: counters.tokens_by_model(_series(spark, d)).select("model", "share"),
    "token_totals": lambda spark, d: counters.token_totals(_series(spark, d)),
    "token_series": lambda spark, d: counters.token_series(bridge.points(spark, d), bridge.NOW_MS),
    "burn_rate": lambda spark, d: counters.burn_rate(counters.token_series(bridge.points(spark, d), bridge.NOW_MS)),
    "series_key": lambda spark, d: bridge.points(spark, d).groupBy(counters.series_key(F.col("attrs")).alias("series_key")).agg(
        F.count(F.lit(1)).alias("points")),
    "histogram_series": lambda spark, d: counters.histogram_series(counters.histogram_runs(bridge.histograms(spark, d), buckets=False)).select(
        *SHOWN, F.coalesce(F.col("attrs")["gen_ai.operation.name"], F.lit("none")).alias("op"), "total", "count"),
    "hist_quantile": _quantiles,
    "hist_quantile_chat": _chat_quantiles,
}

SERIES_OUT = "SELECT feed, session, start_ms, metric, tag, resp, req, total, updated_ms FROM series"
TOKENS_SQL = """,
tm AS (SELECT coalesce(resp, req, 'unknown') AS model, coalesce(sum(total) FILTER (tag = 'input'), 0) AS i, coalesce(sum(total) FILTER (tag = 'output'), 0) AS o
  FROM series WHERE metric = 'gen_ai.client.token.usage' AND tag IN ('input', 'output') GROUP BY 1),
tk AS (SELECT model, CAST(floor(i + 0.5) AS BIGINT) AS input, CAST(floor(o + 0.5) AS BIGINT) AS output, CAST(floor(i + o + 0.5) AS BIGINT) AS total FROM tm)"""
BUCKETS_SQL = f""",
g AS (SELECT p.feed, p.seq, CASE WHEN p.at_ms > 0 THEN p.at_ms ELSE {bridge.NOW_MS} END AS t_ms,
   coalesce(CASE WHEN p.tag = 'input' THEN i.grown END, 0) AS gi, coalesce(CASE WHEN p.tag = 'output' THEN i.grown END, 0) AS go
   FROM pts p LEFT JOIN inc i ON i.seq = p.seq AND p.metric = 'gen_ai.client.token.usage'),
c AS (SELECT *, sum(gi) OVER w AS ci, sum(go) OVER w AS co, max(t_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer
   FROM g WINDOW w AS (PARTITION BY feed ORDER BY seq)),
b AS (SELECT feed, t_ms, CAST(sum(greatest(0, floor(ci + 0.5) - floor(ci - gi + 0.5))) AS BIGINT) AS input,
   CAST(sum(greatest(0, floor(co + 0.5) - floor(co - go + 0.5))) AS BIGINT) AS output FROM c WHERE newer IS NULL OR t_ms >= newer GROUP BY 1, 2),
bk AS (SELECT * FROM b)"""
BOUNDS = str([float(b) for b in bridge.BOUNDARIES])


def quantile_sql(where: str) -> str:
    return with_histograms(f""",
cells AS (SELECT metric, i AS idx, sum(CASE WHEN i = slot THEN c_ ELSE i END)::DOUBLE AS n FROM runs, range(0, 16) r(i) {where} GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY idx) AS upto, sum(n) OVER (PARTITION BY metric) AS all_ FROM cells),
hit AS (SELECT metric, q, idx, n, upto, all_ FROM cum, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) v(q)
  WHERE n > 0 AND upto >= q * all_ QUALIFY row_number() OVER (PARTITION BY metric, q ORDER BY idx) = 1)
SELECT metric, q, all_ AS samples, lo + (hi - lo) * greatest(0, least(1, (q * all_ - (upto - n)) / n)) AS value FROM (
  SELECT *, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE ({BOUNDS}::DOUBLE[])[idx] END AS lo,
         coalesce(({BOUNDS}::DOUBLE[])[idx + 1], ({BOUNDS}::DOUBLE[])[idx] * 2) AS hi FROM hit)""")


ORACLES = {
    "series_latest": with_points(f" {SERIES_OUT} WHERE start_ms > 0"),
    "counter_increase": with_points(f" {SERIES_OUT} WHERE start_ms = 0"),
    "late_points": with_points(" SELECT feed, session, metric, seq, at_ms FROM marked WHERE late"),
    "metric_validity": with_points(" SELECT metric, count(*) AS points, count(*) FILTER (late) AS late, count(*) FILTER (NOT ok AND NOT late) AS malformed FROM marked GROUP BY 1"),
    "metric_total": with_points(f" SELECT sum(total) AS total FROM series WHERE metric = '{EDITS}' AND tag = 'accepted'"),
    "metric_observations": with_points(" SELECT metric, count(*)::DOUBLE AS observations FROM series GROUP BY 1"),
    "metric_mean": with_histograms(" SELECT metric, sum(total) AS total, sum(count) AS observations, sum(total) / sum(count) AS mean FROM hs GROUP BY 1"),
    "metric_has_attr": with_points(" SELECT metric, bool_or(resp IS NOT NULL) AS has_attribute FROM series GROUP BY 1"),
    "tokens_by_model": with_points(TOKENS_SQL + " SELECT * FROM tk"),
    "tokens_by_model_both_kinds": bridge.with_both(TOKENS_SQL + """
SELECT model, input, output, total FROM tk UNION ALL
SELECT metric, CAST(coalesce(sum(total) FILTER (NOT contains(metric, 'tool')), 0) AS BIGINT) AS input, CAST(coalesce(sum(total) FILTER (contains(metric, 'tool')), 0) AS BIGINT) AS output,
  CAST(sum(total) AS BIGINT) FROM hs GROUP BY 1"""),
    "model_token_share": with_points(TOKENS_SQL + " SELECT model, total::DOUBLE / (SELECT sum(total) FROM tk)::DOUBLE AS share FROM tk"),
    "token_totals": with_points(
        " SELECT CAST(floor(sum(total) FILTER (tag = 'input') + 0.5) AS BIGINT) AS input, CAST(floor(sum(total) FILTER (tag = 'output') + 0.5) AS BIGINT) AS output"
        " FROM series WHERE metric = 'gen_ai.client.token.usage'"),
    "token_series": with_points(BUCKETS_SQL + " SELECT feed, t_ms, input, output FROM bk"),
    "burn_rate": with_points(BUCKETS_SQL + """
SELECT feed, CASE WHEN max(t_ms) > min(t_ms) THEN (sum(input + output) - arg_min(input + output, t_ms))::DOUBLE / ((max(t_ms) - min(t_ms)) / 3600000.0::DOUBLE) ELSE 0.0 END AS burn_per_hour
FROM bk GROUP BY feed"""),
    "series_key": with_points("""
SELECT CASE metric WHEN 'copilot_chat.edit.acceptance.count' THEN 'copilot_chat.edit.outcome=' || tag WHEN 'copilot_chat.lines_of_code.count' THEN 'type=' || tag
  WHEN 'copilot_chat.tool.call.count' THEN 'success=' || tag
  ELSE 'gen_ai.request.model=' || req || chr(1) || coalesce('gen_ai.response.model=' || resp || chr(1), '') || 'gen_ai.token.type=' || tag END AS series_key,
  count(*) AS points FROM pts GROUP BY 1"""),
    "histogram_series": with_histograms(" SELECT feed, session, start_ms, metric, op, total, count FROM hs"),
    "hist_quantile": quantile_sql(""),
    "hist_quantile_chat": quantile_sql(f"WHERE metric = '{OPERATIONS}' AND op = 'chat'"),
}
