"""Cumulative metric series: snapshots, restarts, late points, totals and quantiles.

Points: feed, rec (export sequence within the landed data), seq (arrival
sequence), session, metric, attrs MAP<STRING,STRING>, start_ms (0 = none),
at_ms (0 = none), and either `value` or the histogram columns h_sum, h_count,
boundaries, counts. A table with both kinds tells them apart by `is_hist`. A series is (feed, session, start, metric, attrs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import nonnegative, round_half_up
from ..session import cut
from .scan import HOT_ROWS, Prefix, SlicedScan, prefix_scan

SERIES = ["feed", "session", "start_ms", "metric", "series_key"]
TOKEN_USAGE = "gen_ai.client.token.usage"


def series_key(attrs: Column) -> Column:
    """Sorted `k=v` pairs joined by U+0001."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\x01")


def keyed(points: DataFrame, histogram: bool) -> DataFrame:
    """Add series_key, the level `v` (counter value or histogram sum) and whether the point is well formed."""
    level = F.when(nonnegative(F.col("h_count")).isNotNull(), nonnegative(F.col("h_sum"))) if histogram else nonnegative(F.col("value"))
    # told before any scan, so that no window holds the buckets themselves
    listed = [(F.col("counts").isNotNull() & F.col("boundaries").isNotNull()).alias("listed")] if histogram else []
    return points.select("*", series_key(F.col("attrs")).alias("series_key"), level.alias("v"), *listed).withColumn("ok", F.col("v").isNotNull())


def _late(mark: Column) -> Column:
    """A dated point older than the newest accepted one, or than the point that opened the series."""
    newest = F.greatest(mark, F.col("opened.at_ms"))
    return F.coalesce((F.col("at_ms") > 0) & (F.col("at_ms") < newest), F.lit(False))


def judged(points: DataFrame, hot_rows: int = HOT_ROWS, histogram: bool = False) -> tuple[SlicedScan, DataFrame]:
    """Rows with `late`: a static running maximum, since every well-formed punctual point is accepted."""
    scan = SlicedScan(keyed(points, histogram), SERIES, ["seq"], hot_rows)
    rows = scan.run(scan.rows, {
        "opened": Prefix("min", F.struct("seq", "at_ms"), inclusive=False),
        "mark": Prefix("max", F.when(F.col("ok"), F.col("at_ms")), inclusive=False),
    })
    return scan, rows.withColumn("late", _late(F.col("mark"))).drop("mark")


def judged_after(points: DataFrame, before: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counter rows with `late` and `opened_at`, after earlier batches. before: SERIES, opened_at, mark (newest well-formed time)."""
    scan = SlicedScan(keyed(points, False), SERIES, ["seq"], hot_rows)
    rows = scan.run(scan.rows, {
        "opened": Prefix("min", F.struct("seq", "at_ms"), inclusive=False),
        "newest": Prefix("max", F.when(F.col("ok"), F.col("at_ms")), inclusive=False),
    })
    earlier = before.select(*SERIES, F.col("opened_at").alias("_opened"), F.col("mark").alias("_mark"))
    opened = F.coalesce("_opened", "opened.at_ms")
    late = (F.col("at_ms") > 0) & (F.col("at_ms") < F.greatest("newest", "_mark", opened))
    return rows.join(earlier, SERIES, "left").select(
        *SERIES, "seq", "at_ms", "v", "ok", F.coalesce(late, F.lit(False)).alias("late"), F.coalesce(opened, "at_ms").alias("opened_at"))


def settle_histograms(points: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[SlicedScan, DataFrame]:
    """Histogram rows with `late` and `accepted`."""
    scan, settled = settled_levels(points, hot_rows)
    return scan, scan.rows.join(settled.select(*SERIES, "seq", "accepted", "late"), [*SERIES, "seq"])


def settled_levels(points: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[SlicedScan, DataFrame]:
    """Keys, levels and whether buckets are `listed` of histogram rows, with `late` and `accepted`.

    Within a run that names its start, a point below the accepted sum or count
    is ignored and leaves no mark, so acceptance depends on earlier acceptance.
    Two bounds close in on it: the running maximum of points not yet ruled out
    is never too low, that of points already accepted never too high. The first
    open point of each series is decided every round, so the loop ends; ordinary
    feeds settle in one.
    """
    dims = ["at_ms", "v", "h_count"]
    scan, first = judged(points, hot_rows, histogram=True)
    restartable = F.col("start_ms") == 0
    verdict = F.when(~F.col("ok"), F.lit(False)).when(restartable, ~F.col("late"))
    # The loop carries keys and levels only; buckets and attributes rejoin at the end.
    rows = first.select(*SERIES, "_slice", "seq", "opened", *dims, "listed", verdict.alias("accepted"))
    plain = [c for c in rows.columns if c != "accepted"]

    def narrowed(rows: DataFrame) -> DataFrame:
        bounds = {}
        for d in dims:
            bounds[f"hi_{d}"] = Prefix("max", F.when(F.coalesce("accepted", F.lit(True)), F.col(d)), inclusive=False)
            bounds[f"lo_{d}"] = Prefix("max", F.when(F.coalesce("accepted", F.lit(False)), F.col(d)), inclusive=False)

        def below(side: str) -> Column:
            return (
                _late(F.col(f"{side}_at_ms")) | F.coalesce(F.col("v") < F.col(f"{side}_v"), F.lit(False))
                | F.coalesce(F.col("h_count") < F.col(f"{side}_h_count"), F.lit(False))
            )

        verdict = F.coalesce("accepted", F.when(~below("hi"), F.lit(True)).when(below("lo"), F.lit(False)))
        return scan.run(rows, bounds).select(*plain, verdict.alias("accepted"))

    while True:
        # two passes over the same partitions share a round
        rows = cut(narrowed(narrowed(rows)))
        if rows.where(F.col("accepted").isNull()).isEmpty():
            break
    final = scan.run(rows, {"mark": Prefix("max", F.when(F.col("accepted"), F.col("at_ms")), inclusive=False)})
    return scan, final.select(*SERIES, "_slice", "seq", *dims, "listed", "accepted", _late(F.col("mark")).alias("late"))


def _runs(scan: SlicedScan, accepted: DataFrame) -> DataFrame:
    """Number the runs of each series: without a start time, a drop means the process restarted."""
    before = scan.run(accepted, {"prev": Prefix("last", F.col("v"), inclusive=False)})
    drop = ((F.col("start_ms") == 0) & (F.col("v") < F.col("prev"))).cast("int")
    return scan.run(before.withColumn("drop", F.coalesce(drop, F.lit(0))), {"run": Prefix("sum", F.col("drop"))})


def counter_growth(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Accepted counter points with `growth`, what each adds to its series.

    Without a start time a drop is a restart and the whole value is new. With
    one, a value below the run's peak is a delayed export and adds nothing.
    """
    scan, rows = judged(points, hot_rows)
    seen = scan.run(rows.where(F.col("ok") & ~F.col("late")), {
        "prev": Prefix("last", F.col("v"), inclusive=False), "peak": Prefix("max", F.col("v"), inclusive=False),
    })
    fresh = F.col("v") - F.coalesce(F.when(F.col("start_ms") > 0, F.col("peak")).otherwise(F.col("prev")), F.lit(0.0))
    growth = F.when(fresh >= 0, fresh).when(F.col("start_ms") > 0, F.lit(0.0)).otherwise(F.col("v"))
    return seen.withColumn("growth", growth).drop("prev", "peak")


def counter_series(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per counter series: its total over restarts; a counter is one observation."""
    return counter_growth(points, hot_rows).groupBy(*SERIES).agg(
        F.any_value("attrs").alias("attrs"), F.sum("growth").alias("total"), F.lit(1.0).alias("count"),
        F.max("at_ms").alias("updated_ms"), F.min("seq").alias("first_seq"),
    )


def histogram_runs(points: DataFrame, hot_rows: int = HOT_ROWS, buckets: bool = True) -> DataFrame:
    """One row per run: peak sum and count, and, unless `buckets` is off, the run's newest buckets.

    The scans carry keys and levels; attributes and buckets join the runs afterwards, by series and place.
    """
    scan, rows = settled_levels(points, hot_rows)
    # stored, a row for each run: reports read runs several times, and each reading would scan all points again
    runs = cut(_runs(scan, rows.where(F.col("accepted"))).groupBy(*SERIES, "run").agg(
        F.max("v").alias("total"), F.max("h_count").alias("count"), F.max(F.when(F.col("listed"), F.col("seq"))).alias("newest"),
        F.max("at_ms").alias("updated_ms"), F.min("seq").alias("first_seq"),
    ))
    kept = keyed(points, True)
    first = runs.groupBy(*SERIES).agg(F.min("first_seq").alias("seq"))
    named = kept.select(*SERIES, "seq", "attrs").join(first, [*SERIES, "seq"]).groupBy(*SERIES).agg(F.any_value("attrs").alias("attrs"))
    found = runs.join(named, SERIES)
    if not buckets:
        return found.drop("newest")
    held = kept.select(*SERIES, F.col("seq").alias("newest"), F.struct("boundaries", "counts").alias("buckets"))
    newest = runs.select(*SERIES, "run", "newest").join(held, [*SERIES, "newest"]).groupBy(*SERIES, "run").agg(F.any_value("buckets").alias("buckets"))
    return cut(found.join(newest, [*SERIES, "run"], "left").drop("newest"))


def histogram_series(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*SERIES).agg(
        F.any_value("attrs").alias("attrs"), F.sum("total").alias("total"), F.sum("count").cast("double").alias("count"),
        F.max("updated_ms").alias("updated_ms"), F.min("first_seq").alias("first_seq"),
    )


def histogram_growth(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Accepted histogram points with `growth` of the sum; after a restart the whole sum is new."""
    scan, rows = settle_histograms(points, hot_rows)
    seen = scan.run(rows.where(F.col("accepted")), {"prev": Prefix("last", F.col("v"), inclusive=False)})
    fresh = F.col("v") - F.coalesce("prev", F.lit(0.0))
    return seen.withColumn("growth", F.when(fresh >= 0, fresh).otherwise(F.col("v"))).drop("prev")


def by_kind(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Counter points and histogram points; a table without `is_hist` holds counters only."""
    if "is_hist" not in points.columns:
        return points, None
    return points.where(~F.col("is_hist")), points.where("is_hist")


def series(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per series of either kind: total and observations, restarts banked."""
    plain, histograms = by_kind(points)
    found = counter_series(plain, hot_rows)
    return found if histograms is None else found.unionByName(histogram_series(histogram_runs(histograms, hot_rows, buckets=False)))


def growth(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(feed, rec, metric, attrs, growth): what every accepted point of either kind adds."""
    columns = ["feed", "rec", "metric", "attrs", "growth"]
    plain, histograms = by_kind(points)
    found = counter_growth(plain, hot_rows).select(*columns)
    return found if histograms is None else found.unionByName(histogram_growth(histograms, hot_rows).select(*columns))


def matching(series: DataFrame, metric: str, where: dict[str, str] | None = None) -> DataFrame:
    """Series of a metric whose attributes equal `where`; a missing attribute counts as ''."""
    tests = [F.coalesce(F.col("attrs")[k], F.lit("")) == v for k, v in (where or {}).items()]
    return series.where(reduce(lambda a, b: a & b, tests, F.col("metric") == metric))


def metric_total(series: DataFrame, metric: str, where: dict[str, str] | None = None) -> DataFrame:
    """One row: total, observations and mean (NULL without observations)."""
    return matching(series, metric, where).agg(
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("count"), F.lit(0.0)).alias("observations"),
        F.when(F.sum("count") > 0, F.sum("total") / F.sum("count")).alias("mean"),
    )


def has_attribute(series: DataFrame, key: str) -> DataFrame:
    return series.groupBy("metric").agg(F.bool_or(F.map_contains_key("attrs", key)).alias("has_attribute"))


def hist_quantiles(runs: DataFrame, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q, value) from merged bucket counts; linear inside a bucket, NULL without samples.

    Boundaries are those of the newest run of the earliest series; runs with another
    bucket count are left out. Bucket rows per group are few, so the running sum is small.
    """
    by = by or ["metric"]
    one = list(dict.fromkeys([*by, *SERIES]))
    held = runs.where(F.col("buckets").isNotNull()).select(*one, "run", "first_seq", "buckets.boundaries", "buckets.counts")
    layouts = held.groupBy(*one).agg(F.min("first_seq").alias("opened"), F.max_by(F.struct("boundaries", F.size("counts").alias("width")), "run").alias("last"))
    first = layouts.groupBy(*by).agg(F.min_by("last", "opened").alias("last")).select(*by, F.col("last.boundaries").alias("bounds"), "last.width")
    summed = (
        held.select(*by, F.size("counts").alias("width"), F.posexplode("counts").alias("idx", "n"))
        .groupBy(*by, "width", "idx").agg(F.sum("n").cast("double").alias("n")).join(first, [*by, "width"])
    )
    upto = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    cum = summed.select(
        "*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("all"),
    ).where(F.col("all") > 0).select("*", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
    target = F.col("q") * F.col("all")
    lo = F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(F.get("bounds", F.col("idx") - 1))
    hi = F.coalesce(F.get("bounds", F.col("idx")), lo * 2)
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - (F.col("upto") - F.col("n"))) / F.col("n")))
    hit = F.when((F.col("upto") >= target) & (F.col("n") > 0), F.col("idx"))
    return cum.groupBy(*by, "q").agg(
        F.coalesce(F.min_by(lo + (hi - lo) * within, hit), F.any_value(F.element_at("bounds", -1))).alias("value"), F.max("all").alias("samples")
    )


def token_model(attrs: Column) -> Column:
    return F.coalesce(attrs["gen_ai.response.model"], attrs["gen_ai.request.model"], F.lit("unknown"))


def tokens_by_model(series: DataFrame) -> DataFrame:
    """Rounded input, output and total per model, with each model's share of all tokens."""
    kind = F.coalesce(F.col("attrs")["gen_ai.token.type"], F.lit(""))
    per_model = (
        matching(series, TOKEN_USAGE).where(kind.isin("input", "output")).groupBy(token_model(F.col("attrs")).alias("model"))
        .agg(F.coalesce(F.sum(F.when(kind == "input", F.col("total"))), F.lit(0.0)).alias("i"),
             F.coalesce(F.sum(F.when(kind == "output", F.col("total"))), F.lit(0.0)).alias("o"))
        .select("model", round_half_up(F.col("i")).alias("input"), round_half_up(F.col("o")).alias("output"),
                round_half_up(F.col("i") + F.col("o")).alias("total"))
    )
    # a row for each model: the grand total is a window over them, not a second pass over the series
    everything = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return per_model.withColumn("share", F.col("total") / F.when(everything == 0, F.lit(1)).otherwise(everything))


def token_totals(series: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("attrs")["gen_ai.token.type"], F.lit(""))
    of = {k: F.coalesce(F.sum(F.when(kind == k, F.col("total"))), F.lit(0.0)) for k in ("input", "output")}
    return matching(series, TOKEN_USAGE).agg(*[round_half_up(v).alias(k) for k, v in of.items()])


def token_series(points: DataFrame, now_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(feed, t_ms, input, output): growth of the rounded totals per export.

    Exports with equal time merge; one older than an earlier bucket is dropped.
    """
    kind = F.coalesce(F.col("attrs")["gen_ai.token.type"], F.lit(""))
    by_type = growth(points.where(F.col("metric") == TOKEN_USAGE), hot_rows).groupBy("feed", "rec").agg(
        *[F.coalesce(F.sum(F.when(kind == k, F.col("growth"))), F.lit(0.0)).alias(f"g_{k}") for k in ("input", "output")],
    )
    exports = points.groupBy("feed", "rec").agg(F.max("at_ms").alias("newest"))
    stepped = exports.join(by_type, ["feed", "rec"], "left").select(
        "feed", "rec", F.when(F.col("newest") > 0, F.col("newest")).otherwise(F.lit(now_ms)).alias("t_ms"),
        F.coalesce("g_input", F.lit(0.0)).alias("g_input"), F.coalesce("g_output", F.lit(0.0)).alias("g_output"),
    )
    running = prefix_scan(stepped, ["feed"], ["rec"], {
        "c_input": Prefix("sum", F.col("g_input")), "c_output": Prefix("sum", F.col("g_output")),
        "newer": Prefix("max", F.col("t_ms"), inclusive=False),
    }, hot_rows)

    def step(kind: str) -> Column:
        after = F.col(f"c_{kind}")
        return F.greatest(F.lit(0), round_half_up(after) - round_half_up(after - F.col(f"g_{kind}"))).alias(kind)

    return (
        running.where(F.col("newer").isNull() | (F.col("t_ms") >= F.col("newer")))
        .select("feed", "t_ms", step("input"), step("output"))
        .groupBy("feed", "t_ms").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    )


def burn_rate(buckets: DataFrame) -> DataFrame:
    """Tokens per hour between a feed's first and last bucket; the first is a baseline, not burn."""
    tokens = F.col("input") + F.col("output")
    hours = (F.max("t_ms") - F.min("t_ms")) / F.lit(3_600_000.0)
    return buckets.groupBy("feed").agg(
        F.when(hours > 0, (F.sum(tokens) - F.min_by(tokens, "t_ms")) / hours).otherwise(F.lit(0.0)).alias("burn_per_hour")
    )


def metric_validity(rows: DataFrame) -> DataFrame:
    """Per metric: points seen, late ones ignored, malformed ones counted (a late malformed point is not)."""
    return rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("late").alias("late"), F.count_if(~F.col("ok") & ~F.col("late")).alias("malformed")
    )


def event_series(signals: DataFrame) -> DataFrame:
    """Event-derived series: (metric, attrs) sums and counts of projected quality events."""
    return (
        signals.select("metric", "value", "attrs", series_key(F.col("attrs")).alias("series_key"))
        .groupBy("metric", "series_key").agg(F.any_value("attrs").alias("attrs"), F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("count"))
    )


def all_series(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Metric series plus event-derived ones of instruments no metric has measured.

    A measured zero counts as measured.
    """
    measured = metrics.where(F.col("count") > 0).select("metric").distinct()
    fallback = event_series(signals).join(measured, "metric", "left_anti")
    columns = ["metric", "series_key", "attrs", "total", "count"]
    return metrics.select(*columns, F.lit("metrics").alias("source")).unionByName(
        fallback.select(*columns, F.lit("events").alias("source"))
    )
