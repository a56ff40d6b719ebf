"""Delivery cycles: one per repository branch, with steps, adherence, matches and delivery figures.

Calls: source, repository, branch, user, session, model, nano, at_ms. Credits
stay per source and are never summed across sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import branch_item, commit_sha, item_reference, ref_number
from ..functions.values import credit_sum
from .coverage import iso_instant
from .quantile import exact_quantiles

STEPS = ["workItem", "branch", "aiWork", "commits", "pullRequest", "review", "close"]
SHOWN = 200
HOUR_MS = 3_600_000


def cycle_key(repository: Column, branch: Column) -> Column:
    return F.concat(repository, F.lit("#"), F.coalesce(branch, F.lit("")))


def keyed_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumn("cycle_key", cycle_key(F.col("repository"), F.col("branch")))


def cycle_sources(calls: DataFrame) -> DataFrame:
    """(cycle_key, repository, branch, source, calls, credit_calls, credits, first_ms, last_ms)."""
    return keyed_calls(calls).where(F.col("repository").isNotNull()).groupBy("cycle_key", "repository", "branch", "source").agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"), credit_sum(F.col("nano")).alias("credits"),
        F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


def delivery_cycles(calls: DataFrame) -> DataFrame:
    """One row per cycle with its window and the work item its branch names."""
    item = F.col("item")
    return (
        cycle_sources(calls).groupBy("cycle_key", "repository", "branch")
        .agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("calls").alias("calls"))
        .withColumn("item", branch_item(F.col("branch")))
        .select("cycle_key", "repository", "branch", "first_ms", "last_ms", "calls", item["provider"].alias("provider"), item["id"].alias("item_id"),
                F.when(item.isNotNull(), item_reference(item["provider"], item["id"])).alias("reference"))
    )


def shown_cycles(cycles: DataFrame, n: int = SHOWN) -> DataFrame:
    """The report lists the latest `n` cycles; balances elsewhere keep the rest."""
    return cycles.orderBy(F.desc("last_ms"), "cycle_key").limit(n)


def truncated_cycles(cycles: DataFrame, n: int = SHOWN) -> DataFrame:
    return cycles.agg(F.count(F.lit(1)).alias("cycles"), F.greatest(F.lit(0).cast("bigint"), F.count(F.lit(1)) - n).alias("truncated"))


def unlinked_calls(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("repository").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("calls"), credit_sum(F.col("nano")).alias("credits"))


def cycle_refs(refs: DataFrame) -> DataFrame:
    """refs: repository, branch, ref_type, ref_value, at_ms. Adds the number or commit it names, NULL if it is dropped."""
    kind = F.col("ref_type")
    number = F.when(kind.isin("pr", "issue"), ref_number(F.col("ref_value"), F.col("repository")))
    sha = F.when(kind == "commit", commit_sha(F.col("ref_value")))
    return refs.select("*", cycle_key(F.col("repository"), F.col("branch")).alias("cycle_key"), F.coalesce(number.cast("string"), sha).alias("named"))


def recorded_refs(refs: DataFrame) -> DataFrame:
    """Distinct references per cycle: (cycle_key, kind, named, first_ms)."""
    return cycle_refs(refs).where(F.col("named").isNotNull() & F.col("cycle_key").isNotNull()).groupBy(
        "cycle_key", F.col("ref_type").alias("kind"), "named").agg(F.min("at_ms").alias("first_ms"))


def dropped_refs(refs: DataFrame) -> DataFrame:
    return cycle_refs(refs).agg(F.count_if(F.col("named").isNull()).alias("dropped_refs"))


def pr_match(cycles: DataFrame, prs: DataFrame) -> DataFrame:
    """Pull request of each cycle: same head branch, not over before the cycle began; the newest wins.

    prs: repository, number, head, created_ms, merged_ms, closed_ms, author, author_kind, reviews,
    commits. `candidates` counts every pull request of the branch.
    """
    p = prs.select(F.lower("repository").alias("p_repo"), F.col("head").alias("p_head"), "number", "created_ms", "merged_ms", "closed_ms",
                   "author", "author_kind", "reviews", "commits")
    # An inner join may split a hot branch on either side; cycles without a match rejoin afterwards.
    joined = cycles.select("cycle_key", "first_ms", F.lower("repository").alias("c_repo"), "branch").join(
        p, (F.col("c_repo") == F.col("p_repo")) & (F.col("branch") == F.col("p_head")))
    alive = F.col("closed_ms").isNull() | (F.col("closed_ms") >= F.col("first_ms"))
    fields = ["number", "created_ms", "merged_ms", "closed_ms", "author", "author_kind", "reviews", "commits"]
    best = F.max_by(F.struct(*fields), F.when(alive, F.struct("created_ms", "number")))
    found = joined.groupBy("cycle_key").agg(F.count(F.lit(1)).alias("n"), best.alias("m"))
    return cycles.select("cycle_key").join(found, "cycle_key", "left").select("cycle_key", F.coalesce("n", F.lit(0)).alias("candidates"), "m.*")


def work_item_match(cycles: DataFrame, items: DataFrame) -> DataFrame:
    """Verified work item per cycle. items: provider, repository (NULL for boards), id, type, category, closed_ms."""
    i = items.select(F.col("provider").alias("i_provider"), F.lower("repository").alias("i_repo"), F.col("id").alias("i_id"), "type", "category",
                     F.col("closed_ms").alias("item_closed_ms"))
    same = (F.col("provider") == F.col("i_provider")) & (F.col("item_id") == F.col("i_id")) & (
        (F.col("provider") == "azure-boards") | (F.lower("repository") == F.col("i_repo")))
    named = cycles.where(F.col("item_id").isNotNull())
    found = named.join(i, same).groupBy("cycle_key").agg(
        F.max("i_id").alias("found_id"), F.max("type").alias("type"),
        F.bool_or((F.col("category") == "Completed") | F.col("item_closed_ms").isNotNull()).alias("item_closed"))
    return named.select("cycle_key").join(found, "cycle_key", "left").select("cycle_key", F.col("found_id").alias("item_id"), "type", "item_closed")


def cycle_steps(cycles: DataFrame, refs: DataFrame, matches: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(cycle_key, step, place, state, evidence) and, per cycle, how far it reached.

    refs: `recorded_refs`. Without matches nothing is verified and what is not
    recorded stays unknown. `reached` is the last step known to be done.
    """
    held = refs.groupBy("cycle_key").agg(*[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in ("issue", "commit", "pr")])
    wide = cycles.select("cycle_key", "branch", "item_id", "first_ms").join(held, "cycle_key", "left")
    checked = matches is not None
    if checked:
        wide = wide.join(matches.withColumnRenamed("number", "pr_number"), "cycle_key", "left")
    else:
        wide = wide.selectExpr("*", *[f"CAST(NULL AS BIGINT) AS {c}" for c in ("pr_number", "merged_ms", "reviews", "commits")])
    if items is not None:
        wide = wide.join(items.select("cycle_key", F.col("item_id").alias("found_item"), "item_closed"), "cycle_key", "left")
    else:
        wide = wide.selectExpr("*", "CAST(NULL AS BIGINT) AS found_item", "CAST(NULL AS BOOLEAN) AS item_closed")
    has_pr = F.col("pr_number").isNotNull()
    sure, unsure = ("no", "no") if checked else ("unknown", "unknown")

    def step(name: str, *options: tuple[Column, str], otherwise: str) -> Column:
        evidence = F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(e)) for cond, e in options])
        return F.struct(F.lit(name).alias("step"), F.lit(STEPS.index(name) + 1).alias("place"),
                        F.when(evidence.isNotNull(), "yes").otherwise(otherwise).alias("state"), evidence.alias("evidence"))

    closed = F.col("merged_ms").isNotNull() & F.coalesce("item_closed", F.lit(True))
    recorded_pr = [] if checked else [(F.col("has_pr"), "recorded")]
    steps = [
        step("workItem", (F.col("found_item").isNotNull(), "verified"), (F.col("has_issue"), "recorded"), (F.col("item_id").isNotNull(), "convention"), otherwise="no"),
        step("branch", (F.col("branch").isNotNull(), "observed"), otherwise="no"),
        step("aiWork", (F.lit(True), "observed"), otherwise="no"),
        step("commits", (has_pr & (F.col("commits") > 0), "verified"), (F.col("has_commit"), "recorded"), otherwise="unknown"),
        step("pullRequest", (has_pr, "verified"), *recorded_pr, otherwise=sure),
        step("review", (has_pr & (F.col("reviews") > 0), "verified"), otherwise=unsure),
        step("close", (closed, "verified"), otherwise=unsure),
    ]
    reached = F.aggregate(F.array(*steps), F.lit(0), lambda n, s: F.when(s["state"] == "yes", s["place"]).otherwise(n))
    return wide.select("cycle_key", reached.alias("reached"), F.explode(F.array(*steps)).alias("s")).select("cycle_key", "reached", "s.*")


def step_stations(steps: DataFrame) -> DataFrame:
    """Per step: cycles that did it, cycles that did it and every step before, and unknowns."""
    done = F.col("state") == "yes"
    first_gap = F.min(F.when(~done, F.col("place")))
    gaps = steps.groupBy("cycle_key").agg(F.coalesce(first_gap, F.lit(len(STEPS) + 1)).alias("gap"))
    return steps.join(gaps, "cycle_key").groupBy("step").agg(
        F.count_if(done).alias("any"), F.count_if(F.col("place") < F.col("gap")).alias("strict"), F.count_if(F.col("state") == "unknown").alias("unknown"))


def convention_adherence(cycles: DataFrame) -> DataFrame:
    """Cycles by what their branch names."""
    return cycles.agg(
        F.count(F.lit(1)).alias("cycles"), F.count_if(F.col("provider") == "azure-boards").alias("azure_boards"),
        F.count_if(F.col("provider") == "github").alias("github"),
        F.count_if(F.col("branch").isNotNull() & F.col("provider").isNull()).alias("non_conforming"), F.count_if(F.col("branch").isNull()).alias("no_branch"))


def adherence_credits(sources: DataFrame) -> DataFrame:
    """(side, source, credits, cycles) on both sides of the convention. sources: `cycle_sources`."""
    side = F.when(branch_item(F.col("branch")).isNotNull(), "conforming").otherwise("nonConforming")
    return sources.groupBy(side.alias("side"), "source").agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("cycles"))


def delivery_kpis(cycles: DataFrame, matches: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: merged, closed, median hours from open to merge and from first activity to merge."""
    merged = matches.where(F.col("merged_ms").isNotNull()).join(cycles.select("cycle_key", "first_ms"), "cycle_key")
    hours = merged.select(F.explode(F.array(
        F.struct(F.lit("open").alias("name"), ((F.col("merged_ms") - F.col("created_ms")) / HOUR_MS).alias("h")),
        F.struct(F.lit("lead").alias("name"), ((F.col("merged_ms") - F.col("first_ms")) / HOUR_MS).alias("h")))).alias("x")).select("x.*")
    medians = exact_quantiles(hours, ["name"], "h", [0.5])
    return merged.agg(F.count(F.lit(1)).alias("merged")).unionByName(
        steps.where("step = 'close' AND state = 'yes'").agg(F.count(F.lit(1)).alias("closed")), allowMissingColumns=True).unionByName(
        medians.agg(F.max(F.when(F.col("name") == "open", F.col("value"))).alias("median_open_to_merge_hours"),
                    F.max(F.when(F.col("name") == "lead", F.col("value"))).alias("median_lead_hours")), allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("merged", "closed", "median_open_to_merge_hours", "median_lead_hours")])


def credits_per_merged_pr(sources: DataFrame, matches: DataFrame) -> DataFrame:
    merged = matches.where(F.col("merged_ms").isNotNull()).select("cycle_key")
    return sources.join(merged, "cycle_key", "left_semi").groupBy("source").agg(
        F.count(F.lit(1)).alias("merged"), F.sum("credits").alias("credits"), F.try_divide(F.sum("credits"), F.count(F.lit(1))).alias("credits_per_pr"))


def cycle_story_check(steps: DataFrame, billing: DataFrame) -> DataFrame:
    """Violations (cycle_key, rule) of an ordered story with a bounded estimate.

    steps: cycle_key, place, state, at_ms. billing: cycle_key, day, retrieved_ms,
    gross_quantity, billed_quantity, net_amount, charge.
    """
    before = steps.select("cycle_key", (F.col("place") + 1).alias("place"), F.col("at_ms").alias("before_ms"))
    walked = steps.join(before, ["cycle_key", "place"], "left")
    ordered = walked.select("cycle_key", F.when(F.col("state") != "yes", F.lit("step not done")).when(
        F.col("before_ms") > F.col("at_ms"), F.lit("step precedes the one before")).alias("rule"))
    share = F.col("charge") * F.col("gross_quantity") / F.col("billed_quantity")
    bounded = (F.col("billed_quantity") > 0) & (F.col("gross_quantity") <= F.col("billed_quantity")) & (F.abs(F.col("net_amount") - share) < 1e-9)
    rules = F.when(F.col("day") >= F.substring(iso_instant(F.col("retrieved_ms")), 1, 10), F.lit("day not completed")).when(
        ~F.coalesce(bounded, F.lit(False)), F.lit("estimate is not the calculated share"))
    return ordered.unionByName(billing.select("cycle_key", rules.alias("rule"))).where(F.col("rule").isNotNull()).distinct()
