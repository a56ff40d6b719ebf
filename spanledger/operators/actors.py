"""People: historical assignment, identity links, ownership and per-source balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import identity_name
from ..functions.values import credit_sum


def github_actor(login: Column) -> Column:
    """`github:login` in lower case; no usable name, no actor."""
    return F.concat(F.lit("github:"), F.lower(identity_name(login)))


def assignment_asof(history: DataFrame, activity: DataFrame) -> DataFrame:
    """(item, assignee): who was assigned when work began, rebuilt from the event history.

    history: item, seq, kind Assigned/Unassigned, assignee, at_ms. activity:
    item, first_ms, complete. A partial history establishes nobody, and the
    current assignee is never backdated.
    """
    known = activity.where(F.col("complete")).select("item", "first_ms")
    past = history.join(known, "item").where(F.col("at_ms") <= F.col("first_ms"))
    last = past.groupBy("item", github_actor(F.col("assignee")).alias("assignee")).agg(F.max_by("kind", F.struct("at_ms", "seq")).alias("kind"))
    return last.where((F.col("kind") == "Assigned") & F.col("assignee").isNotNull()).select("item", "assignee")


def identity_link_errors(links: DataFrame) -> DataFrame:
    """(boards_key, problem) of unusable links: a malformed key, or a key linked twice."""
    shaped = F.col("boards_key").rlike(r"^boards:\S+/[0-9a-f-]{36}$")
    return links.groupBy("boards_key").agg(F.count(F.lit(1)).alias("n")).select(
        "boards_key", F.when(~shaped, F.lit("malformed")).when(F.col("n") > 1, F.lit("not unique")).alias("problem")
    ).where(F.col("problem").isNotNull())


def identity_link(actors: DataFrame, links: DataFrame) -> DataFrame:
    """actors with `actor` replaced by the explicitly linked GitHub actor; unusable links apply to nobody."""
    usable = links.join(identity_link_errors(links), "boards_key", "left_anti").select(
        F.col("boards_key").alias("l_key"), github_actor(F.col("github_login")).alias("l_actor"))
    return actors.join(usable, F.col("actor") == F.col("l_key"), "left").withColumn("actor", F.coalesce("l_actor", "actor")).drop("l_key", "l_actor")


def cycle_owners(candidates: DataFrame) -> DataFrame:
    """(cycle_key, owner, inference) from candidate owners (cycle_key, actor, role, is_bot).

    Only assignment at the start and authorship count. Two people conflict and
    nobody is inferred; bots are not assumed to be consumers.
    """
    people = candidates.where(F.col("role").isin("assignee at start", "author") & ~F.col("is_bot") & F.col("actor").isNotNull())
    return people.groupBy("cycle_key").agg(F.min("actor").alias("a"), F.max("actor").alias("b")).select(
        "cycle_key", F.when(F.col("a") == F.col("b"), F.col("a")).alias("owner"),
        F.when(F.col("a") == F.col("b"), "Single owner").otherwise("Conflicting owners").alias("inference"))


def attributed_usage(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """Calls with method measured / inferred / unattributed and the actor. The native consumer beats the owner.

    calls: `cycles.keyed_calls`. Usage is first summed per (source, cycle, user),
    so the owner join sees no raw call.
    """
    summed = calls.groupBy("source", "cycle_key", github_actor(F.col("user")).alias("native")).agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"), F.sum(F.col("nano").cast("decimal(20,0)")).alias("nano"))
    joined = summed.join(owners.select("cycle_key", "owner"), "cycle_key", "left")
    return joined.select(
        "source", "cycle_key", "owner", F.coalesce("native", "owner").alias("actor"),
        F.when(F.col("native").isNotNull(), "measured").when(F.col("owner").isNotNull(), "inferred").otherwise("unattributed").alias("method"),
        "calls", "credit_calls", "nano")


def _sums() -> list[Column]:
    return [F.sum("calls").alias("calls"), F.sum("credit_calls").alias("credit_calls"), credit_sum_of("nano").alias("credits")]


def credit_sum_of(column: str) -> Column:
    return F.sum(column).cast("double") / F.lit(1e9)


def developer_balance(usage: DataFrame) -> DataFrame:
    """(source, method, calls, credit_calls, credits): measured + inferred + unattributed conserve the total."""
    return usage.groupBy("source", "method").agg(*_sums())


def actor_usage(usage: DataFrame) -> DataFrame:
    """(source, actor, method, ...): personal use, measured and inferred apart; unreported credits stay NULL."""
    return usage.where(F.col("actor").isNotNull()).groupBy("source", "actor", "method").agg(*_sums())


def owned_work(usage: DataFrame) -> DataFrame:
    """(source, owner, ...): everything spent on a person's cycles, whoever spent it. Not personal use."""
    return usage.where(F.col("owner").isNotNull()).groupBy("source", "owner").agg(*_sums())


def work_balance(usage: DataFrame, shown: DataFrame) -> DataFrame:
    """(source, cycle_key, ...) of listed cycles; usage without work or beyond the list is kept under NULL."""
    listed = shown.select("cycle_key", F.lit(True).alias("listed"))
    key = F.when(F.col("listed"), F.col("cycle_key"))
    return usage.join(listed, "cycle_key", "left").groupBy("source", key.alias("cycle_key")).agg(*_sums())


def usage_by_day(calls: DataFrame) -> DataFrame:
    """Billing grain: (source, actor, day, model, cycle_key, calls, credit_calls, credits)."""
    return calls.groupBy("source", github_actor(F.col("user")).alias("actor"), "day", F.lower("model").alias("model"), "cycle_key").agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"), credit_sum(F.col("nano")).alias("credits"))
