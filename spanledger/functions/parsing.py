"""Branch conventions, recorded references, timestamps and effort words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import let, utc_day

MAX_OPTIONS_CHARS = 64 * 1024
BOARDS_ITEM = r"(?i)^ab#?([1-9][0-9]{0,17})(?:[^a-z0-9].*)?$"
ISSUE_ITEM = r"(?i)^#?([1-9][0-9]{0,17})(?:[^a-z0-9].*)?$"
CLOCK = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
ZONE = r"\s*(?:[Zz]|[+-]\d{2}:?\d{2})$"


def _number(value: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).try_cast("bigint")


def branch_item(branch: Column) -> Column:
    """Work item named by a branch's last segment: STRUCT<provider, id>, or NULL."""
    def item(leaf: Column) -> Column:
        boards, issue = _number(leaf, BOARDS_ITEM), _number(leaf, ISSUE_ITEM)
        return (
            F.when(boards.isNotNull(), F.struct(F.lit("azure-boards").alias("provider"), boards.alias("id")))
            .when(issue.isNotNull(), F.struct(F.lit("github").alias("provider"), issue.alias("id")))
        )

    return let(F.when(~branch.rlike(r"\s"), F.element_at(F.split(branch, "/"), -1)), item)


def item_reference(provider: Column, item_id: Column) -> Column:
    return F.concat(F.when(provider == "azure-boards", F.lit("AB#")).otherwise(F.lit("#")), item_id.cast("string"))


def ref_number(value: Column, repository: Column) -> Column:
    """Issue or PR number, only when the reference is bare or names the same repository."""
    bare = _number(value, r"^#?([1-9][0-9]{0,17})$")
    slug = r"^([^/\s#]+/[^/\s#]+)#([1-9][0-9]{0,17})$"
    link = r"(?i)^https://github\.com/([^/\s]+/[^/\s]+)/(?:pull|issues)/([1-9][0-9]{0,17})$"

    def same(pattern: str) -> Column:
        owner = F.regexp_extract(value, pattern, 1)
        number = F.nullif(F.regexp_extract(value, pattern, 2), F.lit("")).try_cast("bigint")
        return F.when(F.lower(owner) == F.lower(repository), number)

    return F.coalesce(bare, same(slug), same(link))


def commit_sha(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9A-Fa-f]{7,64}$"), F.lower(value))


def is_github_repository(repository: Column) -> Column:
    return repository.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def timestamp_ms(value: Column) -> Column:
    """Instant of an ISO text; no offset means UTC. Date-only and unreadable text give NULL."""
    zoned = F.when(value.rlike(CLOCK + ZONE), F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    utc = F.when(value.rlike(CLOCK + "$"), F.concat(value, F.lit("Z")))
    full = F.regexp_replace(F.coalesce(zoned, utc), r"^(.{10}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    return F.unix_millis(full.try_cast("timestamp"))


def date_only(value: Column) -> Column:
    """The day of a date-only text, else NULL."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date")).cast("string")


def usage_day(instant_ms: Column, day: Column) -> Column:
    """UTC day of a parsed instant, else the day of a date-only text."""
    return F.coalesce(utc_day(instant_ms), day)


def in_rolling_window(instant_ms: Column, day: Column, cutoff_ms: int) -> Column:
    """Exact cutoff for instants; a date-only row counts only on a later day than the cutoff's."""
    cutoff_day = utc_day(F.lit(cutoff_ms).cast("bigint"))
    return F.coalesce(instant_ms >= F.lit(cutoff_ms), day > cutoff_day, F.lit(False))


def effort_word(value: Column) -> Column:
    return F.when(value.rlike(r"(?i)^[a-z][a-z_-]{0,23}$"), F.lower(value))


def reasoning_effort(options: Column, level: Column) -> Column:
    """Effort word from an options blob, else from the level attribute. Oversized blobs are not parsed."""
    def word(parsed: Column, path: str) -> Column:
        quoted = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
        return F.when(quoted, effort_word(F.try_variant_get(parsed, path, "string")))

    blob = F.when(F.length(options) <= MAX_OPTIONS_CHARS, F.try_parse_json(options))
    return let(blob, lambda v: F.coalesce(word(v, "$.reasoning.effort"), word(v, "$.reasoning_effort"), effort_word(level)))
