"""Typed reads from VARIANT: a number must be a JSON number, text a JSON string."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import hr_to_ms, let

# Attributes that carry captured content, and the longest text worth keeping.
CONTENT_ATTRIBUTES = [
    "gen_ai.input.messages", "gen_ai.output.messages", "gen_ai.system_instructions", "gen_ai.tool.definitions",
    "gen_ai.tool.call.arguments", "gen_ai.tool.call.result", "gen_ai.skill.description", "gen_ai.skill.source.uri",
    "process.executable.path", "copilot_chat.user_request", "copilot_chat.prompt_context",
    "copilot_chat.prompt_instructions", "copilot_chat.reasoning_content", "copilot_chat.markdown_content",
]
MAX_ATTRIBUTE_CHARS = 512
NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def key_path(*names: str) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def item(v: Column, *names: str) -> Column:
    return F.try_variant_get(v, key_path(*names), "variant")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_of(found: Column) -> Column:
    """The text of a JSON string of any length."""
    return F.when(kind_of(found) == "STRING", F.try_variant_get(found, "$", "string"))


def fields(v: Column, *names: str, **inner: list[str]) -> Column:
    """The members of an object in one pass: a STRUCT of variants, of structs for the objects in `inner`; NULL for what is no object."""
    def listed(of: list[str]) -> str:
        return ", ".join(f"`{n}`: variant" for n in of)

    nested = "".join(f", `{n}`: struct<{listed(of)}>" for n, of in inner.items())
    return F.try_variant_get(v, "$", f"struct<{listed(names)}{nested}>")


# Readers of a member that is a column of its own; the readers below find it first.

def text_of(found: Column) -> Column:
    """A JSON string no longer than retained text may be."""
    word = F.try_variant_get(found, "$", "string")
    return F.when((kind_of(found) == "STRING") & (F.length(word) <= MAX_ATTRIBUTE_CHARS), word)


def number_of(found: Column) -> Column:
    return F.when(kind_of(found).rlike(NUMBER_KINDS), F.try_variant_get(found, "$", "double"))


def is_absent(found: Column) -> Column:
    return found.isNull() | F.is_variant_null(found)


def is_present(found: Column) -> Column:
    return found.isNotNull() & ~F.coalesce(F.length(string_of(found)) > MAX_ATTRIBUTE_CHARS, F.lit(False))


def is_truthy(found: Column) -> Column:
    plain, as_text = kind_of(found), F.try_variant_get(found, "$", "string")
    falsy = (plain == "VOID") | ((plain == "STRING") & (as_text == "")) | ((plain == "BOOLEAN") & (as_text == "false")) | (number_of(found) == 0)
    return is_present(found) & ~F.coalesce(falsy, F.lit(False))


def clock_of(found: Column) -> Column:
    return F.coalesce(hr_to_ms(F.try_variant_get(found, "$", "array<double>")), F.lit(0.0))


def text(v: Column, *names: str) -> Column:
    """A JSON string no longer than retained text may be."""
    return let(item(v, *names), text_of)


def absent(v: Column, *names: str) -> Column:
    """Missing or null."""
    return let(item(v, *names), is_absent)


def is_array(v: Column, *names: str) -> Column:
    """Cheaper than describing the whole array."""
    return F.try_variant_get(v, key_path(*names), "array<variant>").isNotNull()


def is_object(v: Column, *names: str) -> Column:
    return F.try_variant_get(v, key_path(*names), "map<string,variant>").isNotNull()


def number(v: Column, *names: str) -> Column:
    return let(item(v, *names), number_of)


def present(v: Column, *names: str) -> Column:
    """The key survives redaction: it exists (even as null) and is no over-long string."""
    return let(item(v, *names), is_present)


def flag(v: Column, *names: str) -> Column:
    """true / false given as boolean or as the words, else NULL."""
    def read(found: Column) -> Column:
        word = F.when(kind_of(found).isin("BOOLEAN", "STRING"), F.try_variant_get(found, "$", "string"))
        return let(word, lambda w: F.when(w == "true", F.lit(True)).when(w == "false", F.lit(False)))

    return let(item(v, *names), read)


def truthy(v: Column, *names: str) -> Column:
    return let(item(v, *names), is_truthy)


def clock(v: Column, *names: str) -> Column:
    return F.coalesce(hr_to_ms(F.try_variant_get(v, key_path(*names), "array<double>")), F.lit(0.0))


def redacted_attributes(attributes: Column) -> Column:
    """MAP<STRING, STRING> of an attribute object without content keys and long strings."""
    as_map = F.try_variant_get(attributes, "$", "map<string,string>")
    return F.map_filter(as_map, lambda k, v: ~k.isin(*CONTENT_ATTRIBUTES) & F.coalesce(F.length(v) <= MAX_ATTRIBUTE_CHARS, F.lit(True)))


def resource_attribute(record: Column, name: str) -> Column:
    """A resource attribute as text; later pairs win, an object form is accepted too."""
    return attribute_of(item(record, "resource"), name)


def attribute_of(resource: Column, name: str) -> Column:
    pairs = F.try_variant_get(resource, "$._rawAttributes", "array<array<variant>>")
    named = F.filter(pairs, lambda p: (F.size(p) >= 2) & (F.get(p, F.lit(0)).cast("string") == name))
    # an absent match stays NULL: get() past the end is NULL
    last = F.get(F.reverse(named), F.lit(0))
    from_object = F.try_variant_get(resource, key_path("attributes", name), "string")
    return F.when(pairs.isNotNull(), F.get(last, F.lit(1)).cast("string")).otherwise(from_object)
