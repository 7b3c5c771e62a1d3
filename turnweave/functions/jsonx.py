"""Rules on free JSON (VARIANT) fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content blocks of a message; free parts stay VARIANT.
BLOCKS = (
    "array<struct<type string, text string, thinking string, id string, name string, input variant, "
    "tool_use_id string, content variant, is_error boolean, source struct<media_type string>>>"
)


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind_of(v: Column) -> Column:
    """'string', 'array', 'object', or 'other' for a VARIANT; NULL for an absent one."""
    schema = F.schema_of_variant(v)
    return (
        F.when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(v.isNotNull(), "other")
    )


def get_str(v: Column, path: str) -> Column:
    """The field when it is a JSON string, else ''."""
    inner = field(v, path)
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string")).otherwise("")


def get_display_str(v: Column, path: str) -> Column:
    """The field as text whatever its type; '' when absent or null."""
    inner = field(v, path)
    schema = F.schema_of_variant(inner)
    text = F.when(schema == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.to_json(inner))
    return F.when(inner.isNull() | (schema == "VOID"), "").otherwise(text)


def get_num(v: Column, path: str) -> Column:
    """The field as a whole number when it is a JSON number, else 0."""
    inner = field(v, path)
    schema = F.schema_of_variant(inner)
    numeric = schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL")
    return F.coalesce(F.when(numeric, F.try_variant_get(v, path, "double").cast("bigint")), F.lit(0))


def has_key(v: Column, path: str) -> Column:
    return F.coalesce(field(v, path).isNotNull(), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def block_array(content: Column) -> Column:
    """Content blocks of an array content; NULL for strings."""
    return F.when(kind_of(content) == "array", F.try_variant_get(content, "$", BLOCKS))


def content_string(content: Column) -> Column:
    """The content when it is a plain string; NULL otherwise."""
    return F.when(kind_of(content) == "string", F.try_variant_get(content, "$", "string"))


def is_attachment_type(t: Column) -> Column:
    return t.isin("image", "document") | t.contains("attachment") | t.contains("diagnostic")


def extract_text(text: Column, blocks: Column) -> Column:
    """Readable text of a content given as (string, block array)."""
    pieces = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "text", F.nullif(b["text"], F.lit("")))
        .when(b["type"] == "image", "[Image attached]")
        .when(
            b["type"] == "document",
            F.concat(
                F.lit("[Document attached: "),
                F.coalesce(b["source"]["media_type"], F.lit("document")),
                F.lit("]"),
            ),
        ),
    )
    shown = F.array_compact(pieces)
    other = F.get(F.filter(blocks, lambda b: F.coalesce(is_attachment_type(b["type"]), F.lit(False))), 0)["type"]
    fallback = F.when(other.isNotNull(), F.concat(F.lit("[Attachment: "), other, F.lit("]")))
    joined = F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise(fallback)
    return F.coalesce(text, joined, F.lit(""))


def stringify_content(v: Column) -> Column:
    """Text of a tool result: string, joined text blocks, else the raw JSON; '' when absent."""
    texts = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda b: F.nullif(get_str(b, "$.text"), F.lit("")),
    )
    joined = F.nullif(F.array_join(F.array_compact(texts), "\n"), F.lit(""))
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(plain, joined, F.to_json(v), F.lit(""))


def normalize_tool_input(v: Column) -> Column:
    """Parse top-level string values that hold a JSON array or object."""
    fields = F.try_variant_get(v, "$", "map<string, variant>")

    def parsed(_, x):
        text = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        inner = F.when(text.rlike(r"(?U)\A\s*[\[{]"), F.try_parse_json(text))
        return F.coalesce(F.when(kind_of(inner).isin("array", "object"), inner), x)

    fixed = F.try_parse_json(F.to_json(F.transform_values(fields, parsed)))
    suspect = is_object(v) & F.to_json(v).rlike(r':"(\\[nrt]|\s)*[\[{]')
    return F.when(suspect, fixed).otherwise(v)


def first_string_value(v: Column) -> Column:
    """First non-empty string value of an object by key order; NULL when there is none."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
    strings = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("k"),
            F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("s"),
        ),
    )
    kept = F.filter(strings, lambda e: F.coalesce(e["s"] != "", F.lit(False)))
    return F.get(F.array_sort(kept), 0)["s"]
