"""Repair of judge output: lenient JSON, defaults, clamping, dimensions, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient_json(text: Column, flat_first: bool = True) -> Column:
    """The judgement in a reply, as a VARIANT, or null: code fences are stripped, then the whole text is tried, then the
    first flat {...}, then the widest {...}. With flat_first=False the widest comes first, which keeps nested objects."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*", ""), r"(?s)\s*```\s*$", "")
    flat = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{[^{}]*\})", 1))
    wide = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    return F.coalesce(F.try_parse_json(bare), *((flat, wide) if flat_first else (wide, flat)))


def whole_number(value: Column) -> Column:
    """Numbers and digit strings, cut toward zero; null for anything else."""
    d = value.try_cast("double")
    return F.when((F.abs(d) < 2e9), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).try_cast("int")


def clamped(value: Column, low: int = 1, high: int = 5) -> Column:
    n = whole_number(value)
    return F.when(n.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n)))


def known_category(category: Column, valid: list[str], default: str) -> Column:
    """The category where it is one of ``valid`` or the default, else the default."""
    return F.when(category.isin(*valid, default), category).otherwise(F.lit(default))


def clean_name(name: Column) -> Column:
    """A category name that may name a folder: without / \\ : * ? " < > |, trimmed."""
    return F.trim(F.regexp_replace(name, r'[/\\:*?"<>|]', ""))


def dimension_name(priority: Column) -> Column:
    """A column-like name: lower case, possessive 's and brackets dropped, other runs one _, at most 40 characters cut
    at the last _; null where nothing is left."""
    n = F.regexp_replace(F.lower(priority), r"'s\b", "")
    n = F.regexp_replace(F.regexp_replace(n, r"[()]", ""), r"[^a-z0-9]+", "_")
    n = F.regexp_replace(n, r"^_+|_+$", "")
    cut = F.regexp_replace(F.substring(n, 1, 40), r"_[^_]*$", "")
    return F.nullif(F.when(F.length(n) > 40, cut).otherwise(n), F.lit(""))


def dimensions(values: Column, expected: list[str]) -> Column:
    """A map of exactly the expected names to scores: numbers are cut and clamped to 1..5, booleans count as 0 and 1,
    anything else (strings of digits too) is null. ``values`` is a VARIANT, as ``lenient_json`` reads it; one that is null
    or no object has none of the names. With nothing expected ``values`` passes."""
    if not expected:
        return values

    def score(name: str) -> Column:
        path = "$['" + name + "']"
        kind = F.schema_of_variant(F.try_variant_get(values, path, "variant"))
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(values, path, "double"))
        return clamped(F.coalesce(number, F.when(kind == "BOOLEAN", F.try_variant_get(values, path, "boolean").cast("double"))))

    names = [n for n in dict.fromkeys(expected)]
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(score, names)))


def judgement(
    df: DataFrame, category: str, score: str, valid: list[str], default: str, missing_score: int = 2, rank: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """``df`` with the category known, the score within 1..5 (missing: ``missing_score``), and, for bursts, a missing
    rank set to position + 1. A score that is present but no number makes the row an error fallback, with the default
    category, the missing score and error_type invalid_response."""
    bad = F.col(score).isNotNull() & whole_number(F.col(score)).isNull()
    out = df.withColumn("__bad", bad).withColumn(
        category, F.when(F.col("__bad"), F.lit(default)).otherwise(known_category(F.col(category), valid, default))
    )
    out = out.withColumn(score, F.when(F.col("__bad"), F.lit(missing_score)).otherwise(F.coalesce(clamped(F.col(score)), F.lit(missing_score))))
    if rank and position:
        out = out.withColumn(rank, F.coalesce(F.col(rank), F.col(position) + 1))
    flags = {"is_error_fallback": F.coalesce("is_error_fallback", F.lit(False)) if "is_error_fallback" in df.columns else F.lit(False)}
    out = out.withColumn("is_error_fallback", flags["is_error_fallback"] | F.col("__bad"))
    kind = F.col("error_type") if "error_type" in df.columns else F.lit(None).cast("string")
    return out.withColumn("error_type", F.when(F.col("__bad"), "invalid_response").otherwise(kind)).drop("__bad")


_REPLY = "classification string, score string, rank string, reasoning string, contains_children boolean, is_appropriate boolean, content_summary string, audio_quality string"


def reply_object(text: Column) -> Column:
    """The judgement of a reply for one item as a struct of strings and flags; null where ``lenient_json`` finds none."""
    j = lenient_json(text)
    field = lambda name, kind: F.try_variant_get(j, f"$.{name}", kind).alias(name)
    fields = [field(*part.split()) for part in _REPLY.split(", ")]
    return F.when(j.isNotNull(), F.struct(*fields))


def reply_list(text: Column) -> Column:
    """The judgements of a reply for a group, in order: the whole text, else what is between its first [ and last ]; null
    where neither is a list of objects. Code fences are stripped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*", ""), r"(?s)\s*```\s*$", "")
    widest = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    shape = f"array<struct<{_REPLY.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    read = lambda t: F.when(t.startswith("[") & F.try_parse_json(t).isNotNull(), F.from_json(t, shape))
    return F.coalesce(read(bare), read(widest))


def response_shape(replies: Column, group_size: Column) -> Column:
    """Whether a group's reply holds one judgement per member."""
    return F.coalesce(F.size(replies) == group_size, F.lit(False))


def response_error(blocked: Column, finish_reason: Column, text: Column) -> Column:
    """safety_blocked for a blocked reply or finish reason 3, invalid_response for an empty one, null for a good one."""
    return F.when(F.coalesce(blocked, F.lit(False)) | F.coalesce(finish_reason == 3, F.lit(False)), "safety_blocked").when(
        F.coalesce(F.trim(text), F.lit("")) == "", "invalid_response"
    )


#: What a missing extra field becomes, by kind of item.
EXTRAS = {
    "video": {"audio_quality": "unknown"}, "audio": {"audio_quality": "unknown", "content_summary": ""}, "document": {"content_summary": ""},
}


def with_extras(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the extra fields of its kind, missing ones filled; documents also have key_topics."""
    for name, value in EXTRAS.get(kind, {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    if kind == "document":
        none = F.expr("cast(array() as array<string>)")
        df = df.withColumn("key_topics", F.coalesce(F.col("key_topics"), none) if "key_topics" in df.columns else none)
    return df


def fallback(df: DataFrame, default: str, kind: Column, message: Column, score: int = 2, expected: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of an error fallback: default category, middling score, no flags, no dimensions."""
    none = F.lit(None).cast("boolean")
    names = F.array(*map(F.lit, expected)) if expected else F.expr("cast(array() as array<string>)")
    empty = F.map_from_arrays(names, F.transform(names, lambda _: F.lit(None).cast("int")))
    return df.withColumns({
        "classification": F.lit(default), "score": F.lit(score), "reasoning": F.concat(F.lit("Fallback response: "), F.coalesce(message, F.lit("no detail"))),
        "contains_children": none, "is_appropriate": none, "dimensions": empty, "is_error_fallback": F.lit(True),
        "error_type": F.coalesce(kind, F.lit("api_error")), "error_message": message,
    })
