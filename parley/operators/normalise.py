"""Responses of a service as JSON of any shape, to typed columns: wrong types get a default, null stays null where that means something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRINGS = "array<string>"
NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def at(value: Column, path: str) -> Column:
    """What stands at a path, of any type; null if there is nothing."""
    return F.try_variant_get(value, path, "variant")


def type_of(value: Column) -> Column:
    """The name of a value's type; null for nothing."""
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def as_string(value: Column, path: str) -> Column:
    """A string, null for any other type (a cast would give lists as their JSON)."""
    v = at(value, path)
    return F.when(type_of(v) == "STRING", F.try_variant_get(value, path, "string"))


def as_number(value: Column, path: str) -> Column:
    """A number in double precision, null for any other type."""
    return F.when(F.regexp_like(type_of(at(value, path)), F.lit(NUMBERS)), F.try_variant_get(value, path, "double"))


def elements(value: Column, path: str) -> Column:
    """The elements of a list, each of any type; null for any other type."""
    return F.try_variant_get(value, path, "array<variant>")


def strings(value: Column, path: str) -> Column:
    """The strings of a list, other elements left out; none for any other type."""
    found = F.transform(F.filter(elements(value, path), lambda x: F.coalesce(type_of(x) == "STRING", F.lit(False))), lambda x: x.cast("string"))
    return F.coalesce(found, F.array().cast(STRINGS))


def json_or(value: Column, path: str, kind: str, default: str) -> Column:
    """The JSON of a list (``kind`` ARRAY) or object (OBJECT), else the default."""
    v = at(value, path)
    return F.when(F.startswith(type_of(v), F.lit(kind)), F.to_json(v)).otherwise(default)


def first_filled(*lists: Column) -> Column:
    """The first list that has elements; none if no one has. Each is made once."""
    return F.coalesce(F.get(F.filter(F.array(*lists), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast(STRINGS))


def normalised(responses: DataFrame, body: str) -> DataFrame:
    """``responses`` with ``ok`` (the body is an object) and the typed columns of a parsed CV, in place of ``body``.

    A list that is missing or of another type is looked for among the extracted
    parts and is empty without them; other elements than strings go. Years stay
    null if there are none, as none is no zero. Scores are numbers, else 0; texts
    are strings, else empty, the raw text else the plain one. Lists and objects of details
    stay JSON. A body that can't be read, or isn't an object, gives the defaults.
    """
    rows = responses.withColumn("_v", F.try_parse_json(body))
    v = F.when(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.col("_v"))
    rows = rows.withColumn("_v", v)
    v = F.col("_v")
    either = lambda name: first_filled(strings(v, f"$.{name}"), strings(v, f"$.extracted_info.{name}"))
    score = as_number(v, "$.readinessScore")
    named = {
        "ok": v.isNotNull(),
        **{f"contact_{c}": as_string(v, f"$.contact.{c}") for c in ("name", "email", "phone")}, "contact_links": strings(v, "$.contact.links"),
        **{c: either(c) for c in ("skills", "technologies", "education", "experience", "certifications", "projects")}, "demonstrated": strings(v, "$.demonstratedTechnologies"),
        "years_total": as_number(v, "$.yearsTotal"), "seniority": F.coalesce(as_string(v, "$.seniority"), F.lit("unknown")), "readiness": F.coalesce(F.floor(score + 0.5).cast("long"), F.lit(0).cast("long")),
        "breakdown": json_or(v, "$.readinessBreakdown", "OBJECT", "{}"), "education_detail": json_or(v, "$.educationDetail", "ARRAY", "[]"), "experience_detail": json_or(v, "$.experienceDetail", "ARRAY", "[]"),
        "tracks": first_filled(strings(v, "$.suggestedTracks"), strings(v, "$.domains")), "sections": strings(v, "$.sectionsFound"), "confidence": F.coalesce(as_number(v, "$.extractionConfidence"), F.lit(0.0)),
        "warnings": strings(v, "$.warnings"), "raw_text": F.coalesce(as_string(v, "$.rawText"), as_string(v, "$.text"), F.lit("")),
    }
    return rows.withColumns(named).drop("_v", body)


def parsed_or_empty(text: Column, schema: str) -> Column:
    """A JSON column by its schema (a list's), an empty list if it is null or can't be read."""
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def without(items: Column, *keys: str) -> Column:
    """Structs of a list without some of their fields."""
    return F.transform(items, lambda x: x.dropFields(*keys))
