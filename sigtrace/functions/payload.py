"""Free-form metadata (JSON / VARIANT) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON texts are cut into strings, brackets and all else; every repetition is possessive and so not recursive.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
MARKS = STRING + r"|[\[\]{},:]|[^\[\]{},:\"]++"
#: Stand for an object, and for braces inside strings, while a text is rendered; JSON has these characters escaped.
OBJECT, BRACES = "\u0001", "\u0002\u0003"


def _number_text(text: Column) -> Column:
    """Java's ``1.0E30`` in the plainer form ``1e30``."""
    return F.regexp_replace(F.replace(text, F.lit("E"), F.lit("e")), r"\.0e", "e")


def _unquoted(text: Column) -> Column:
    """The string that a JSON string stands for."""
    return F.try_variant_get(F.try_parse_json(text), "$", "string")


def _object_depth(marks: Column) -> Column:
    """How deep objects are nested in each other in a list of marks."""

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(now, s["most"]).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def _array_text(json: Column) -> Column:
    """A JSON array for display, however deep its arrays are nested.

    Brackets need no stack, since they are shown where they stand.  Objects, which are shown
    by a word, are taken out from the innermost to the outermost: as many passes as they are deep.
    """
    marks = F.regexp_extract_all(json, F.lit(MARKS), F.lit(0))
    is_string = lambda t: F.startswith(t, F.lit('"'))
    neutral = F.array_join(F.transform(marks, lambda t: F.when(is_string(t), F.translate(t, "{}", BRACES)).otherwise(t)), "")
    depth = _object_depth(marks)
    passes = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    flat = F.aggregate(passes, neutral, lambda text, _: F.regexp_replace(text, r"\{[^{}]*+\}", OBJECT))
    shown = F.transform(
        F.regexp_extract_all(flat, F.lit(MARKS), F.lit(0)),
        lambda t: F.when(t == ",", F.lit(", "))
        .when(t == OBJECT, F.lit("[Object]"))
        .when(is_string(t), _unquoted(F.translate(t, BRACES, "{}")))
        .otherwise(_number_text(t)),
    )
    return F.array_join(shown, "")


def variant_text(v: Column) -> Column:
    """One metadata value for display.

    Strings as they are, numbers and booleans as text, ``null``, arrays as
    ``[a, b]``, objects as ``[Object]``.
    """
    json = F.coalesce(F.to_json(v), F.lit("null"))
    first = F.left(json, F.lit(1))
    return (
        F.when(first == '"', F.try_variant_get(v, "$", "string"))
        .when(first == "{", F.lit("[Object]"))
        .when(first == "[", _array_text(json))
        .otherwise(_number_text(json))
    )


def flatten_payload(df: DataFrame, col: str) -> DataFrame:
    """One row per key of the JSON object in ``col``: ``pos``, ``key``, ``value_text``.

    Keys come in sorted order.  Text that is JSON but no object, and text that is
    no JSON, gives one row with a null key and the whole value.  Text nested in more
    than 1,000 levels counts as no JSON, as Spark's reader takes no more.
    """
    parsed = df.withColumn("__v", F.try_parse_json(F.col(col)))
    is_object = F.startswith(F.to_json("__v"), F.lit("{"))
    entries = F.when(is_object, F.try_variant_get("__v", "$", "map<string,variant>"))
    ordered = F.array_sort(F.map_keys(entries))
    whole = F.array(F.lit(None).cast("string"))
    exploded = (
        parsed.withColumn("__m", entries)
        .select("*", F.posexplode(F.coalesce(F.when(is_object, ordered), whole)).alias("pos", "key"))
    )
    value = F.when(
        F.col("key").isNotNull(), variant_text(F.element_at(F.col("__m"), F.col("key")))
    ).otherwise(F.coalesce(F.to_json("__v"), F.col(col)))
    return exploded.withColumn("value_text", value).drop("__v", "__m")


def build_epoch(v: Column) -> Column:
    """A non-negative whole number as LONG; any other VARIANT gives null."""
    whole = F.when(
        F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")
    )
    return F.when(whole >= 0, whole)


def pick_description(m: Column) -> Column:
    """English text of a language map, else its first text, else null."""
    texts = F.filter(F.map_values(m), lambda t: t.isNotNull())
    return F.coalesce(F.try_element_at(m, F.lit("en")), F.get(texts, F.lit(0)))
