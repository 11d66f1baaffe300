"""Model responses: fence removal, typed parsing with rejects, exploding nested rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions.text import col, strip

# Fixed value: the first fenced block of an answer.
FENCED = r"```(?:json)?\s*([\s\S]*?)\s*```"
_MAP = "MAP<STRING,STRING>"


def unfenced(raw: Column | str) -> Column:
    """Content of the first fenced block, else the whole text; trimmed."""
    c = col(raw)
    return strip(F.when(c.rlike(FENCED), F.regexp_extract(c, FENCED, 1)).otherwise(c))


def _scalar(value: Column, kind: T.DataType) -> Column:
    """Lenient conversion of a JSON scalar; null when it does not fit the type."""
    if isinstance(kind, T.IntegerType):
        # "7" and 7.0 are integers, 7.5 is not.
        number = F.try_variant_get(value, "$", "double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    return F.try_variant_get(value, "$", kind.simpleString())


def _is_rows(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType)


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _typed(value: Column, field: T.StructField) -> Column:
    """The typed value of a key's variant; null where it does not fit."""
    if _is_rows(field):
        inner = field.dataType.elementType.fields
        return F.transform(F.try_variant_get(value, "$", "array<map<string, variant>>"), lambda r: F.struct(*[
            _typed(F.try_element_at(r, F.lit(f.name)), f).alias(f.name) for f in inner]))
    if isinstance(field.dataType, T.ArrayType):
        return F.try_variant_get(value, "$", "array<string>")
    return _scalar(value, field.dataType)


def _sound(value: Column, typed: Column, field: T.StructField) -> Column:
    """Whether a key is there and its value acceptable: lists are never null, nor are their items."""
    if _is_rows(field):
        inner = field.dataType.elementType.fields
        rows = F.try_variant_get(value, "$", "array<map<string, variant>>")
        fits = F.forall(rows, lambda r: reduce(lambda a, b: a & b, [
            _sound(v := F.try_element_at(r, F.lit(f.name)), _typed(v, f), f) for f in inner]))
    elif isinstance(field.dataType, T.ArrayType):
        fits = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda i: F.coalesce(_is_text(i), F.lit(False)))
    else:
        fits = typed.isNotNull()
        if isinstance(field.dataType, T.StringType):
            fits = _is_text(value)
        if field.nullable:
            fits = fits | F.is_variant_null(value)
    return F.coalesce(fits, F.lit(False))


def parse(df: DataFrame, raw: str, schema: T.StructType) -> DataFrame:
    """Add ``response`` (typed struct or null) and ``accepted``.

    A response is accepted when it is one JSON object and nothing else, with every key of the schema
    present, every non-nullable value set, and every value of a fitting type; a text field takes JSON texts only.
    The text is parsed once; its keys' values become columns of their own, which the checks and the typed
    value share.
    """
    # Anything after the object would be passed over silently: in an array it is a further element or breaks the parse.
    parsed = df.withColumn("_all", F.try_parse_json(F.concat(F.lit("["), unfenced(raw), F.lit("]"))))
    alone = F.try_variant_get("_all", "$[1]", "variant").isNull()
    parsed = parsed.withColumn("_map", F.when(alone, F.try_variant_get("_all", "$[0]", "map<string, variant>")))
    values = {f"_v{i}": F.try_element_at("_map", F.lit(f.name)) for i, f in enumerate(schema.fields)}
    parsed = parsed.withColumns(values)
    typed = {f"_t{i}": _typed(F.col(f"_v{i}"), f) for i, f in enumerate(schema.fields)}
    parsed = parsed.withColumns(typed)
    sound = reduce(lambda a, b: a & b, [_sound(F.col(f"_v{i}"), F.col(f"_t{i}"), f) for i, f in enumerate(schema.fields)])
    parsed = parsed.withColumn("accepted", F.col("_map").isNotNull() & sound)
    made = F.struct(*[F.col(f"_t{i}").alias(f.name) for i, f in enumerate(schema.fields)])
    return parsed.withColumn("response", F.when(F.col("accepted"), made)).drop("_all", "_map", *values, *typed)


def accepted_rows(parsed: DataFrame) -> DataFrame:
    """Accepted responses with their fields as columns.

    A plain filter on ``accepted`` would be pushed below the parsing and parse everything twice; an
    outer explode keeps the test behind it.
    """
    rest = [c for c in parsed.columns if c not in ("response", "accepted")]
    one = F.when(F.col("accepted"), F.array("response"))
    return parsed.select(*rest, F.explode_outer(one).alias("_r")) \
        .where(F.col("_r").isNotNull()).select(*rest, "_r.*")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("accepted")).drop("response", "accepted")


def explode_rows(parsed: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """One row per nested entity of the accepted responses, with its position."""
    items = parsed.select(*keys, F.posexplode_outer(f"response.{field}").alias("pos", "_e"))
    return items.where(F.col("_e").isNotNull()).select(*keys, "pos", "_e.*")


def json_or_text(df: DataFrame, raw: str) -> DataFrame:
    """Add ``json`` (VARIANT, null unless the text is JSON) and ``plain`` (the text otherwise)."""
    return df.withColumn("json", F.try_parse_json(raw)) \
        .withColumn("plain", F.when(F.col("json").isNull(), F.col(raw)))
