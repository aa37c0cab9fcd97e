"""Masking of sensitive fields at any depth of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpida.functions.patterns import SENSITIVE_FIELDS

MASK = "[REDACTED]"  # fixed value


def _masked(value: Column, kind: T.DataType, fields: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(
            *(
                _field(value.getField(f.name), f, fields).alias(f.name)
                for f in kind.fields
            )
        )
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(
                value, lambda k, v: F.when(F.lower(k).isin(*fields), MASK).otherwise(v)
            )
        return F.transform_values(
            value,
            lambda k, v: F.when(
                ~F.lower(k).isin(*fields), _masked(v, kind.valueType, fields)
            ),
        )
    return value


def _field(value: Column, field: T.StructField, fields: tuple[str, ...]) -> Column:
    if field.name.lower() in fields:
        return F.lit(MASK)
    return _masked(value, field.dataType, fields)


def mask_sensitive(df: DataFrame, fields: tuple[str, ...] = SENSITIVE_FIELDS) -> DataFrame:
    """Replace sensitive columns, struct fields and map values by a mask.

    The projection is built from the schema, so nothing is looked up per row. Lists pass
    unchanged. A sensitive map value that is no text becomes null.
    """
    return df.select(*(_field(F.col(f"`{f.name}`"), f, fields).alias(f.name) for f in df.schema.fields))


def mask_json(text: Column, schema: T.StructType, fields: tuple[str, ...] = SENSITIVE_FIELDS) -> Column:
    """The same for a JSON text of known schema."""
    return F.to_json(_masked(F.from_json(text, schema), schema, fields))


#: Nested objects that are looked into; deeper ones are masked whole.
MOST_DEPTH = 32
_STRINGS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def json_depth(text: Column) -> Column:
    """How deep objects are nested in a JSON text: braces outside strings, counted in one fold."""
    braces = F.regexp_replace(F.regexp_replace(text, _STRINGS, ""), r"[^{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, brace: Column) -> Column:
        now = at["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(braces, ""), start, step, lambda at: at["most"])


def _masked_variant(value: Column, depth: int, fields: tuple[str, ...]) -> Column:
    mask = F.parse_json(F.lit(f'"{MASK}"'))
    inner = F.try_variant_get(value, "$", "map<string,variant>")
    if depth == 0:
        return F.when(inner.isNull(), value).otherwise(mask)
    rebuilt = F.transform_values(
        inner,
        lambda k, v: F.when(F.lower(k).isin(*fields), mask).otherwise(_masked_variant(v, depth - 1, fields)),
    )
    return F.when(inner.isNull(), value).otherwise(F.to_variant_object(rebuilt))


def mask_any_json(text: Column, depth: int = MOST_DEPTH, fields: tuple[str, ...] = SENSITIVE_FIELDS) -> Column:
    """Mask sensitive keys, blind to case, in JSON texts of any and mixed shape, without a schema.

    Objects are rebuilt level by level, ``depth`` levels deep; what lies deeper is masked whole, so
    nothing passes unseen. Lists and plain values pass unchanged. A text that is no valid JSON, or
    repeats a key, is masked whole; null stays null. Keys come out in order of name, and numbers in
    their plain form.
    """
    masked = F.to_json(_masked_variant(F.try_parse_json(text), depth, fields))
    return F.when(text.isNotNull(), F.coalesce(masked, F.lit(f'"{MASK}"')))


def with_masked_json(df: DataFrame, column: str, out: str, fields: tuple[str, ...] = SENSITIVE_FIELDS) -> DataFrame:
    """``mask_any_json`` as deep as the texts of a batch are nested: one pass finds out how deep."""
    deepest = df.agg(F.max(json_depth(F.col(column)))).first()[0] or 0
    return df.withColumn(out, mask_any_json(F.col(column), min(deepest, MOST_DEPTH), fields))
