"""Header blocks and address lists."""

from __future__ import annotations

import re
from email.header import decode_header

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpida.functions.spans import let
from limpida.functions.text import strip

_ENCODED_WORDS = re.compile(r"=\?[^?\s]+\?[bBqQ]\?[^?]*\?=(?:\s+=\?[^?\s]+\?[bBqQ]\?[^?]*\?=)*")


def _decode_run(match: re.Match) -> str:
    """Decode neighbouring encoded words; blanks between them do not count."""
    words = []
    for data, charset in decode_header(match.group()):
        if isinstance(data, str):
            words.append(data)
            continue
        try:
            words.append(data.decode(charset or "utf-8", "replace"))
        except LookupError:
            words.append(data.decode("utf-8", "replace"))
    return "".join(words)


def _decode(value: str | None) -> str | None:
    if value is None or "=?" not in value:
        return value
    try:
        return _ENCODED_WORDS.sub(_decode_run, value)
    except Exception:  # a value that cannot be decoded stays as it is
        return value


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def _decode_values(values):
    """A plain function of rows: while it runs a hundred whole messages wait, not an Arrow batch of them."""
    return None if values is None else [_decode(v) for v in values]


_decode_values = _decode_values.asNondeterministic()  # see ``text.with_nfc``


def header_block(raw: Column) -> Column:
    """Header text of a raw message: everything before the first empty line."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.element_at(F.split(text, r"\r?\n\r?\n", 2), 1)


def header_fields(block: Column) -> Column:
    """Unfolded fields in order, ``array<struct<name,value>>`` with lower-case names.

    Reading stops at the first line that is no field, as mail parsers do.
    """
    lines = F.split(F.regexp_replace(block, r"\r?\n(?=[ \t])", ""), r"\r\n|\r|\n", -1)
    field = r"(?s)^([!-9;-~]+)[ \t]*:[ \t]*(.*)$"

    def keep_leading(all_lines: Column) -> Column:
        is_field = F.transform(all_lines, lambda line: line.rlike(field))
        stop = F.coalesce(F.array_position(is_field, False), F.lit(0))
        return F.when(stop == 0, all_lines).otherwise(F.slice(all_lines, F.lit(1), stop - 1))

    return F.transform(
        let(lines, keep_leading),
        lambda line: F.struct(
            F.lower(F.regexp_extract(line, field, 1)).alias("name"),
            F.regexp_extract(line, field, 2).alias("value"),
        ),
    )


def fields_to_map(fields: Column, duplicates: str = "join") -> Column:
    """Map of the fields. Repeated names are joined by ``"; "``, or the last one wins."""
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))

    def value(name: Column) -> Column:
        same = F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"])
        return F.array_join(same, "; ") if duplicates == "join" else F.element_at(same, -1)

    return F.map_from_arrays(names, F.transform(names, value))


def with_header_map(
    df: DataFrame, block: Column, out: str, duplicates: str = "join"
) -> DataFrame:
    """Add the map of a header block; a block without any field gives null.

    RFC 2047 words are decoded. Only blocks that hold such words reach the Python
    stage; for all others it sees a null.
    """
    raw, decoded = F.col("__fields_raw"), F.col("__fields_decoded")
    encoded = F.exists(raw, lambda f: F.contains(f["value"], F.lit("=?")))
    fields = F.when(
        decoded.isNotNull(),
        F.zip_with(raw, decoded, lambda f, v: F.struct(f["name"].alias("name"), v.alias("value"))),
    ).otherwise(raw)
    return (
        df.withColumn("__fields_raw", header_fields(block))
        .withColumn(
            "__fields_decoded",
            _decode_values(F.when(encoded, F.transform(raw, lambda f: f["value"]))),
        )
        .withColumn("__fields_raw", fields)
        .withColumn(out, F.when(F.size(raw) > 0, fields_to_map(raw, duplicates)))
        .drop("__fields_raw", "__fields_decoded")
    )


def split_addresses(addresses: Column) -> Column:
    """Split at commas, trim, drop empties. Commas inside quoted names split too."""
    pieces = F.transform(F.split(F.coalesce(addresses, F.lit("")), ",", -1), strip)
    return F.filter(pieces, lambda a: a != "")


def header(headers: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(default))
