"""String functions: line ends, Unicode, blanks, truncation, subjects."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpida.functions.dialect import java_regex
from limpida.functions.spans import let

TRUNCATION_MARKER = "\n\n[TEXT TRUNCATED FOR MEMORY SAFETY]"  # fixed value

_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BLANKS_IN_LINE = _BLANKS.replace("\n", "")
# Found by its line end (one is put behind the last line), so that the matcher passes over all other characters quickly.
_BLANK_BEFORE_LINE_END = rf"\n(?<=[{_BLANKS_IN_LINE}]\n)"
_SUBJECT_PREFIXES = java_regex(r"^(?:(?:re|fw|fwd|r|i):\s*)+", ignore_case=True)

# Code points that never change under NFC, whatever stands next to them: combining
# class 0, no decomposition to undo, no composition with the character before.
# Everything outside these ranges sends the text to the Python stage.
_NFC_INERT = (
    r"\u0370-\u0373\u0375-\u0377\u037a-\u037d\u0388-\u0482\u1e00-\u1e99"
    r"\u2002-\u20cf\u2190-\u2328\u232b-\u2adb\u3001-\u3029\u3030-\u3098\u309b-\u30ff"
    r"\u4e00-\u9fff\uac00-\ud7a3\x{1f300}-\x{1faff}"
)
# The first class is one range, so that the matcher looks closer at few characters only.
_MAY_CHANGE_UNDER_NFC = rf"[[^\x00-\u02ff]&&[^{_NFC_INERT}]]"
_OTHER_SPACE = r"[\p{Zs}&&[^ ]]"
_HAS_OTHER_SPACE = rf"[^\x00-\x9f](?<={_OTHER_SPACE})"


def is_ascii(text: Column) -> Column:
    """True when every character takes one byte; no scan by regular expression."""
    return F.octet_length(text) == F.length(text)


def unix_line_ends(text: Column) -> Column:
    """CR LF and CR become LF."""
    without_pairs = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(
        F.contains(text, F.lit("\r")), F.replace(without_pairs, F.lit("\r"), F.lit("\n"))
    ).otherwise(text)


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


# Catalyst folds the projections between two Python stages into one and repeats every
# expression there once per use. Marked so, a Python stage keeps its projections apart.
_compose = _compose.asNondeterministic()


def with_nfc(df: DataFrame, text: str, out: str) -> DataFrame:
    """Canonical composition. Spark has no such function, so the few texts that could
    change go through Arrow; all others reach the Python stage as nulls, and so do texts that are
    no valid UTF-8, which Python cannot read."""
    source = F.col(text)
    candidate = F.when(~is_ascii(source) & source.rlike(_MAY_CHANGE_UNDER_NFC) & F.is_valid_utf8(source), source)
    return (
        df.withColumn("__composed", _compose(candidate))
        .withColumn(out, F.coalesce("__composed", source))
        .drop("__composed")
    )


def plain_spaces(text: Column) -> Column:
    """Every Unicode space separator becomes an ordinary space."""
    plain = is_ascii(text) | (F.is_valid_utf8(text) & ~text.rlike(_HAS_OTHER_SPACE))
    return F.when(plain, text).otherwise(F.regexp_replace(text, _OTHER_SPACE, " "))


def squeeze_blanks(text: Column) -> Column:
    """Drop blanks at line ends, keep one of several spaces and two of several newlines.

    Spaces are squeezed first: blanks at line ends vanish either way.
    """

    def trimmed_lines(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n", -1), lambda line: F.rtrim(line, F.lit(_BLANKS)))
        broken = ~F.is_valid_utf8(t)  # splitting puts stand-ins for broken bytes
        blank = F.concat(t, F.lit("\n")).rlike(_BLANK_BEFORE_LINE_END)
        return F.when(broken | blank, F.array_join(lines, "\n")).otherwise(t)

    def fewer_newlines(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    single_spaced = F.when(
        F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")
    ).otherwise(text)
    return let(let(single_spaced, trimmed_lines), fewer_newlines)


def strip(text: Column) -> Column:
    """Drop blanks of any kind at both ends (Spark's ``trim`` knows only the space)."""
    return F.btrim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(_BLANKS)) == ""


def tidy(text: Column) -> Column:
    """Final clean-up of a body."""
    return strip(squeeze_blanks(text))


def with_subject_key(df: DataFrame, subject: str, out: str) -> DataFrame:
    """Thread key of a subject: no reply or forward prefixes, lower case, plain spaces."""
    df = with_nfc(df.withColumn(out, F.coalesce(F.col(subject), F.lit(""))), out, out)
    df = df.withColumn(out, F.lower(F.regexp_replace(out, _SUBJECT_PREFIXES, "")))
    return df.withColumn(out, strip(plain_spaces(F.col(out))))


def truncate_bytes(text: Column, max_kb: int = 500) -> Column:
    """Cut to ``max_kb`` kilobytes of UTF-8 without a broken last character, and say so.

    A byte cut can split at most one character, so of the bytes kept the last whole
    characters are found by backing off over continuation bytes (10xxxxxx).
    """
    limit = max_kb * 1024
    data = F.encode(text, "UTF-8")

    def starts_character(position: int) -> Column:
        byte = F.conv(F.hex(F.substring(data, position, 1)), 16, 10).cast("int")
        return (byte < 0x80) | (byte >= 0xC0)

    # The cut is clean when the first byte left out starts a character; otherwise the
    # character that spans the cut starts one to three bytes before it.
    keep = (
        F.when(starts_character(limit + 1), limit)
        .when(starts_character(limit), limit - 1)
        .when(starts_character(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    cut = F.decode(F.substring(data, F.lit(1), keep), "UTF-8")
    return F.when(
        F.octet_length(text) > limit, F.concat(cut, F.lit(TRUNCATION_MARKER))
    ).otherwise(text)


def truncate_chars(text: Column, max_chars: int) -> Column:
    """Cut to a number of characters (code points)."""
    return F.when(F.length(text) > max_chars, F.left(text, F.lit(max_chars))).otherwise(text)
