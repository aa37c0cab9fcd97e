"""Choice and merge of the plain and HTML bodies of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpida.functions.dialect import SPACE
from limpida.functions.spans import let
from limpida.functions.text import is_blank

NEW_WORD_SHARE = 0.2  # fixed value


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"{SPACE}+", -1), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words, split at blanks of any kind."""
    return F.array_distinct(_words(text))


def merge_bodies(plain: Column, html_text: Column) -> Column:
    """One body out of two: the HTML text joins the plain text only when it adds more
    than a fifth of the plain text's distinct words."""
    plain, html_text = F.coalesce(plain, F.lit("")), F.coalesce(html_text, F.lit(""))
    adds_content = let(
        word_set(plain),
        lambda known: F.size(F.array_except(_words(html_text), known)) > F.size(known) * NEW_WORD_SHARE,
    )
    return (
        F.when(is_blank(plain) & is_blank(html_text), "")
        .when(is_blank(html_text), plain)
        .when(is_blank(plain), html_text)
        .when(adds_content, F.concat(plain, F.lit("\n\n"), html_text))
        .otherwise(plain)
    )
