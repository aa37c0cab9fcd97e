"""HTML to text.

Most markup is regular enough for native expressions. A text takes that way only where
they give exactly what a tolerant parser gives: every ``<`` belongs to a well-formed tag,
comment, script or style; links hold plain text; no entity is left that the short table
does not know. All other texts go through Arrow to the standard library's parser.
"""

from __future__ import annotations

import sys
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpida.functions.spans import let
from limpida.functions.text import squeeze_blanks, strip

# Elements whose content is no text.
DROPPED_ELEMENTS = ("script", "style", "meta", "link", "noscript")

# Entities of the native way; the ampersand comes last, so nothing is decoded twice.
_NATIVE_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"),
    ("&middot;", "\xb7"),
    ("&euro;", "€"),
    ("&agrave;", "\xe0"),
    ("&egrave;", "\xe8"),
    ("&eacute;", "\xe9"),
    ("&igrave;", "\xec"),
    ("&ograve;", "\xf2"),
    ("&ugrave;", "\xf9"),
    ("&amp;", "&"),
)
_AMBIGUOUS_AMPERSAND = "&(?!(?:{})|[\\s&<]|\\z)".format(
    "|".join(name[1:] for name, _ in _NATIVE_ENTITIES)
)

# Elements whose content a parser may read in its own way, or that hide their text.
_SPECIAL = "noscript|textarea|template|rt|rp|plaintext|xmp|iframe|noembed|noframes"


def _attributes(but_not: str = "") -> str:
    """A run of attributes. Possessive repeats keep the matcher linear and off the stack."""
    name = (rf"(?!{but_not}\b)" if but_not else "") + r"[a-zA-Z][a-zA-Z-]*+"
    value = r"""="[^"<>]*+"|='[^'<>]*+'|=[a-zA-Z0-9_.#%-]++"""
    return rf"(?:\s++{name}(?:{value})?+)*+\s*+"


def _raw_text(tag: str) -> str:
    """An element whose content is no markup, up to its end tag."""
    return rf"<{tag}{_attributes()}>[^<]*+(?:<(?!/{tag}|!--)[^<]*+)*+</{tag}>"


_SEPARATOR = "(?i)" + "|".join(
    (
        r"<!--(?!-?>)[^-]*+(?:-(?!-)[^-]*+)*+-->",
        r"<!doctype [a-z]++>",
        _raw_text("script"),
        _raw_text("style"),
        rf"<(?!(?:script|style|{_SPECIAL})\b)[a-z][a-z0-9]*+{_attributes()}/?+>",
        rf"</(?!(?:script|style|{_SPECIAL})\b)[a-z][a-z0-9]*+\s*+>",
    )
)
_LINK = (
    rf'(?i)<a(?=\s){_attributes("href")}(?<=\s)href="([^"<>#&][^"<>&]*+)"'
    rf"{_attributes('href')}>([^<]*+)</a>"
)
_OPEN_LINK = r"""(?i)<a\s[^<>]*?\bhref(?!="#|="")"""
_DECODES_AGAIN = "&[a-zA-Z#]"
_SUSPECT = rf"(?i)<(?:/?(?:{_SPECIAL})\b|[?!](?!--|doctype ))"


# Template and ruby annotation text is kept apart from the text of the page.
_TEXTLESS = frozenset((*DROPPED_ELEMENTS, "template", "rt", "rp"))


class _TextNodes(HTMLParser):
    """Collects text nodes, stripped, in document order.

    A link with a target outside the page becomes one node, ``text (target)``.
    """

    _VOID = frozenset(
        "area base br col embed hr img input keygen link menuitem meta param source track wbr "
        "basefont bgsound command frame image isindex nextid spacer".split()
    )
    _BLANKS = " \n\t\f\r"

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.nodes: list[str] = []
        self._open: list[str] = []
        self._pending: list[str] = []
        self._link: tuple[int, str, list[str]] | None = None

    def _flush(self) -> None:
        text, self._pending = "".join(self._pending), []
        if not text or any(tag in _TEXTLESS for tag in self._open):
            return
        if not text.strip(self._BLANKS) and not {"pre", "textarea"} & set(self._open):
            text = "\n" if "\n" in text else " "
        if self._link:
            self._link[2].append(text)
        elif text.strip():
            self.nodes.append(text.strip())

    def _close_to(self, depth: int) -> None:
        del self._open[depth:]
        if self._link and depth <= self._link[0]:
            _, target, parts = self._link
            self._link = None
            self.nodes.append(f"{''.join(parts)} ({target})".strip())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        target = dict(attrs).get("href") if tag == "a" else None
        hidden = any(name in DROPPED_ELEMENTS for name in self._open)
        if target and not target.startswith("#") and not self._link and not hidden:
            self._link = (len(self._open), target, [])
        if tag not in self._VOID:
            self._open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self._VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_charref(self, name: str) -> None:
        self._pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name: str) -> None:
        decoded = unescape(f"&{name};")
        self._pending.append(decoded if decoded != f"&{name};" else f"&{name}")

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = handle_comment

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a section of no known kind: browsers read it as a comment
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[len("CDATA[") :])
            self._flush()

    def finish(self) -> str:
        self.close()
        self._flush()
        self._close_to(0)
        return "\n".join(self.nodes)


def _text_of(markup: str) -> str:
    parser = _TextNodes()
    parser.feed(unescape(markup))
    return parser.finish()


def _parse(markup: str) -> str | None:
    """The text, '' where there is none; null if the markup cannot be read."""
    try:
        return _text_of(markup)
    except ValueError:  # a character number of more digits than ``int`` takes by default
        return _parse_long_numbers(markup)
    except Exception:
        return None


def _parse_long_numbers(markup: str) -> str | None:
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        return _text_of(markup)
    except Exception:
        return None
    finally:
        sys.set_int_max_str_digits(digits)


@F.pandas_udf(T.StringType())
def _parse_batch(markups: pd.Series) -> pd.Series:
    return markups.map(_parse, na_action="ignore")


_parse_batch = _parse_batch.asNondeterministic()  # see ``text.with_nfc``


def _unescape_native(markup: Column) -> Column:
    decoded = markup
    for name, char in _NATIVE_ENTITIES:
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    return F.when(F.contains(markup, F.lit("&")), decoded).otherwise(markup)


def _native_nodes(markup: Column) -> Column:
    """Text nodes by splitting at tags, or null where splitting may differ from parsing."""

    def of_pieces(pieces: Column) -> Column:
        irregular = F.exists(pieces, lambda p: F.contains(p, F.lit("<")) | p.rlike(_DECODES_AGAIN))
        nodes = F.filter(F.transform(pieces, strip), lambda p: p != "")
        return F.when(~irregular, F.array_join(nodes, "\n"))

    # Without ``let`` links would be rewritten three times and tags split at twice.
    linked = F.regexp_replace(markup, _LINK, "<a>$2 ($1)</a>")
    return let(
        linked,
        lambda m: F.when(~m.rlike(_OPEN_LINK), let(F.split(m, _SEPARATOR, -1), of_pieces)),
    )


def native_text(markup: Column) -> Column:
    """The native way; null where the parser has to take over."""
    plain = ~markup.rlike(_AMBIGUOUS_AMPERSAND)
    return F.when(
        plain,
        let(
            _unescape_native(markup),
            lambda m: F.when(~m.rlike(_SUSPECT), _native_nodes(m)),
        ),
    )


def with_html_text(df: DataFrame, markup: str, out: str) -> DataFrame:
    """Add the text of an HTML body; blank or missing markup gives '', markup that cannot be read null."""
    native, parsed, raw = "__html_native", "__html_parsed", F.col(markup)
    return (
        df.withColumn(native, native_text(raw))
        .withColumn(parsed, _parse_batch(F.when(F.isnull(native), F.make_valid_utf8(raw))))
        .withColumn(out, F.coalesce(native, parsed, F.when(raw.isNull(), "")))
        .drop(native, parsed)
        .withColumn(out, strip(squeeze_blanks(F.col(out))))
    )
