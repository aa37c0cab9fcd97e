"""MIME messages: leaves with their content, and bodies put together from them."""

from __future__ import annotations

from email import policy
from email.headerregistry import HeaderRegistry
from email.parser import BytesParser
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("part_no", T.IntegerType()),
            T.StructField("content_type", T.StringType()),
            T.StructField("is_attachment", T.BooleanType()),
            T.StructField("content", T.StringType()),
        ]
    )
)
PARSED = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("parts", PARTS),
    ]
)

_TEXT_TYPES = ("text/plain", "text/html")
_parse_header = HeaderRegistry()
#: Longer header values are parsed anew each time, so that what a worker remembers stays small.
_LONGEST_KNOWN = 200


@lru_cache(1024)
def _known_header(name: str, value: str):
    return _parse_header(name, value)


def _header(name: str, value: str):
    """A parsed header field. The mail parser asks for a part's type some ten times, and few types are in use."""
    return (_known_header if len(value) <= _LONGEST_KNOWN else _parse_header)(name, value)


_POLICY = policy.default.clone(header_factory=_header)


def _content(part) -> str:
    """Decoded text of a leaf; a leaf that cannot be decoded is empty."""
    try:
        content = part.get_content()
        return content if isinstance(content, str) else str(content, "utf-8", "replace")
    except Exception:
        return ""


def _leaves(raw: bytes) -> dict:
    try:
        message = BytesParser(policy=_POLICY).parsebytes(raw)
        whole = not message.is_multipart()
        parts = []
        for number, part in enumerate(p for p in message.walk() if not p.is_multipart()):
            kind = part.get_content_type()
            # A message that is a single part is read whatever its disposition says.
            attached = not whole and "attachment" in str(part.get("Content-Disposition", "")).lower()
            text = _content(part) if kind in _TEXT_TYPES and not attached else ""
            parts.append((number, kind, attached, text))
        return {"status": "ok", "error": None, "parts": parts}
    except Exception as problem:
        # The message of the exception may quote the mail.
        return {"status": "failed", "error": f"parse: {type(problem).__name__}", "parts": []}


@F.udf(PARSED, useArrow=False)
def parse_message(raw):
    """Leaves of a raw message. One row stays one row, so no shuffle brings them together.

    A plain function of rows: they come a hundred at a time, where Arrow would hold ten thousand whole messages.
    """
    return _leaves(bytes(raw)) if raw else {"status": None, "error": None, "parts": []}


parse_message = parse_message.asNondeterministic()  # see ``text.with_nfc``


def body_of(parts: Column, content_type: str) -> Column:
    """Contents of one type in walk order, empty and attached parts left out."""
    chosen = F.filter(
        parts,
        lambda p: (p["content_type"] == content_type) & ~p["is_attachment"] & (p["content"] != ""),
    )
    return F.array_join(F.transform(F.array_sort(chosen), lambda p: p["content"]), "\n\n")
