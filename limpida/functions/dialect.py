"""Writes a portable regular expression in Java's dialect.

The pattern tables hold plain text with ``\\s``, ``\\d`` and ``\\b``, and the results to match
use their Unicode meaning. The flags say so: ``U`` gives the shorthands that meaning, ``d``
makes only ``\\n`` a line end, ``iu`` folds case beyond ASCII.
"""

from __future__ import annotations

# Members of a class of blanks, under the flag U; Java leaves the four separators out.
SPACE_CHARS = r"\s\x1c-\x1f"
SPACE = f"(?U)[{SPACE_CHARS}]"

# Java's Unicode ``\b`` counts some characters as part of a word that the results to match
# do not, and the other way round. ``fit_boundaries`` puts a stand-in for each of them.
NUMBERS_NO_DIGITS = r"\p{No}"  # in a word, but not for Java
MARKS_AND_JOINERS = (  # in no word, but for Java
    r"[\p{M}\u200c\u200d\u203f\u2040\u2054\ufe33\ufe34\ufe4d-\ufe4f\uff3f\u24b6-\u24e9"
    r"\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}]"
)
WORD_STAND_IN, GAP_STAND_IN = "\xaa", "\xb7"


def java_regex(
    pattern: str,
    *,
    ignore_case: bool = False,
    dot_all: bool = False,
    multi_line: bool = False,
) -> str:
    """Return ``pattern`` with its flags in front and the blanks made complete."""
    flags = "dU" + ("iu" if ignore_case else "") + ("s" if dot_all else "") + ("m" if multi_line else "")
    out, in_class, chars = [], False, iter(pattern)
    for ch in chars:
        if ch == "\\":
            ch += next(chars)
            if ch == r"\s":
                ch = SPACE_CHARS if in_class else f"[{SPACE_CHARS}]"
        elif ch in "[]":
            in_class = ch == "["
        out.append(ch)
    return f"(?{flags})" + "".join(out)
