"""Pattern tables. Users may pass their own rows through ``CleaningOptions``.

``needs`` lists text fragments that every match contains, in lower case. A row of text
without them skips the pattern, so the costly expression runs on few rows only. The
fragments of case-blind patterns avoid the letters i, k and s: other code points fold to
these (dotless i, Kelvin sign, long s), all other letters have one lower-case form.
"""

from __future__ import annotations

from typing import NamedTuple

from limpida.functions.dialect import java_regex


class RemovalPattern(NamedTuple):
    """A section to cut out of the text, with the confidence of the audit record."""

    type: str
    regex: str
    confidence: float
    group: str
    mode: str  # "lines": ^ and $ match per line; "span": dot-all and case-blind
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        if self.mode == "lines":
            return java_regex(self.regex, multi_line=True)
        return java_regex(self.regex, ignore_case=True, dot_all=True)


class PiiPattern(NamedTuple):
    """A kind of personal data, found by regular expression."""

    type: str
    regex: str
    gate: str  # cheap Java expression that every text with a match satisfies

    @property
    def java(self) -> str:
        return java_regex(self.regex, ignore_case=True)


class AllowPattern(NamedTuple):
    """Business numbers; a hit that overlaps one is no personal data."""

    type: str
    regex: str

    @property
    def java(self) -> str:
        return java_regex(self.regex, ignore_case=True)


# Expressions, types, confidences and their order must stay as they are,
# because each pattern works on the text that the ones before it left.
REMOVAL_PATTERNS: tuple[RemovalPattern, ...] = (
    RemovalPattern("quote_standard", r"^[\s]*>+.*$", 1.0, "quotes", "lines", (">",)),
    RemovalPattern(
        "reply_header_it", r"Il giorno.{1,200}ha scritto:", 0.95, "quotes", "span", ("orno", "tto:")
    ),
    RemovalPattern("reply_header_en", r"On.{1,200}wrote:", 0.95, "quotes", "span", ("wrote:",)),
    RemovalPattern(
        "reply_header_outlook", r"Da:.{1,300}Oggetto:", 0.95, "quotes", "span", ("da:", "oggetto:")
    ),
    RemovalPattern("signature_separator", r"^[\s]*--[\s]*$", 1.0, "signatures", "lines", ("--",)),
    RemovalPattern(
        "signature_underline", r"^[\s]*_{5,50}[\s]*$", 0.9, "signatures", "lines", ("_____",)
    ),
    RemovalPattern(
        "disclaimer_confidential",
        r"Questo messaggio.{1,500}confidenziale",
        0.85,
        "signatures",
        "span",
        ("denz", "agg"),
    ),
    RemovalPattern(
        "disclaimer_privacy", r"Informativa privacy.{1,500}GDPR", 0.85, "signatures", "span", ("gdpr",)
    ),
    RemovalPattern(
        "disclaimer_environment",
        r"P\.?[\s]?Rispetta l['\']ambiente.{1,200}",
        0.8,
        "signatures",
        "span",
        ("petta l", "amb"),
    ),
    RemovalPattern(
        "closing_formal", r"Cordiali saluti[,\s]{0,10}", 0.9, "signatures", "span", ("cord", "alut")
    ),
    RemovalPattern(
        "closing_formal", r"Distinti saluti[,\s]{0,10}", 0.9, "signatures", "span", ("nt", "alut")
    ),
    RemovalPattern(
        "forward_marker",
        r"^[\s]*-{3,50}[\s]*Forwarded message[\s]*-{3,50}",
        1.0,
        "quotes",
        "lines",
        ("---", "forwarded message"),
    ),
    RemovalPattern(
        "forward_marker_it",
        r"^[\s]*-{3,50}[\s]*Messaggio inoltrato[\s]*-{3,50}",
        1.0,
        "quotes",
        "lines",
        ("---", "messaggio inoltrato"),
    ),
)

# The order decides ties between equal spans.
PII_PATTERNS: tuple[PiiPattern, ...] = (
    PiiPattern("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@"),
    PiiPattern(
        "PHONE_IT",
        r"(?:\+39[\s]?[0-9]{2,3}[\s]?[0-9]{6,7}|0[0-9]{2,3}[\s]?[0-9]{6,7})",
        "[0-9]{6}",
    ),
    PiiPattern("PIVA", r"\b(?:IT\s?)?[0-9]{11}\b", "[0-9]{11}"),
    PiiPattern(
        "CF",
        r"\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b",
        "(?iu)[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]",
    ),
    PiiPattern("IBAN", r"\bIT\d{2}[A-Z]\d{10}[0-9A-Z]{12}\b", r"\p{Nd}{10}"),
)

# Fixed values.
ALLOW_PATTERNS: tuple[AllowPattern, ...] = (
    AllowPattern(
        "INVOICE_NUMBER",
        r"\b(?:fattura|invoice|ordine|order|pratica)\s*(?:n\.?|num\.?|nr\.?)?\s*\d+\b",
    ),
    AllowPattern("REFERENCE_NUMBER", r"\b(?:rif\.?|ref\.?|protocollo|prot\.?)\s*\d+\b"),
)

# Header fields whose text is searched for personal data.
PERSONAL_HEADERS = ("from", "to", "cc", "bcc", "reply-to", "sender", "subject")

# Titles that are never a name by themselves.
TITLES = ("dr", "sig", "sig.ra", "dott", "prof", "ing")

# Field names that must not reach a log or an export.
SENSITIVE_FIELDS = (
    "pii_salt",
    "raw_bytes",
    "body_text",
    "body_html",
    "body_text_canonical",
    "body_html_canonical",
    "from_addr",
    "to_addrs",
    "email",
    "phone",
    "password",
    "token",
    "secret",
    "api_key",
)
