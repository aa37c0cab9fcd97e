"""Plain Python statements of the semantics, for comparison on small inputs."""

import random
import re
import unicodedata

from limpida.functions.patterns import ALLOW_PATTERNS, PII_PATTERNS, REMOVAL_PATTERNS

FRAGMENTS = (
    "mario.rossi@example.com", "a@b.it", "x@y", "@", "+39 333 1234567", "0552345678", "02 87654321",
    "IT12345678901", "12345678901", "01234567890", "RSSMRA85M01H501Z", "IT60X0542811101000000123456",
    "Fattura n. 12345678901", "ordine 02345678901", "rif. 12", "prot.99", "²", "e\u0301", "é", "\u0301", "_", "ſ",
    "\u00a0", "\u2003", "\u2028", "\u0085", "\x1c", "\U0001d4b3", "😀", "٣٤٥٦٧٨٩٠١٢", "K", "İ",
    " ", "  ", "\n", "\n\n", "\n\n\n", "\r\n", "\r", "\t", "\n> quote", ">> q", "\n--\n", "\n -- \n", "\n_____ \n",
    "Il giorno 1 gen x ha scritto:", "on day wrote:", "On x\nwrote:", "Da: x", "Oggetto: y",
    "Questo messaggio è confidenziale", "queſto meſſaggio x confidenziale", "Informativa privacy x GDPR",
    "P. Rispetta l'ambiente", "Cordiali saluti, \n", "DISTINTI SALUTI", "cordialı ſaluti",
    "\n--- Forwarded message ---", "\n---- Messaggio inoltrato ----", "testo", "parola", "Abc", "1", "2026",
)


def random_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def compiled(pattern):
    if hasattr(pattern, "mode"):
        flags = re.M if pattern.mode == "lines" else re.I | re.S
        return re.compile(pattern.regex, flags)
    return re.compile(pattern.regex, re.I)


def tidy(text):
    lines = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", lines)).strip()


def canonical(text, patterns=REMOVAL_PATTERNS):
    text = unicodedata.normalize("NFC", re.sub(r"\r\n?", "\n", text))
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text)
    cuts = []
    for stage, pattern in enumerate(patterns, 1):
        found = compiled(pattern)
        cuts += [(stage, pattern.type, *m.span(), m.group()[:100]) for m in found.finditer(text)]
        text = found.sub("\n", text)
    return tidy(text), cuts


def hits(text):
    allowed = [m.span() for p in ALLOW_PATTERNS for m in compiled(p).finditer(text)]
    return [
        (m.start(), m.end(), p.type, "regex")
        for p in PII_PATTERNS
        for m in compiled(p).finditer(text)
        if not any(s < m.end() and m.start() < e for s, e in allowed)
    ]


def merge(found):
    """Fold sorted hits into one list; the last entry is the one still open."""
    result = []
    for hit in sorted(found, key=lambda h: h[0]):
        if not result or result[-1][1] <= hit[0] or hit[1] <= result[-1][0]:
            result.append(hit)
        elif result[-1][3] != hit[3]:
            result[-1] = min(result[-1], hit, key=lambda h: h[3] != "regex")
        elif hit[1] - hit[0] > result[-1][1] - result[-1][0]:
            result[-1] = hit
    return result


def redacted(text, found):
    out, pos = [], 0
    for start, end, kind, _ in found:
        out += [text[pos:start], f"[PII_{kind}]"]
        pos = end
    return "".join(out) + text[pos:]
