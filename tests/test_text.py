import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import brute
from limpida.functions import body, html, text as tx
from limpida.functions.patterns import REMOVAL_PATTERNS
from limpida.operators import canonical


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


def test_canonical_text_and_sections_equal_plain_python(texts):
    values = brute.random_texts(500, 1) + ["", "a" * 50 + " " * 3000 + "b"]
    df = canonical.canonicalize(texts(values), "t", "c", "s", REMOVAL_PATTERNS)
    for value, (text, cuts) in zip(values, rows(df, "c", "s")):
        want_text, want_cuts = brute.canonical(value)
        assert text == want_text, repr(value)
        assert [tuple(c)[:5] for c in cuts] == want_cuts, repr(value)


def test_gates_never_hide_a_match(texts):
    values = brute.random_texts(300, 2)
    for pattern in REMOVAL_PATTERNS:
        gated = canonical.remove_sections(texts(values), "t", (pattern,), "c")
        free = canonical.remove_sections(texts(values), "t", (pattern._replace(needs=()),), "c")
        assert rows(gated, "t") == rows(free, "t")


def test_removal_twice_may_remove_more(texts):
    df = texts(["x Cordiali saluti> y"])
    once = canonical.canonicalize(df, "t", "t", "s", REMOVAL_PATTERNS)
    assert rows(once, "t") == [("x\n> y",)]
    assert rows(canonical.canonicalize(once, "t", "t", "s2", REMOVAL_PATTERNS), "t") == [("x",)]


def test_pattern_without_fragments_can_be_added(texts):
    extra = REMOVAL_PATTERNS[0]._replace(type="ticket", regex=r"^Ticket \d+$", needs=())
    df = canonical.canonicalize(texts(["a\nTicket 12\nb"]), "t", "c", "s", (extra,))
    assert rows(df, "c") == [("a\n\nb",)]


def test_composition_equals_unicodedata(texts):
    values = ["cafe\u0301", "café", "\u212b", "가\u11a8", "a\u0323\u0307", "plain", "", "\u2126x", "नुक़्ता", None]
    df = tx.with_nfc(texts(values), "t", "c")
    assert [r[0] for r in rows(df, "c")] == [v and unicodedata.normalize("NFC", v) for v in values]


def test_inert_ranges_hold_no_character_that_composition_changes():
    inert = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), tx._NFC_INERT) + "]")
    seconds = {
        int(d.split()[1], 16)
        for d in map(unicodedata.decomposition, map(chr, range(0x110000)))
        if d and d[0] != "<" and len(d.split()) == 2
    }
    for code in range(0x110000):
        char = chr(code)
        if inert.match(char) and code not in (0x2126, 0x212A, 0x212B):
            assert unicodedata.combining(char) == 0 and code not in seconds
            assert unicodedata.normalize("NFC", char) == char


@pytest.mark.parametrize(
    "subject, key",
    [
        ("RE: FW: RE: Original Subject", "original subject"),
        ("Fwd:R: i:  Ciao\u00a0Mondo ", "ciao mondo"),
        (" RE: kept", "re: kept"),
        (None, ""),
    ],
)
def test_subject_key(texts, subject, key):
    assert rows(tx.with_subject_key(texts([subject]), "t", "k"), "k") == [(key,)]


def test_truncation_by_bytes(texts):
    values = ["A" * 1024, "A" * 1025, "A" * 1023 + "é", "A" * 1022 + "😀x", "A" * 1021 + "€€", "é" * 600, "x", ""]
    got = rows(texts(values).withColumn("c", tx.truncate_bytes(F.col("t"), 1)), "c")
    for value, (cut,) in zip(values, got):
        data = value.encode()
        kept = data[:1024].decode("utf-8", "ignore")
        assert cut == (value if len(data) <= 1024 else kept + tx.TRUNCATION_MARKER)


def test_blanks(texts):
    values = brute.random_texts(200, 3) + ["Line 1\n\n\n\n\nLine 2", "a \t\x1c\n b", "\u2003x\u2028"]
    got = rows(texts(values).withColumn("c", tx.tidy(F.col("t"))), "c")
    assert [c for (c,) in got] == [brute.tidy(v) for v in values]


def test_costly_steps_stand_once_in_the_plan(spark):
    df = spark.createDataFrame([("a <p>b</p>", "c")], "a STRING, b STRING")

    def times(column, step):
        return str(df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan()).count(step + "(")

    assert times(html.native_text(F.col("a")), "regexp_replace") == times(html.native_text(F.col("a")), "split") == 1
    assert times(body.merge_bodies(F.col("a"), F.col("b")), "array_distinct") == 1
