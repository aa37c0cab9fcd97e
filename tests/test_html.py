import random

from pyspark.sql import functions as F

from limpida.functions import html


def converted(texts, values):
    df = texts(values).withColumn("native", html.native_text(F.col("t")))
    df = html.with_html_text(df, "t", "c").orderBy("n")
    return [(r.c, r.native) for r in df.collect()]


GOLDEN = [
    ("<p>Hello</p><script>var a='<p>';</script><style>p{}</style><p>World</p>", "Hello\nWorld"),
    ('<a href="https://example.com">here</a>', "here (https://example.com)"),
    ('<a href="#top">up</a>', "up"),
    ('<a class="x" href="/a?b=1&c=2">q</a>', "q (/a?b=1&c=2)"),
    ("user&#64;example.com &amp; co", "user@example.com & co"),
    ("&lt;b&gt;bold&lt;/b&gt; text", "bold\ntext"),
    ("a<noscript>hidden <b>x</b></noscript>b", "a\nb"),
    ("a<!-- c -->b", "a\nb"),
    ('<a href="u">one <b>two</b> three</a>', "one two three (u)"),
    ("<p>un   due\n\n\n\n\ntre</p>", "un due\n\ntre"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("&nbsp;&egrave; caf&eacute;", "è café"),
    ("", ""),
    ("   ", ""),
    (None, ""),
    ("<ruby>x<rt>y</rt></ruby>", "x"),
    ("<p>unclosed <b>bold", "unclosed\nbold"),
    ("<title>T &amp; t</title><meta name='x'><p title=\"a>b\">v</p>", "T & t\nv"),
]


def test_golden(texts):
    got = converted(texts, [g[0] for g in GOLDEN])
    assert [c for c, _ in got] == [g[1] for g in GOLDEN]


PIECES = (
    "<p>", "</p>", "<b>", "</b>", '<div class="x">', "</div>", "<br>", "<br/>", "<!-- c -->", "<!-- a-b -->", "text", " ",
    "\n", "  two ", "&amp;", "&lt;", "&gt;", "&copy;", "&quot;", "&nbsp;", "& ", "<a href=\"/x\">link</a>", "<a>n</a>",
    "<a href='y'>z</a>", '<a href="#t">t</a>', '<a id="i" href="h" class="c"> sp </a>', "<script>if(a<b){}</script>",
    "<style>p{}</style>", "<meta charset=\"utf-8\">", "<img src=\"i.png\">", "<!DOCTYPE html>", "<td nowrap>", "è",
    "<a href=\"u\">", "</a>", "<noscript>", "</noscript>", "&#233;", "<", ">", "<x-y>", "AT&T", "<pre> p </pre>", "&amp;lt;",
)


def test_native_way_equals_the_parser_wherever_it_is_taken(texts):
    rng = random.Random(5)
    values = ["".join(rng.choice(PIECES[:32]) for _ in range(rng.randint(1, 12))) for _ in range(900)]
    values += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(900)]
    got = converted(texts, values)
    native = 0
    for value, (_, text) in zip(values, got):
        if text is not None:
            native += 1
            assert text == html._parse(value), repr(value)
    assert native > 700


def test_markup_the_parser_stumbled_over_gives_its_text(texts):
    long = "1" * 5000
    cases = [
        ("<p>one</p><![x>two", "one\ntwo"),
        ("one<![<b>two</b>", "one\ntwo"),
        ("one<![ if !IE]>two<![endif]>", "one\ntwo"),
        (f"n &#{long}; m", "n � m"),
        (f"n &amp;#{long}; m", "n � m"),
        ("n &#" + "0" * 5000 + "65; m", "n A m"),
        (f'<a href="u&amp;#{long};">t</a>', "t (u�)"),
        (f"<![x>&#{long}; m", "� m"),
    ]
    assert [c for c, _ in converted(texts, [c[0] for c in cases])] == [c[1] for c in cases]


def test_markup_that_cannot_be_read_is_not_empty(texts, monkeypatch):
    failing = F.udf(lambda markup: None, "string").asNondeterministic()
    monkeypatch.setattr(html, "_parse_batch", failing)
    assert [c for c, _ in converted(texts, ["a < b", "<p>a</p>", "", " ", None])] == [None, "a", "", "", ""]

    def stumble(parser, data):
        raise KeyError(data)

    monkeypatch.setattr(html._TextNodes, "handle_data", stumble)
    assert html._parse("a < b") is None and html._parse("<p>") == ""
