"""Reference SQL for the registered queries, in ANSI style for a second engine.

The statements state each result relationally (unnested matches, window sums, a
recursive fold), not by the array expressions the operators use.
"""

from __future__ import annotations

from limpida.functions.patterns import ALLOW_PATTERNS, PII_PATTERNS, REMOVAL_PATTERNS
from limpida.plans import mail_tables

SALT = "limpida-check-salt-0123456789"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def removal_regex(pattern) -> str:
    flags = "(?m)" if pattern.mode == "lines" else "(?is)"
    return lit(flags + pattern.regex.replace(r"\'", "'"))


def pii_regex(pattern) -> str:
    return lit("(?i)" + pattern.regex)


def mail(*columns: str) -> str:
    return f"({mail_tables.sql(*columns)})"


def source(text: str = "body_text") -> str:
    """``(doc_id, t)`` from a mail column."""
    return f"(SELECT doc_id, {text} AS t FROM {mail('doc_id', text)})"


def normalized(expr: str) -> str:
    unix = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"regexp_replace(nfc_normalize({unix}), '\p{{Zs}}', ' ', 'g')"


def squeezed(expr: str) -> str:
    lines = rf"regexp_replace({expr}, '(?m)[ \t\r\f\v]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({lines}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def stripped(expr: str) -> str:
    return rf"regexp_replace({expr}, '\A\s+|\s+\z', '', 'g')"


def tidied(expr: str) -> str:
    return stripped(squeezed(expr))


def matches(src: str, regex: str) -> str:
    """``(doc_id, k, value, span_start, span_end)`` of all matches."""
    start = (
        "list_sum(list_transform(g[1:k], lambda x: length(x)))"
        " + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0)"
    )
    return f"""(SELECT doc_id, k, m[k] AS value, CAST({start} AS BIGINT) AS span_start,
        CAST({start} + length(m[k]) AS BIGINT) AS span_end
      FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(t, {regex}) AS m, string_split_regex(t, {regex}) AS g
          FROM {src} AS src) AS cut WHERE len(m) > 0) AS numbered)"""


def canonical_ctes(src: str, patterns=REMOVAL_PATTERNS, tag: str = "") -> str:
    """CTEs ``s0 … sn`` (text after each stage), ``canon(doc_id, t)`` and ``sections``,
    all with ``tag`` behind their names."""
    ctes = [f"s{tag}0 AS MATERIALIZED (SELECT doc_id, {normalized('t')} AS t FROM {src} AS src)"]
    cuts = []
    for i, pattern in enumerate(patterns, 1):
        regex = removal_regex(pattern)
        ctes.append(
            f"s{tag}{i} AS MATERIALIZED (SELECT doc_id, regexp_replace(t, {regex}, chr(10), 'g') AS t"
            f" FROM s{tag}{i - 1})"
        )
        cuts.append(
            f"SELECT doc_id, {i} AS stage, {lit(pattern.type)} AS type, span_start, span_end, value,"
            f" CAST({pattern.confidence} AS DOUBLE) AS confidence"
            f" FROM {matches(f's{tag}{i - 1}', regex)} AS m{i}"
        )
    ctes.append(f"canon{tag} AS (SELECT doc_id, {tidied('t')} AS t FROM s{tag}{len(patterns)})")
    ctes.append(f"sections{tag} AS (" + " UNION ALL ".join(cuts) + ")")
    return ", ".join(ctes)


def raw_hit_ctes(src: str) -> str:
    """CTEs ``found`` (all matches) and ``hits`` (not on business numbers, in merge order)."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, {lit(p.type)} AS type, value, span_start, span_end"
        f" FROM {matches(src, pii_regex(p))} AS p{i}"
        for i, p in enumerate(PII_PATTERNS)
    )
    allowed = " UNION ALL ".join(
        f"SELECT doc_id, {lit(p.type)} AS type, value, span_start, span_end FROM {matches(src, pii_regex(p))} AS a{i}"
        for i, p in enumerate(ALLOW_PATTERNS)
    )
    return f"""found AS MATERIALIZED ({found}), allowed AS MATERIALIZED ({allowed}),
      hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, rank) AS k
        FROM found AS f WHERE NOT EXISTS (SELECT 1 FROM allowed AS a WHERE a.doc_id = f.doc_id
          AND a.span_start < f.span_end AND f.span_start < a.span_end))"""


_APART = "(f.span_end <= h.span_start OR h.span_end <= f.span_start)"
_TAKES = f"({_APART} OR h.span_end - h.span_start > f.span_end - f.span_start)"


def merged_ctes(src: str) -> str:
    """CTEs up to ``merged(doc_id, type, span_start, span_end, value)`` and ``redacted``."""
    fields = ("type", "span_start", "span_end", "value")
    chosen = ", ".join(f"CASE WHEN {_TAKES} THEN h.{c} ELSE f.{c} END" for c in fields)
    return f"""{raw_hit_ctes(src)},
      fold AS (
        SELECT doc_id, k, {", ".join(fields)}, FALSE AS out_done,
          {", ".join(f"{c} AS out_{c}" for c in fields)} FROM hits WHERE k = 1
        UNION ALL
        SELECT h.doc_id, h.k, {chosen}, {_APART}, {", ".join(f"f.{c}" for c in fields)}
        FROM fold AS f JOIN hits AS h ON h.doc_id = f.doc_id AND h.k = f.k + 1),
      last_hit AS (SELECT doc_id, max(k) AS k FROM hits GROUP BY doc_id),
      merged AS MATERIALIZED (
        SELECT doc_id, {", ".join(f"out_{c} AS {c}" for c in fields)} FROM fold WHERE out_done
        UNION ALL
        SELECT f.doc_id, {", ".join(f"f.{c}" for c in fields)} FROM fold AS f
          JOIN last_hit AS l ON l.doc_id = f.doc_id AND l.k = f.k),
      pieces AS (
        SELECT m.doc_id, m.span_start, m.span_end, substr(s.t,
            CAST(lag(m.span_end, 1, 0) OVER w + 1 AS BIGINT),
            CAST(m.span_start - lag(m.span_end, 1, 0) OVER w AS BIGINT)) || '[PII_' || m.type || ']' AS piece
        FROM merged AS m JOIN {src} AS s ON s.doc_id = m.doc_id
        WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.span_start)),
      heads AS (SELECT doc_id, string_agg(piece, '' ORDER BY span_start) AS head, max(span_end) AS e
        FROM pieces GROUP BY doc_id),
      redacted AS (SELECT s.doc_id, coalesce(h.head, '') || substr(s.t, CAST(coalesce(h.e, 0) + 1 AS BIGINT)) AS body
        FROM {src} AS s LEFT JOIN heads AS h ON h.doc_id = s.doc_id)"""


def pseudonym(expr: str) -> str:
    return f"left(sha256({expr} || {lit(SALT)}), 16)"


def emails_redacted(expr: str) -> str:
    return f"regexp_replace({expr}, {pii_regex(PII_PATTERNS[0])}, '[PII_EMAIL]', 'g')"


_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"),
    ("&middot;", "\xb7"),
    ("&amp;", "&"),
)


def html_text(expr: str) -> str:
    """Text of well-formed HTML: drop scripts and comments, spell out links, split at tags."""
    for name, char in _ENTITIES:
        expr = f"replace({expr}, {lit(name)}, {lit(char)})"
    dropped = (
        r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!doctype[^>]*>"
    )
    link = r'(?is)<a\s[^>]*?href="([^"#][^"]*)"[^>]*>([^<]*)</a>'
    expr = f"regexp_replace({expr}, {lit(dropped)}, '<x>', 'g')"
    expr = rf"regexp_replace({expr}, {lit(link)}, '<a>\2 (\1)</a>', 'g')"
    trim = r"regexp_replace(s, '\A[\s\x{a0}]+|[\s\x{a0}]+\z', '', 'g')"
    nodes = f"list_transform(string_split_regex({expr}, '<[^>]*>'), lambda s: {trim})"
    text = f"array_to_string(list_filter({nodes}, lambda s: s <> ''), chr(10))"
    return tidied(text)


def merged_body_ctes(src: str) -> str:
    """CTE ``bodies(doc_id, t)`` from ``src(doc_id, plain, html)``."""
    words = r"unnest(string_split_regex(lower({0}), '\s+'))"
    return f"""given AS MATERIALIZED (SELECT doc_id, plain, {html_text('html')} AS html_text FROM {src} AS src),
      plain_words AS (SELECT DISTINCT doc_id, w FROM
        (SELECT doc_id, {words.format('plain')} AS w FROM given) AS x WHERE w <> ''),
      html_words AS (SELECT DISTINCT doc_id, w FROM
        (SELECT doc_id, {words.format('html_text')} AS w FROM given) AS x WHERE w <> ''),
      n_plain AS (SELECT doc_id, count(*) AS n FROM plain_words GROUP BY doc_id),
      n_new AS (SELECT doc_id, count(*) AS n FROM html_words AS h WHERE NOT EXISTS
        (SELECT 1 FROM plain_words AS p WHERE p.doc_id = h.doc_id AND p.w = h.w) GROUP BY doc_id),
      bodies AS MATERIALIZED (SELECT g.doc_id, CASE
          WHEN p.n IS NULL AND html_text = '' THEN ''
          WHEN html_text = '' THEN plain
          WHEN p.n IS NULL THEN html_text
          WHEN coalesce(x.n, 0) > 0.2 * p.n THEN plain || chr(10) || chr(10) || html_text
          ELSE plain END AS t
        FROM given AS g LEFT JOIN n_plain AS p ON p.doc_id = g.doc_id
          LEFT JOIN n_new AS x ON x.doc_id = g.doc_id)"""


def document_ctes() -> str:
    """The whole job over the derived mail: CTEs up to ``redacted``, ``merged``, ``sections``."""
    src = f"(SELECT doc_id, body_text AS plain, body_html AS html FROM {mail('doc_id', 'body_text', 'body_html')})"
    return f"{merged_body_ctes(src)}, {canonical_ctes('bodies')}, {merged_ctes('canon')}"
