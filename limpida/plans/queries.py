"""Registered queries: every operator over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpida.functions import body, headers as hd, html, mime, pii, spans, text as tx
from limpida.functions.patterns import ALLOW_PATTERNS, PII_PATTERNS, REMOVAL_PATTERNS
from limpida.operators import canonical, compare, dedup, incremental, masking, names, order, reports, validate
from limpida.options import CleaningOptions, PiiMode
from limpida.plans import documents as docs
from limpida.plans import mail_tables as mt
from limpida.plans import replay
from limpida.plans import oracle as sql
from limpida.session import scratch_dir, ship_package, stored
from limpida.sources import messages as src
from limpida.sources import sinks
from limpida.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

OPTIONS = CleaningOptions(pii_salt=sql.SALT)
DETECT_ONLY = replace(OPTIONS, pii_mode=PiiMode.DETECT_ONLY)
DISABLED = replace(OPTIONS, pii_mode=PiiMode.DISABLED)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def add(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship_package(spark), sf_dir)

        QUERIES[name] = shipped
        if statement is not None:
            ORACLE[name] = statement
        return run

    return add


def _expr(text: str) -> Column:
    return spans.once(F.expr(text))


def digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)


# ---------------------------------------------------------------- text functions


@query(
    "line_ends",
    f"""SELECT doc_id, sha256(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest
    FROM {sql.source()} AS src""",
)
def line_ends(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "body_text")
    return df.select("doc_id", F.sha2(tx.unix_line_ends(F.col("body_text")), 256).alias("digest"))


_DECOMPOSED = "replace(replace(text, 'é', 'é'), 'ñ', 'ñ')"


@query(
    "canonical_composition",
    f"SELECT doc_id, sha256(nfc_normalize({_DECOMPOSED})) AS digest FROM documents",
)
def canonical_composition(spark, sf):
    df = mt.table(spark, sf, "documents").selectExpr("doc_id", f"{_DECOMPOSED} AS t")
    return tx.with_nfc(df, "t", "t").select("doc_id", digest("t").alias("digest"))


_EXOTIC = "replace(replace(text, ', ', ', '), '. ', '.  ')"


@query(
    "plain_spaces",
    rf"SELECT doc_id, sha256(regexp_replace({_EXOTIC}, '\p{{Zs}}', ' ', 'g')) AS digest FROM documents",
)
def plain_spaces(spark, sf):
    df = mt.table(spark, sf, "documents").selectExpr("doc_id", f"{_EXOTIC} AS t")
    return df.select("doc_id", F.sha2(tx.plain_spaces(F.col("t")), 256).alias("digest"))


_RAGGED = "chr(10) || ' ' || replace(replace(text, '. ', '.   '), chr(10), '  ' || chr(9) || chr(10) || chr(10) || chr(10)) || '  '"


@query(
    "tidy_blanks",
    f"SELECT doc_id, sha256({sql.tidied(_RAGGED)}) AS digest FROM documents",
)
def tidy_blanks(spark, sf):
    df = mt.table(spark, sf, "documents").selectExpr("doc_id", f"{_RAGGED} AS t")
    return df.select("doc_id", F.sha2(tx.tidy(F.col("t")), 256).alias("digest"))


@query(
    "html_blanks",
    f"SELECT doc_id, sha256({sql.squeezed(_RAGGED)}) AS digest FROM documents",
)
def html_blanks(spark, sf):
    df = mt.table(spark, sf, "documents").selectExpr("doc_id", f"{_RAGGED} AS t")
    return df.select("doc_id", F.sha2(tx.squeeze_blanks(F.col("t")), 256).alias("digest"))


@query(
    "subject_key",
    rf"""SELECT doc_id, trim(lower(regexp_replace(subject, '^(?i)(?:(?:re|fw|fwd|r|i):\s*)+', ''))) AS subject_key
    FROM {sql.mail("doc_id", "subject")} AS m""",
)
def subject_key(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "subject")
    return tx.with_subject_key(df, "subject", "subject_key").select("doc_id", "subject_key")


@query(
    "truncate_bytes",
    """SELECT doc_id, length(text) <= 1024 AND octet_length(encode(text)) <= 1024 AS untouched,
      CASE WHEN octet_length(encode(text)) <= 1024 THEN text ELSE
        list_aggregate(list_filter(list_transform(range(1, 1025), lambda n: left(text, n)),
          lambda p: octet_length(encode(p)) <= 1024), 'last')
        || chr(10) || chr(10) || '[TEXT TRUNCATED FOR MEMORY SAFETY]' END AS cut
    FROM documents""",
)
def truncate_bytes(spark, sf):
    df = mt.table(spark, sf, "documents")
    return df.select(
        "doc_id",
        (F.octet_length("text") <= 1024).alias("untouched"),
        tx.truncate_bytes(F.col("text"), 1).alias("cut"),
    )


@query("truncate_chars", "SELECT doc_id, left(text, 2000) AS cut FROM documents")
def truncate_chars(spark, sf):
    df = mt.table(spark, sf, "documents")
    return df.select("doc_id", tx.truncate_chars(F.col("text"), 2000).alias("cut"))


# ---------------------------------------------------------------- canonical text


def _register_cut(number: int, pattern) -> None:
    """One query per removal pattern: text left, number and total length of cuts."""
    name = f"cut_{pattern.type}" + ("_2" if f"cut_{pattern.type}" in QUERIES else "")
    both = (
        f"(SELECT doc_id, body_text || chr(10) || chr(10) || marked_text AS t"
        f" FROM {sql.mail('doc_id', 'body_text', 'marked_text')})"
    )
    regex = sql.removal_regex(pattern)

    @query(
        name,
        f"""SELECT doc_id, sha256(regexp_replace(t, {regex}, chr(10), 'g')) AS digest,
          len(regexp_extract_all(t, {regex})) AS n_cuts,
          CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, {regex}), lambda x: length(x))), 0) AS BIGINT) AS n_chars
        FROM {both} AS src""",
    )
    def cut(spark, sf):
        df = mt.mail(spark, sf, "doc_id", "body_text", "marked_text").select(
            "doc_id", F.concat("body_text", F.lit("\n\n"), "marked_text").alias("t")
        )
        df = canonical.remove_sections(df, "t", (pattern,), "cuts")
        return df.select(
            "doc_id",
            digest("t").alias("digest"),
            F.size("cuts").cast("long").alias("n_cuts"),
            F.expr("aggregate(cuts, 0L, (n, c) -> n + c.span_end - c.span_start)").alias("n_chars"),
        )


for _number, _pattern in enumerate(REMOVAL_PATTERNS):
    _register_cut(_number, _pattern)


def _canonical(spark, sf, text="body_text", patterns=REMOVAL_PATTERNS, options=None):
    df = mt.mail(spark, sf, "doc_id", text)
    return canonical.canonicalize(df, text, "canonical", "sections", patterns, options)


def _canonical_sql(text: str, patterns=REMOVAL_PATTERNS) -> str:
    return (
        f"WITH {sql.canonical_ctes(sql.source(text), patterns)}"
        " SELECT doc_id, t AS canonical FROM canon"
    )


@query("canonical_text", _canonical_sql("body_text"))
def canonical_text(spark, sf):
    return _canonical(spark, sf).select("doc_id", "canonical")


@query("canonical_text_marked", _canonical_sql("marked_text"))
def canonical_text_marked(spark, sf):
    return _canonical(spark, sf, "marked_text").select("doc_id", "canonical")


_NO_QUOTES = tuple(p for p in REMOVAL_PATTERNS if p.group != "quotes")
_NO_SIGNATURES = tuple(p for p in REMOVAL_PATTERNS if p.group != "signatures")


@query("canonical_keep_quotes", _canonical_sql("body_text", _NO_QUOTES))
def canonical_keep_quotes(spark, sf):
    options = replace(OPTIONS, remove_quotes=False)
    df = _canonical(spark, sf, patterns=options.active_removal_patterns())
    return df.select("doc_id", "canonical")


@query("canonical_keep_signatures", _canonical_sql("body_text", _NO_SIGNATURES))
def canonical_keep_signatures(spark, sf):
    options = replace(OPTIONS, remove_signatures=False)
    df = _canonical(spark, sf, patterns=options.active_removal_patterns())
    return df.select("doc_id", "canonical")


def _sections_sql(text: str) -> str:
    return f"""WITH {sql.canonical_ctes(sql.source(text))}
    SELECT doc_id, CAST(stage AS INT) AS stage, type, CAST(span_start AS INT) AS span_start,
      CAST(span_end AS INT) AS span_end, left(value, 100) AS content_preview, confidence FROM sections"""


@query("removed_sections", _sections_sql("body_text"))
def removed_sections(spark, sf):
    return canonical.sections_table(_canonical(spark, sf), "sections", "doc_id")


@query("removed_sections_marked", _sections_sql("marked_text"))
def removed_sections_marked(spark, sf):
    return canonical.sections_table(_canonical(spark, sf, "marked_text"), "sections", "doc_id")


@query(
    "conversation_text",
    f"""WITH {sql.canonical_ctes("(SELECT conv_id * 1000 + turn AS doc_id, chr(62) || ' ' || text || chr(10) || text AS t FROM conversations)")}
    SELECT doc_id, t AS canonical FROM canon""",
)
def conversation_text(spark, sf):
    df = mt.table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS doc_id", "chr(62) || ' ' || text || chr(10) || text AS t"
    )
    df = canonical.canonicalize(df, "t", "canonical", "sections", REMOVAL_PATTERNS)
    return df.select("doc_id", "canonical")


# ---------------------------------------------------------------- personal data


def _hits_table(df: DataFrame, hits: str = "hits", *keys: str) -> DataFrame:
    one = df.select(*(keys or ("doc_id",)), F.explode(hits).alias("h"))
    return one.select(
        *(keys or ("doc_id",)),
        F.col("h.type").alias("type"),
        F.col("h.span_start").cast("long").alias("span_start"),
        F.col("h.span_end").cast("long").alias("span_end"),
        pii.pseudonym("h.value", sql.SALT).alias("hash"),
    )


_HIT_COLUMNS = f"doc_id, type, span_start, span_end, {sql.pseudonym('value')} AS hash"


def _register_pii(number: int, pattern) -> None:
    @query(
        f"pii_{pattern.type.lower()}",
        f"SELECT {_HIT_COLUMNS} FROM (SELECT doc_id, {sql.lit(pattern.type)} AS type, value, span_start,"
        f" span_end FROM {sql.matches(sql.source(), sql.pii_regex(pattern))} AS m) AS x",
    )
    def found(spark, sf):
        df = mt.mail(spark, sf, "doc_id", "body_text")
        only = replace(OPTIONS, pii_patterns=(pattern,), allow_patterns=())
        return _hits_table(df.withColumn("hits", _expr(pii.regex_hits_sql("body_text", only))))


for _number, _pii in enumerate(PII_PATTERNS):
    _register_pii(_number, _pii)


@query(
    "pii_all_regex",
    f"""WITH {sql.raw_hit_ctes(sql.source())} SELECT {_HIT_COLUMNS} FROM hits""",
)
def pii_all_regex(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "body_text")
    return _hits_table(df.withColumn("hits", _expr(pii.regex_hits_sql("body_text", OPTIONS))))


@query(
    "allowed_numbers",
    " UNION ALL ".join(
        f"SELECT doc_id, {sql.lit(p.type)} AS type, value, span_start, span_end"
        f" FROM {sql.matches(sql.source('marked_text'), sql.pii_regex(p))} AS m"
        for p in ALLOW_PATTERNS
    ),
)
def allowed_numbers(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "marked_text")
    lists = (
        f"transform({spans.match_spans('marked_text', p.java)}, m -> named_struct('type', {spans.quote(p.type)},"
        " 'value', m.value, 'span_start', CAST(m.span_start AS BIGINT), 'span_end', CAST(m.span_end AS BIGINT)))"
        for p in ALLOW_PATTERNS
    )
    return df.select("doc_id", F.inline(F.expr(f"concat({', '.join(lists)})")))


def _detected(spark, sf, text="body_text", options=OPTIONS):
    df = mt.mail(spark, sf, "doc_id", text)
    return pii.with_hits(df, text, options, "hits")


@query(
    "pii_merged",
    f"WITH RECURSIVE {sql.merged_ctes(sql.source())} SELECT {_HIT_COLUMNS} FROM merged",
)
def pii_merged(spark, sf):
    return _hits_table(_detected(spark, sf))


@query(
    "pii_merged_marked",
    f"WITH RECURSIVE {sql.merged_ctes(sql.source('marked_text'))} SELECT {_HIT_COLUMNS} FROM merged",
)
def pii_merged_marked(spark, sf):
    return _hits_table(_detected(spark, sf, "marked_text"))


@query(
    "redacted_text",
    f"WITH RECURSIVE {sql.merged_ctes(sql.source())} SELECT doc_id, body FROM redacted",
)
def redacted_text(spark, sf):
    return _detected(spark, sf).select("doc_id", pii.redact("body_text", "hits").alias("body"))


@query(
    "redact_documents",
    f"""WITH RECURSIVE {sql.merged_ctes("(SELECT doc_id, text AS t FROM documents)")},
      counts AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id)
    SELECT r.doc_id, body, coalesce(n, 0) AS n_entities FROM redacted AS r
      LEFT JOIN counts AS c ON c.doc_id = r.doc_id""",
)
def redact_documents(spark, sf):
    df = pii.with_hits(mt.table(spark, sf, "documents"), "text", OPTIONS, "hits")
    return df.select(
        "doc_id",
        pii.redact("text", "hits").alias("body"),
        F.size("hits").cast("long").alias("n_entities"),
    )


@query(
    "detect_only",
    f"""WITH RECURSIVE {sql.merged_ctes(sql.source())}
    SELECT doc_id, type, {sql.pseudonym('value')} AS original_hash, value AS redacted,
      CAST(span_start AS INT) AS span_start, CAST(span_end AS INT) AS span_end,
      CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS detection_method FROM merged""",
)
def detect_only(spark, sf):
    df = _detected(spark, sf, options=DETECT_ONLY)
    return df.select("doc_id", F.inline(pii.entities("hits", DETECT_ONLY)))


@query(
    "pseudonyms",
    f"SELECT doc_id, {sql.pseudonym('from_addr')} AS sender FROM {sql.mail('doc_id', 'from_addr')} AS m",
)
def pseudonyms(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "from_addr")
    return df.select("doc_id", pii.pseudonym("from_addr", sql.SALT).alias("sender"))


@query(
    "pii_modes",
    f"""WITH RECURSIVE {sql.merged_ctes(sql.source())},
      counts AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id)
    SELECT r.doc_id, sha256(body) AS redact_digest, sha256(t) AS detect_digest, sha256(t) AS disabled_digest,
      coalesce(n, 0) AS redact_n, coalesce(n, 0) AS detect_n, CAST(0 AS BIGINT) AS disabled_n
    FROM redacted AS r JOIN {sql.source()} AS s ON s.doc_id = r.doc_id
      LEFT JOIN counts AS c ON c.doc_id = r.doc_id""",
)
def pii_modes(spark, sf):
    df = _detected(spark, sf)
    return df.select(
        "doc_id",
        F.sha2(pii.redact("body_text", "hits"), 256).alias("redact_digest"),
        digest("body_text").alias("detect_digest"),
        digest("body_text").alias("disabled_digest"),
        F.size(pii.entities("hits", OPTIONS)).cast("long").alias("redact_n"),
        F.size(pii.entities("hits", DETECT_ONLY)).cast("long").alias("detect_n"),
        F.size(pii.entities(pii.NO_HITS, DISABLED)).cast("long").alias("disabled_n"),
    )


@query(
    "redacted_headers",
    f"""SELECT doc_id, {sql.emails_redacted('from_addr')} AS "from", {sql.emails_redacted('to_header')} AS "to",
      subject, 'limpida' AS x_mailer, from_addr AS x_original FROM {sql.mail('doc_id', 'from_addr', 'to_header', 'subject')} AS m""",
)
def redacted_headers(spark, sf):
    df = mt.messages(spark, sf).withColumn(
        "headers",
        F.map_concat("headers", F.create_map(F.lit("x-original"), F.col("from_addr"))),
    )
    df = docs.with_redacted_headers(df, OPTIONS, "h")
    return df.select(
        "doc_id",
        F.col("h")["from"].alias("from"),
        F.col("h")["to"].alias("to"),
        F.col("h")["subject"].alias("subject"),
        F.col("h")["x-mailer"].alias("x_mailer"),
        F.col("h")["x-original"].alias("x_original"),
    )


@query(
    "header_columns",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[PII_EMAIL]' ELSE source END AS sender,
      array_to_string(list_filter(list_transform(string_split(source || ' , ,' || lang, ','), lambda a: trim(a)),
        lambda a: a <> ''), '|') AS recipients, '' AS subject
    FROM documents""",
)
def header_columns(spark, sf):
    df = mt.table(spark, sf, "documents").withColumn(
        "h",
        F.when(
            F.col("doc_id") % 3 == 0,
            F.create_map(F.lit("to"), F.concat("source", F.lit(" , ,"), "lang")),
        ).otherwise(
            F.create_map(
                F.lit("from"), F.col("source"), F.lit("to"), F.concat("source", F.lit(" , ,"), "lang")
            )
        ),
    )
    h = F.col("h")
    return df.select(
        "doc_id",
        hd.header(h, "from", docs.UNKNOWN_SENDER).alias("sender"),
        F.concat_ws("|", hd.split_addresses(hd.header(h, "to"))).alias("recipients"),
        hd.header(h, "subject").alias("subject"),
    )


# Names: the dictionary comes from the tables, the longer words that open a text of
# ``benchmark``; passages of these texts occur in ``documents``.
_DICTIONARY = r"""SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+)', 1) AS name,
  CASE WHEN item_id % 2 = 0 THEN 'NAME' ELSE 'ORG' END AS label FROM {0}
  WHERE length(regexp_extract(text, '^([A-Za-z]+)', 1)) >= 4
  UNION ALL SELECT 'Mario', 'NAME'"""


def _dictionary(spark, sf) -> DataFrame:
    mt.table(spark, sf, "benchmark").createOrReplaceTempView("limpida_benchmark")
    return spark.sql(_DICTIONARY.format("limpida_benchmark"))


_NAMES_SQL = rf"""WITH dict AS (
    SELECT lower(name) AS name, min(label) AS label FROM ({_DICTIONARY.format('benchmark')}) AS d GROUP BY 1),
  cut AS (SELECT doc_id, (SELECT list(name) FROM dict) AS names, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS m,
    string_split_regex(t, '[\p{{L}}\p{{N}}_]+') AS g FROM {sql.source()} AS src),
  numbered AS (SELECT doc_id, m, g,
    unnest(list_filter(range(1, len(m) + 1), lambda i: list_contains(names, lower(m[i])))) AS k FROM cut),
  words AS (SELECT doc_id, m[k] AS w, CAST(list_sum(list_transform(g[1:k], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM numbered),
  hits AS (SELECT doc_id, w, s, label, least(0.9, 0.7 + length(w) * 0.01) AS confidence
    FROM words JOIN dict ON dict.name = lower(w)
    WHERE left(w, 1) <> lower(left(w, 1)) AND length(w) >= 3)
  SELECT doc_id, label AS type, s AS span_start, s + length(w) AS span_end, {sql.pseudonym('w')} AS hash
  FROM hits WHERE confidence >= 0.75"""


@query("names_by_literals", _NAMES_SQL)
def names_by_literals(spark, sf):
    finder = names.dictionary_finder(_dictionary(spark, sf))
    df = mt.mail(spark, sf, "doc_id", "body_text").withColumn("found", finder(F.col("body_text")))
    return _hits_table(df.withColumn("hits", _expr(pii.name_hits_sql("found", OPTIONS))))


@query("names_by_join", _NAMES_SQL)
def names_by_join(spark, sf):
    df = mt.mail(spark, sf, "doc_id", "body_text")
    df = names.find_by_join(df, "doc_id", {"found": "body_text"}, _dictionary(spark, sf))
    return _hits_table(df.withColumn("hits", _expr(pii.name_hits_sql("found", OPTIONS))))


def _capitals(text: str):
    """Stand-in for a model: words of twelve or more letters in front of a full stop."""
    import re

    return [("PER", m.start(), m.end()) for m in re.finditer(r"[A-Za-z]{12,}(?=\.)", text)]


@query(
    "names_by_model",
    f"""SELECT doc_id, 'NAME' AS type, span_start, span_end - 1 AS span_end,
      {sql.pseudonym("left(value, length(value) - 1)")} AS hash
    FROM {sql.matches(sql.source(), "'[A-Za-z]{12,}[.]'")} AS m""",
)
def names_by_model(spark, sf):
    finder = names.model_finder(_capitals)
    df = mt.mail(spark, sf, "doc_id", "body_text").withColumn("found", finder(F.col("body_text")))
    return _hits_table(df.withColumn("hits", _expr(pii.name_hits_sql("found", OPTIONS))))


_MASK_SCHEMA = "STRUCT<token: STRING, k: STRING, inner: STRUCT<Password: STRING, note: STRING>>"


@query(
    "masked_fields",
    """SELECT event_id, '[REDACTED]' AS email, event_type AS kind, '[REDACTED]' AS map_phone, event_type AS map_kind,
      '{"token":"[REDACTED]","k":"' || event_type || '","inner":{"Password":"[REDACTED]","note":"n"}}' AS payload
    FROM events""",
)
def masked_fields(spark, sf):
    from pyspark.sql.types import _parse_datatype_string

    df = mt.table(spark, sf, "events").select(
        "event_id",
        F.col("props").alias("email"),
        F.create_map(F.lit("Phone"), F.col("props"), F.lit("kind"), F.col("event_type")).alias("h"),
        F.struct(F.struct(F.col("event_type").alias("kind")).alias("deep")).alias("s"),
        F.to_json(
            F.struct(
                F.col("props").alias("token"),
                F.col("event_type").alias("k"),
                F.struct(F.lit("x").alias("Password"), F.lit("n").alias("note")).alias("inner"),
            )
        ).alias("payload"),
    )
    masked = masking.mask_sensitive(df)
    return masked.select(
        "event_id",
        "email",
        F.col("s.deep.kind").alias("kind"),
        F.col("h")["Phone"].alias("map_phone"),
        F.col("h")["kind"].alias("map_kind"),
        masking.mask_json(F.col("payload"), _parse_datatype_string(_MASK_SCHEMA)).alias("payload"),
    )


# JSON of mixed shapes: nested objects, lists, and a text that is cut off.
_ANY_JSON = """CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '{"Token":' || props || ',"kind":"' || event_type || '"}'
  WHEN 1 THEN '{"a":{"b":{"password":' || CAST(event_id AS STRING) || ',"n":' || CAST(event_id AS STRING) || '}},"l":[{"token":1}]}'
  WHEN 2 THEN '[' || CAST(event_id AS STRING) || ',{"secret":"' || event_type || '"}]' ELSE '{"email":"' || event_type END"""


@query(
    "masked_any_json",
    """SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '{"Token":"[REDACTED]","kind":"' || event_type || '"}'
      WHEN 1 THEN '{"a":{"b":{"n":' || CAST(event_id AS STRING) || ',"password":"[REDACTED]"}},"l":[{"token":1}]}'
      WHEN 2 THEN '[' || CAST(event_id AS STRING) || ',{"secret":"' || event_type || '"}]' ELSE '"[REDACTED]"' END AS masked FROM events""",
)
def masked_any_json(spark, sf):
    df = mt.table(spark, sf, "events").select("event_id", F.expr(_ANY_JSON).alias("payload"))
    return masking.with_masked_json(df, "payload", "masked").select("event_id", "masked")


# ---------------------------------------------------------------- HTML and bodies


@query("page_text", f"SELECT page_id, {sql.html_text('html')} AS page_text FROM pages")
def page_text(spark, sf):
    df = html.with_html_text(mt.table(spark, sf, "pages"), "html", "page_text")
    return df.select("page_id", "page_text")


@query("mail_html_text", f"SELECT doc_id, {sql.html_text('body_html')} AS page_text FROM {sql.mail('doc_id', 'body_html')} AS m")
def mail_html_text(spark, sf):
    df = html.with_html_text(mt.mail(spark, sf, "doc_id", "body_html"), "body_html", "page_text")
    return df.select("doc_id", "page_text")


@query(
    "merged_bodies",
    f"""WITH {sql.merged_body_ctes(f"(SELECT doc_id, body_text AS plain, body_html AS html FROM {sql.mail('doc_id', 'body_text', 'body_html')})")}
    SELECT doc_id, t AS merged_body FROM bodies""",
)
def merged_bodies(spark, sf):
    df = docs.with_merged_body(docs.with_bodies(mt.messages(spark, sf)))
    return df.select("doc_id", F.when(F.isnull("parse_error"), F.col("merged_body")).alias("merged_body"))


_COMMON = "'the of and in is that de la le les un der die und den el los que'"


@query(
    "word_sets",
    rf"""SELECT doc_id, count(DISTINCT w) AS n_words,
      count(DISTINCT w) FILTER (WHERE NOT list_contains(string_split({_COMMON}, ' '), w)) AS n_uncommon
    FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) AS d
    WHERE w <> '' GROUP BY doc_id""",
)
def word_sets(spark, sf):
    words, common = body.word_set(F.col("text")), body.word_set(F.expr(_COMMON))
    return mt.table(spark, sf, "documents").select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_except(words, common)).cast("long").alias("n_uncommon"),
    )


# Raw messages built from the tables: a nested multipart with an attachment, a single
# part with another charset, and one part with folded and encoded headers.
_RAW = r"""concat(
  'Message-ID: <', CAST(doc_id AS STRING), '@', source, '>', chr(13), chr(10),
  'From: =?utf-8?B?TWFyw61h?= <user', CAST(doc_id AS STRING), '@', source, '.example.com>', chr(13), chr(10),
  'To: a@example.com,', chr(13), chr(10), ' b@example.com', chr(13), chr(10),
  'Received: one', chr(13), chr(10), 'Received: two', chr(13), chr(10),
  'Subject: =?iso-8859-1?Q?Fattura_n=B0?= ', CAST(doc_id AS STRING), chr(13), chr(10),
  'MIME-Version: 1.0', chr(13), chr(10),
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat(
      'Content-Type: multipart/mixed; boundary=BB', chr(13), chr(10), chr(13), chr(10),
      '--BB', chr(13), chr(10), 'Content-Type: multipart/alternative; boundary=CC', chr(13), chr(10), chr(13), chr(10),
      '--CC', chr(13), chr(10), 'Content-Type: text/plain; charset=utf-8', chr(13), chr(10),
      'Content-Transfer-Encoding: base64', chr(13), chr(10), chr(13), chr(10), base64(encode(text, 'UTF-8')), chr(13), chr(10),
      '--CC', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10),
      'Content-Transfer-Encoding: base64', chr(13), chr(10), chr(13), chr(10),
      base64(encode(concat('<p>', text, '</p>'), 'UTF-8')), chr(13), chr(10), '--CC--', chr(13), chr(10),
      '--BB', chr(13), chr(10), 'Content-Type: text/plain; charset=utf-8', chr(13), chr(10),
      'Content-Disposition: attachment; filename=x.txt', chr(13), chr(10), chr(13), chr(10), 'secret', chr(13), chr(10),
      '--BB', chr(13), chr(10), 'Content-Type: text/plain; charset=utf-8', chr(13), chr(10),
      'Content-Transfer-Encoding: base64', chr(13), chr(10), chr(13), chr(10), base64(encode('fine', 'UTF-8')), chr(13), chr(10),
      '--BB--', chr(13), chr(10))
    WHEN 1 THEN concat(
      'Content-Type: text/html; charset=utf-8', chr(13), chr(10),
      'Content-Transfer-Encoding: base64', chr(13), chr(10), chr(13), chr(10), base64(encode(concat('<div>', text, '</div>'), 'UTF-8')))
    ELSE concat(
      'Content-Type: text/plain; charset=utf-8', chr(13), chr(10),
      'Content-Transfer-Encoding: base64', chr(13), chr(10), chr(13), chr(10), base64(encode(text, 'UTF-8'))) END)"""


def _raw(spark, sf) -> DataFrame:
    df = mt.table(spark, sf, "documents")
    return df.withColumn("raw_bytes", F.encode(F.expr(_RAW), "UTF-8"))


_PLAIN = "CASE doc_id % 3 WHEN 0 THEN text || chr(10) || chr(10) || 'fine' WHEN 1 THEN '' ELSE text END"
_HTML = "CASE doc_id % 3 WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN '<div>' || text || '</div>' ELSE '' END"


@query(
    "message_parts",
    """SELECT doc_id, p.part_no, p.content_type, p.is_attachment, p.content FROM (SELECT doc_id, unnest(CASE doc_id % 3
      WHEN 0 THEN [{'part_no': 0, 'content_type': 'text/plain', 'is_attachment': false, 'content': text},
        {'part_no': 1, 'content_type': 'text/html', 'is_attachment': false, 'content': '<p>' || text || '</p>'},
        {'part_no': 2, 'content_type': 'text/plain', 'is_attachment': true, 'content': ''},
        {'part_no': 3, 'content_type': 'text/plain', 'is_attachment': false, 'content': 'fine'}]
      WHEN 1 THEN [{'part_no': 0, 'content_type': 'text/html', 'is_attachment': false, 'content': '<div>' || text || '</div>'}]
      ELSE [{'part_no': 0, 'content_type': 'text/plain', 'is_attachment': false, 'content': text}] END) AS p
    FROM documents) AS x""",
)
def message_parts(spark, sf):
    df = _raw(spark, sf).withColumn("p", mime.parse_message("raw_bytes"))
    return df.select("doc_id", F.inline("p.parts"))


@query(
    "message_bodies",
    f"""SELECT doc_id, {_PLAIN} AS plain_body, {_HTML} AS html_body FROM documents""",
)
def message_bodies(spark, sf):
    df = _raw(spark, sf).withColumn("p", mime.parse_message("raw_bytes"))
    return df.select(
        "doc_id",
        mime.body_of(F.col("p.parts"), "text/plain").alias("plain_body"),
        mime.body_of(F.col("p.parts"), "text/html").alias("html_body"),
    )


@query(
    "body_source",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN (CASE WHEN length(text) >= 2000 THEN 'truncated' ELSE 'given' END)
        ELSE 'raw' END AS body_source,
      CASE WHEN doc_id % 4 = 3 THEN left(text, 2000) ELSE {_PLAIN} END AS plain_body FROM documents""",
)
def body_source(spark, sf):
    df = _raw(spark, sf).select(
        "doc_id",
        F.left("text", F.lit(2000)).alias("body_text"),
        F.lit("").alias("body_html"),
        (F.length("text") >= 2000).alias("body_truncated"),
        F.when(F.col("doc_id") % 4 == 3, F.lit(b"")).otherwise(F.col("raw_bytes")).alias("raw_bytes"),
    )
    return docs.with_bodies(df).select("doc_id", "body_source", "plain_body")


@query(
    "header_maps",
    """SELECT doc_id, '<' || doc_id || '@' || source || '>' AS message_id,
      'María <user' || doc_id || '@' || source || '.example.com>' AS sender, 'a@example.com, b@example.com' AS recipients,
      'one; two' AS received, 'Fattura n° ' || doc_id AS subject FROM documents""",
)
def header_maps(spark, sf):
    df = hd.with_header_map(_raw(spark, sf), hd.header_block(F.col("raw_bytes")), "h")
    h = F.col("h")
    return df.select(
        "doc_id",
        h["message-id"].alias("message_id"),
        h["from"].alias("sender"),
        h["to"].alias("recipients"),
        h["received"].alias("received"),
        h["subject"].alias("subject"),
    )


# ---------------------------------------------------------------- sources and sinks


@query(
    "message_files",
    """SELECT doc_id, '<' || doc_id || '@' || source || '>' AS message_id, 'Fattura n° ' || doc_id AS subject,
      'a@example.com|b@example.com' AS recipients,
      CASE doc_id % 3 WHEN 1 THEN '<div>' || text || '</div>' ELSE text END AS body_text
    FROM documents""",
)
def message_files(spark, sf):
    files = _raw(spark, sf).select(
        F.col("doc_id").cast("string").alias("path"),
        F.lit("2026-02-17 10:00:00").cast("timestamp").alias("modificationTime"),
        F.octet_length("raw_bytes").cast("long").alias("length"),
        F.col("raw_bytes").alias("content"),
    )
    m = src.files_to_messages(files)
    return m.select(
        F.col("uid").cast("long").alias("doc_id"),
        "message_id",
        "subject",
        F.concat_ws("|", "to_addrs").alias("recipients"),
        "body_text",
    )


@query(
    "ingestion_json",
    """SELECT CAST(doc_id AS STRING) AS uid, '7' AS uidvalidity, 'INBOX' AS mailbox,
      CASE WHEN doc_id % 5 = 0 THEN 'unknown@unknown.com' ELSE source || '@example.com' END AS from_addr,
      'a@example.com|b@example.com' AS recipients, '(no subject)' AS subject, '' AS date,
      sha256(text) AS digest, length(text) >= 2000 AS body_truncated, source AS x_source,
      '<' || doc_id || '>' AS message_id
    FROM documents""",
)
def ingestion_json(spark, sf):
    to = F.when(
        F.col("doc_id") % 2 == 0, F.lit('["a@example.com","b@example.com"]')
    ).otherwise(F.lit('"a@example.com , ,b@example.com"'))
    sender = F.when(F.col("doc_id") % 5 != 0, F.concat("source", F.lit("@example.com")))
    rest = F.to_json(
        F.struct(
            F.col("doc_id").alias("uid"),
            F.lit(7).alias("uidvalidity"),
            sender.alias("from"),
            F.col("text").alias("body_text"),
            F.create_map(F.lit("X-Source"), F.col("source")).alias("headers"),
            F.format_string("<%d>", "doc_id").alias("message_id"),
        )
    )
    # The recipients go in as raw JSON: a text in one row, a list in the next.
    line = F.concat(F.lit('{"to":'), to, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    path = scratch_dir(spark, "ingestion")
    mt.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    m = src.read_ingestion(spark, path)
    return m.select(
        "uid",
        "uidvalidity",
        "mailbox",
        "from_addr",
        F.concat_ws("|", "to_addrs").alias("recipients"),
        "subject",
        "date",
        digest("body_text").alias("digest"),
        "body_truncated",
        F.col("headers")["x-source"].alias("x_source"),
        "message_id",
    )


@query(
    "request_messages",
    f"""SELECT CAST(doc_id AS STRING) AS message_id, 'last@example.com' AS from_addr,
      CASE WHEN doc_id % 2 = 0 THEN 'unknown@unknown.com' ELSE 'a@example.com|b@example.com' END AS recipients,
      source AS subject, length(text) AS size, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS raw_digest
    FROM documents""",
)
def request_messages(spark, sf):
    to = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(
        F.lit("To: a@example.com,\r\n\tb@example.com\r\n")
    )
    requests = mt.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"),
        F.concat(
            F.lit("From: first@example.com\r\nFrom: last@example.com\r\n"),
            to,
            F.lit("Subject: "),
            "source",
            F.lit("\r\n"),
        ).alias("headers_raw"),
        F.col("text").alias("body_text"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("!!abcde"))
        .otherwise(F.concat(F.lit("\n-"), F.base64(F.encode("text", "UTF-8")), F.lit(" *")))
        .alias("raw_bytes"),
    )
    m = src.requests_to_messages(requests)
    return m.select(
        "message_id",
        "from_addr",
        F.concat_ws("|", "to_addrs").alias("recipients"),
        "subject",
        "size",
        F.sha2("raw_bytes", 256).alias("raw_digest"),
    )


# ---------------------------------------------------------------- the whole job


def _documents(spark, sf, options=OPTIONS, **more) -> DataFrame:
    return docs.build_documents(mt.messages(spark, sf), options, **more)


_VERSION = sql.lit(str(OPTIONS.version))
_DOCUMENTS_SQL = f"""WITH RECURSIVE {sql.document_ctes()},
  n_pii AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id),
  n_cut AS (SELECT doc_id, count(*) AS n FROM sections GROUP BY doc_id),
  flat AS MATERIALIZED (SELECT r.doc_id, m.message_id, m.fetched_at, {sql.emails_redacted('m.from_addr')} AS from_addr,
    replace({sql.emails_redacted('m.to_header')}, ', ', '|') AS to_addrs, m.subject, r.body, sha256(r.body) AS body_hash,
    coalesce(p.n, 0) AS n_pii, coalesce(c.n, 0) AS n_sections
  FROM redacted AS r JOIN {sql.mail('doc_id', 'message_id', 'from_addr', 'to_header', 'subject', 'fetched_at')} AS m ON m.doc_id = r.doc_id
    LEFT JOIN n_pii AS p ON p.doc_id = r.doc_id LEFT JOIN n_cut AS c ON c.doc_id = r.doc_id)"""


@query(
    "documents",
    f"""{_DOCUMENTS_SQL} SELECT message_id, from_addr, to_addrs, subject, 'Tue, 17 Feb 2026 10:00:00 +0000' AS date_parsed,
      body, body_hash, n_pii, n_sections, {_VERSION} AS version, 'ok' AS status FROM flat""",
)
def documents(spark, sf):
    return _documents(spark, sf).select(
        "message_id",
        F.col("from_addr_redacted").alias("from_addr"),
        F.concat_ws("|", "to_addrs_redacted").alias("to_addrs"),
        F.col("subject_canonical").alias("subject"),
        "date_parsed",
        F.col("body_text_canonical").alias("body"),
        F.col("body_original_hash").alias("body_hash"),
        F.size("pii_entities").cast("long").alias("n_pii"),
        F.size("removed_sections").cast("long").alias("n_sections"),
        F.concat_ws("|", "pipeline_version.*").alias("version"),
        "status",
    )


@query(
    "responses",
    f"""{_DOCUMENTS_SQL} SELECT message_id, from_addr AS header_from, body AS body_text, body_hash,
      n_pii AS pii_redactions_count, n_sections AS removed_sections_count, {_VERSION} AS pipeline_version FROM flat""",
)
def responses(spark, sf):
    r = sinks.response(_documents(spark, sf))
    return r.withColumn("header_from", F.col("headers")["from"]).drop("headers", "processing_time_ms")


@query(
    "document_stats",
    f"""{_DOCUMENTS_SQL}, kinds AS (SELECT doc_id, string_agg(DISTINCT type, '|' ORDER BY type) AS kinds FROM merged GROUP BY doc_id)
    SELECT message_id, length(body) AS body_length, n_pii AS pii_redactions_count, coalesce(kinds, '') AS pii_types,
      n_sections AS removed_sections_count, CAST(5 AS BIGINT) AS header_count, {_VERSION} AS pipeline_version
    FROM flat LEFT JOIN kinds ON kinds.doc_id = flat.doc_id""",
)
def document_stats(spark, sf):
    stats = reports.document_stats(_documents(spark, sf))
    return stats.withColumn("pii_types", F.concat_ws("|", "pii_types"))


@query(
    "document_digests",
    f"{_DOCUMENTS_SQL} SELECT message_id, body_hash FROM flat",
)
def document_digests(spark, sf):
    return _documents(spark, sf).select("message_id", F.col("body_original_hash").alias("body_hash"))


@query(
    "entity_audit",
    f"""WITH RECURSIVE {sql.document_ctes()} SELECT doc_id, type, {sql.pseudonym('value')} AS original_hash,
      '[PII_' || type || ']' AS redacted, CAST(span_start AS INT) AS span_start, CAST(span_end AS INT) AS span_end,
      CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS detection_method FROM merged""",
)
def entity_audit(spark, sf):
    return _documents(spark, sf).select(
        F.col("uid").cast("long").alias("doc_id"), F.inline("pii_entities")
    )


@query(
    "stored_documents",
    f"""{_DOCUMENTS_SQL} SELECT CAST(left(fetched_at, 10) AS DATE) AS ingest_date, count(*) AS n,
      CAST(sum(n_pii) AS BIGINT) AS n_pii FROM flat GROUP BY 1""",
)
def stored_documents(spark, sf):
    path = scratch_dir(spark, "documents")
    sinks.write_documents(_documents(spark, sf), path)
    back = sinks.read_documents(spark, path)
    return back.groupBy("ingest_date").agg(
        F.count("*").alias("n"), F.sum(F.size("pii_entities")).alias("n_pii")
    )


@query(
    "documents_as_json",
    f"{_DOCUMENTS_SQL} SELECT message_id, sha256(body) AS digest, n_pii FROM flat",
)
def documents_as_json(spark, sf):
    path = scratch_dir(spark, "json")
    sinks.as_json(_documents(spark, sf)).select("document").write.text(path)
    back = spark.read.schema(
        "message_id STRING, body_text_canonical STRING, pii_entities ARRAY<STRUCT<type: STRING>>"
    ).json(path)
    return back.select(
        "message_id",
        digest("body_text_canonical").alias("digest"),
        F.size("pii_entities").cast("long").alias("n_pii"),
    )


# Bad rows on purpose: no id, no body, no headers; the rest is whole.
_FLAW = "CAST(doc_id % 10 AS INT)"


def _flawed(spark, sf) -> DataFrame:
    flaw = F.expr(_FLAW)
    m = mt.messages(spark, sf)
    return m.withColumns(
        {
            "body_html": F.when(flaw != 1, F.col("body_html")).otherwise(""),
            "message_id": F.when(flaw != 0, F.col("message_id")),
            "body_text": F.when(flaw != 1, F.col("body_text")).otherwise(""),
            "headers": F.when(flaw != 2, F.col("headers")),
        }
    )


_REASON = f"""CASE {_FLAW} WHEN 0 THEN 'Missing message_id' WHEN 1 THEN 'Empty email body'
  WHEN 2 THEN 'Missing headers' END"""


@query("reject_reasons", f"SELECT doc_id, {_REASON} AS reject_reason FROM documents")
def reject_reasons(spark, sf):
    return validate.with_reject_reason(_flawed(spark, sf)).select("doc_id", "reject_reason")


@query(
    "quarantine",
    f"""SELECT doc_id, '[ERROR]' AS sender, '[ERROR]' AS subject, '[PREPROCESSING ERROR: ' || {_REASON} || ']' AS body,
      {_REASON} AS error, '' AS body_hash, 'low' AS severity, TRUE AS retry FROM documents WHERE {_FLAW} <= 2""",
)
def quarantine(spark, sf):
    built = docs.build_documents(_flawed(spark, sf), OPTIONS)
    return docs.quarantine(built).select(
        F.col("uid").cast("long").alias("doc_id"),
        F.col("from_addr_redacted").alias("sender"),
        F.col("subject_canonical").alias("subject"),
        F.col("body_text_canonical").alias("body"),
        F.col("headers_canonical")["preprocessing-error"].alias("error"),
        F.col("body_original_hash").alias("body_hash"),
        "severity",
        "retry",
    )


@query(
    "batch_totals",
    f"SELECT count(*) AS total_count, count(*) FILTER (WHERE {_FLAW} > 2) AS success_count FROM documents",
)
def batch_totals(spark, sf):
    return reports.batch_totals(docs.build_documents(_flawed(spark, sf), OPTIONS))


@query(
    "outcome_report",
    f"""SELECT CASE WHEN {_FLAW} <= 2 THEN 'rejected' ELSE 'ok' END AS status,
      CASE WHEN {_FLAW} <= 2 THEN 'low' END AS severity, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def outcome_report(spark, sf):
    return reports.outcome_report(docs.build_documents(_flawed(spark, sf), OPTIONS))


def _failing_model(text: str):
    """Stand-in for a model that breaks on some texts."""
    if "confidenziale" in text or text.startswith("Da:"):
        raise ValueError("model failed")
    return []


def _degraded(spark, sf) -> DataFrame:
    flaw = F.expr(_FLAW)
    m = mt.messages(spark, sf)
    return m.withColumns(
        {
            "body_html": F.when(flaw != 1, F.col("body_html")).otherwise(""),
            "body_text": F.when(flaw == 1, F.lit(None)).otherwise(
                F.when(flaw == 3, F.concat(F.lit("confidenziale tel. 055 1234567\n"), "body_text"))
                .when(flaw == 4, F.concat("body_text", F.expr("CAST(X'0AFF' AS STRING)")))
                .otherwise(F.col("body_text"))
            ),
            "headers": F.when(flaw != 1, F.col("headers")),
        }
    )


@query(
    "degradation_levels",
    f"""SELECT CASE WHEN {_FLAW} = 1 THEN 'minimal' WHEN {_FLAW} = 3 THEN 'regex_only'
      WHEN {_FLAW} = 4 THEN 'no_canon' ELSE 'full' END AS processing_level, count(*) AS n, count(*) FILTER (WHERE {_FLAW} = 1) AS n_without_body,
      count(*) FILTER (WHERE {_FLAW} = 3) AS n_phone_redacted FROM documents GROUP BY 1""",
)
def degradation_levels(spark, sf):
    built = docs.build_documents(
        _degraded(spark, sf), OPTIONS, names.model_finder(_failing_model), safe=True
    )
    body_text = F.col("body_text_canonical")
    return built.groupBy("processing_level").agg(
        F.count("*").alias("n"),
        F.count_if(body_text == docs.NO_BODY).alias("n_without_body"),
        F.count_if(body_text.startswith("confidenziale tel. [PII_PHONE_IT]\n")).alias("n_phone_redacted"),
    )


# Stages that fail: the model on a body or on a header, and bytes that cannot be parsed.
_FAILED = f"CASE {_FLAW} WHEN 3 THEN 'pii: name detection failed' WHEN 4 THEN 'pii: name detection failed' WHEN 5 THEN 'parse: IndexError' END"


def _model_of_one_name(text: str):
    found = text.find("Mario Rossi")
    if "confidenziale" in text or text.startswith("Da:"):
        raise ValueError("model failed")
    return [("PER", found, found + 11)] if found >= 0 else []


def _failing(spark, sf) -> DataFrame:
    flaw = F.expr(_FLAW)
    broken = F.encode(F.concat(F.lit("Content-Type: text/plain; a*1*\r\n\r\n"), "body_text"), "UTF-8")
    sender = F.when(flaw == 4, "Da: Mario Rossi <m@example.com>").otherwise("Mario Rossi <m@example.com>")
    m = mt.messages(spark, sf)
    return m.withColumns(
        {
            "body_text": F.concat(F.when(flaw == 3, "confidenziale ").otherwise(""), F.lit("Mario Rossi\n"), "body_text"),
            "headers": F.map_concat(F.map_filter("headers", lambda k, v: k != "from"), F.create_map(F.lit("from"), sender)),
            "raw_bytes": F.when(flaw == 5, broken),
        }
    )


@query(
    "failed_stages",
    f"""SELECT doc_id, CASE WHEN {_FLAW} BETWEEN 3 AND 5 THEN 'quarantined' ELSE 'ok' END AS status, {_FAILED} AS error,
      CASE WHEN {_FLAW} IN (3, 4) THEN 'failed' ELSE 'ok' END AS pii_status,
      CASE WHEN {_FLAW} BETWEEN 3 AND 5 THEN 'high' END AS severity, FALSE AS name_left FROM documents""",
)
def failed_stages(spark, sf):
    m = _failing(spark, sf)
    built = docs.build_documents(m, OPTIONS, names.model_finder(_model_of_one_name))
    texts = F.concat_ws(" ", "body_text_canonical", "from_addr_redacted", F.map_values("headers_canonical"))
    failed = F.col("status") != "ok"
    return built.select(
        F.col("uid").cast("long").alias("doc_id"),
        "status",
        "error",
        "pii_status",
        F.when(failed, validate.severity(F.col("error"))).alias("severity"),
        F.contains(texts, F.lit("Mario Rossi")).alias("name_left"),
    )


def _model_that_lacks(word: str):
    def find(text: str):
        if word in text:
            raise ValueError("model failed")
        return []

    return names.model_finder(find)


@query(
    "replayed",
    f"""SELECT doc_id, CASE WHEN {_FLAW} = 4 THEN 'quarantined' ELSE 'ok' END AS status,
      CASE {_FLAW} WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 1 END AS attempt,
      CASE WHEN {_FLAW} = 4 THEN 'pii: name detection failed' END AS error FROM documents""",
)
def replayed(spark, sf):
    """Bodies succeed at the second attempt, bytes that were mended at the third, headers never."""
    m, path = _failing(spark, sf), scratch_dir(spark, "replayed")
    bodies, headers = names.model_finder(_failing_model), _model_that_lacks("Da:")
    replay.write_attempt(docs.build_documents(m, OPTIONS, bodies), path)
    for attempt in (2, 3):
        again = m if attempt == 2 else m.withColumn("raw_bytes", F.lit(None).cast("binary"))
        replay.replay(again, path, lambda due: docs.build_documents(due, OPTIONS, headers), attempt)
    rows = replay.read_attempts(spark, path)
    return rows.select(F.col("uid").cast("long").alias("doc_id"), "status", F.col("attempt").cast("int").alias("attempt"), "error")


@query(
    "documents_in_order",
    f"""SELECT doc_id, row_number() OVER (ORDER BY fetched_at, doc_id) - 1 AS ordinal, 'ok' AS status
    FROM {sql.mail('doc_id', 'fetched_at')} AS m""",
)
def documents_in_order(spark, sf):
    numbered = order.with_ordinal(mt.messages(spark, sf), ["fetched_at", "doc_id"])
    built = docs.build_documents(numbered, OPTIONS)
    return built.select(F.col("uid").cast("long").alias("doc_id"), "ordinal", "status")


# A dictionary table of one name for each order line, names of one to five words and one of two hundred;
# one of the latter in every body and sender.
_LONG_NAMES = r"""SELECT DISTINCT item_id, lower(regexp_extract(text, '^([A-Za-z]+( [A-Za-z]+){0,' || CAST(item_id % 5 AS STRING) || '})', 1)) AS name,
  'NAME' AS label FROM limpida_benchmark"""
_LONGEST_NAME = " ".join(f"parola{n}" for n in range(200))


@query(
    "documents_with_names",
    """SELECT doc_id, '[PII_NAME] <[PII_EMAIL]>' AS sender, 'Caro [PII_NAME],' AS first_line, 'ok' AS status, 'ok' AS pii_status
    FROM documents""",
)
def documents_with_names(spark, sf):
    dictionary, m = _named(spark, sf, mt.table(spark, sf, "documents"))
    return _names_gone(docs.build_documents(m, OPTIONS, dictionary))


def _named(spark, sf, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary, and messages of ``documents`` (table or stream) with a name of it each."""
    mt.table(spark, sf, "benchmark").createOrReplaceTempView("limpida_benchmark")
    found = spark.sql(_LONG_NAMES).where("length(name) >= 5")
    usual = "maria grazia de santis"
    dictionary = found.select("name", "label").union(
        spark.createDataFrame([(usual, "NAME"), (_LONGEST_NAME, "NAME")], "name STRING, label STRING")
    )
    line = F.concat(F.lit("Cliente"), "l_orderkey", F.lit(" riga "), "l_linenumber")
    dictionary = dictionary.union(mt.table(spark, sf, "lineitem").select(line, F.lit("NAME")))
    # Every document gets the longest name, that of the item that has its number, or the usual one.
    longest = F.when(F.col("uid").cast("long") % 7 == 0, F.lit(_LONGEST_NAME))
    name = F.initcap(F.coalesce(longest, "name", F.lit(usual)))
    m = mt.messages_of(documents).join(found.select(F.col("item_id").cast("string").alias("uid"), "name"), "uid", "left")
    m = m.withColumns(
        {
            "body_text": F.concat(F.lit("Caro "), name, F.lit(",\n"), "body_text"),
            "headers": F.map_concat(
                F.map_filter("headers", lambda k, v: k != "from"),
                F.create_map(F.lit("from"), F.concat(name, F.lit(" <n@example.com>"))),
            ),
        }
    ).drop("name")
    return dictionary, m


def _names_gone(built: DataFrame) -> DataFrame:
    return built.select(
        F.col("uid").cast("long").alias("doc_id"),
        F.col("from_addr_redacted").alias("sender"),
        F.substring_index("body_text_canonical", "\n", 1).alias("first_line"),
        "status",
        "pii_status",
    )


_MESSAGE = """CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'Out of MEMORY at ' || event_type WHEN 1 THEN 'worker killed'
  WHEN 2 THEN 'PII stage: ' || event_type WHEN 3 THEN 'cannot parse' WHEN 4 THEN 'Regex timeout'
  WHEN 5 THEN 'validation of ' || event_type ELSE event_type END"""


@query(
    "error_classes",
    f"""SELECT severity, retry, count(*) AS n FROM (SELECT CASE WHEN m LIKE '%memory%' OR m LIKE '%killed%' OR m LIKE '%segfault%' THEN 'critical'
        WHEN m LIKE '%pii%' OR m LIKE '%parse%' THEN 'high' WHEN m LIKE '%timeout%' OR m LIKE '%canon%' THEN 'medium' ELSE 'low' END AS severity,
      a < 3 AND NOT (m LIKE '%memory%' OR m LIKE '%killed%' OR m LIKE '%segfault%') AND m NOT LIKE '%validation%' AS retry
      FROM (SELECT lower({_MESSAGE}) AS m, event_id % 4 + 1 AS a FROM events) AS e) AS c GROUP BY 1, 2""",
)
def error_classes(spark, sf):
    df = mt.table(spark, sf, "events").selectExpr(f"{_MESSAGE} AS m", "event_id % 4 + 1 AS a")
    return (
        df.select(
            validate.severity(F.col("m")).alias("severity"),
            validate.may_retry(F.col("m"), F.col("a")).alias("retry"),
        )
        .groupBy("severity", "retry")
        .agg(F.count("*").alias("n"))
    )


@query(
    "record_rules",
    """SELECT doc_id, CAST(doc_id % 2 = 1 AS BIGINT) AS bad_pii_confidence, CAST(doc_id % 3 = 1 AS BIGINT) AS bad_pii_span,
      CAST(doc_id % 5 = 1 AS BIGINT) AS bad_pii_method, CAST(0 AS BIGINT) AS bad_section_confidence,
      CAST(0 AS BIGINT) AS bad_section_span, CAST(length(text) > 100 AS BIGINT) AS bad_section_preview FROM documents""",
)
def record_rules(spark, sf):
    n = F.col("doc_id")
    df = mt.table(spark, sf, "documents").select(
        "doc_id",
        F.array(
            F.struct(
                F.when(n % 2 == 1, 1.5).otherwise(0.5).alias("confidence"),
                F.when(n % 3 == 1, 9).otherwise(2).alias("span_start"),
                F.lit(5).alias("span_end"),
                F.when(n % 5 == 1, "guess").otherwise("ner").alias("detection_method"),
            )
        ).alias("pii_entities"),
        F.array(
            F.struct(
                F.lit(1.0).alias("confidence"),
                F.lit(0).alias("span_start"),
                F.lit(5).alias("span_end"),
                F.col("text").alias("content_preview"),
            )
        ).alias("removed_sections"),
    )
    return validate.with_rule_violations(df).select("doc_id", *validate.RULES)


# ---------------------------------------------------------------- dedup and reports


@query(
    "first_per_body",
    f"""{_DOCUMENTS_SQL} SELECT message_id, body_hash FROM (SELECT *, row_number() OVER
      (PARTITION BY body_hash ORDER BY fetched_at, message_id) AS rn FROM flat) AS x WHERE rn = 1""",
)
def first_per_body(spark, sf):
    needed = ["body_original_hash", "fetched_at", "message_id", "mailbox", "uidvalidity", "uid"]
    kept = dedup.deduplicate_documents(stored(_documents(spark, sf).select(*needed), "documents"))
    return kept.select("message_id", F.col("body_original_hash").alias("body_hash"))


@query(
    "pii_report",
    f"""WITH RECURSIVE {sql.document_ctes()} SELECT type, detection_method, count(*) AS n, avg(1.0) AS avg_confidence,
      count(DISTINCT type || value) AS distinct_values
    FROM (SELECT *, 'regex' AS detection_method FROM merged) AS m GROUP BY ROLLUP (type, detection_method)""",
)
def pii_report(spark, sf):
    found = _documents(spark, sf).select(F.inline("pii_entities"))
    return reports.pii_report(found)


@query(
    "pii_distinct_sketch",
    f"""WITH RECURSIVE {sql.document_ctes()}
    SELECT type, count(DISTINCT value) AS n_values, TRUE AS near FROM merged GROUP BY type""",
)
def pii_distinct_sketch(spark, sf):
    return reports.sketch_quality(_documents(spark, sf).select(F.inline("pii_entities")))


@query(
    "distinct_of_days",
    f"""WITH RECURSIVE {sql.document_ctes()}
    SELECT type, count(*) AS n, count(DISTINCT value) AS n_values, TRUE AS near FROM merged GROUP BY type""",
)
def distinct_of_days(spark, sf):
    found = _documents(spark, sf).select("fetched_ts", F.inline("pii_entities"))
    found = stored(found.select(F.to_date("fetched_ts").alias("day"), "type", "original_hash"), "findings")
    daily = stored(incremental.daily_distinct(found, F.col("day"), "original_hash", "type"), "daily-distinct")
    exact = found.groupBy("type").agg(F.count_distinct("original_hash").alias("exact"))
    near = F.abs(F.col("n_values") - F.col("exact")) <= 3 * incremental.HLL_ERROR * F.col("exact")
    merged = incremental.distinct_of_days(daily, "type").join(exact, "type")
    return merged.select("type", "n", F.col("exact").alias("n_values"), near.alias("near"))


@query(
    "quantiles_of_days",
    "SELECT event_type, count(*) AS n, TRUE AS p50_near, TRUE AS p99_near FROM events GROUP BY event_type",
)
def quantiles_of_days(spark, sf):
    """Whether quantiles merged from daily sketches lie within the stated error of their rank."""
    events = mt.table(spark, sf, "events")
    daily = stored(incremental.daily_quantiles(events, F.to_date("ts"), "value", "event_type"), "daily-quantiles")
    merged = incremental.quantiles_of_days(daily, [0.5, 0.99], "event_type")

    def near(column: str, rank: float) -> Column:
        below, equal = (F.count_if(c) / F.first("n") for c in (F.col("value") < F.col(column), F.col("value") <= F.col(column)))
        return (below <= rank + incremental.KLL_ERROR) & (equal >= rank - incremental.KLL_ERROR)

    return events.join(merged, "event_type").groupBy("event_type").agg(
        F.first("n").alias("n"), near("p50", 0.5).alias("p50_near"), near("p99", 0.99).alias("p99_near")
    )


@query(
    "section_report",
    f"""WITH {sql.canonical_ctes(sql.source('marked_text'))}
    SELECT type, count(*) AS n, CAST(sum(span_end - span_start) AS BIGINT) AS chars_removed,
      max(span_end - span_start) AS longest, max(confidence) AS confidence FROM sections GROUP BY type""",
)
def section_report(spark, sf):
    return reports.section_report(
        canonical.sections_table(_canonical(spark, sf, "marked_text"), "sections")
    )


@query(
    "size_histogram",
    f"""WITH {sql.canonical_ctes(sql.source())},
      sizes AS (SELECT 'before' AS side, length(t) AS n FROM {sql.source()} AS src
        UNION ALL SELECT 'after', length(t) FROM canon)
    SELECT side, CASE WHEN n >= 20000 THEN 21 ELSE CAST(floor(n / 1000.0) AS BIGINT) + 1 END AS bucket, count(*) AS n
    FROM sizes GROUP BY 1, 2""",
)
def size_histogram(spark, sf):
    df = _canonical(spark, sf).select(
        F.length("body_text").alias("before"), F.length("canonical").alias("after")
    )
    return reports.size_histogram(df, "before", "after")


@query(
    "latency_report",
    """SELECT event_type, count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_samp(value) AS stddev,
      quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""",
)
def latency_report(spark, sf):
    return reports.latency_report(mt.table(spark, sf, "events"), "value", "event_type")


# ---------------------------------------------------------------- runs compared


@query(
    "determinism",
    f"""WITH m AS ({mt.sql('message_id', 'doc_id')}),
      changed AS (SELECT message_id FROM m WHERE doc_id % 7 = 3)
    SELECT 'changed' AS pair, message_id, 1 AS n_left, 0 AS n_right FROM changed
    UNION ALL SELECT 'changed', message_id, 0, 1 FROM changed
    UNION ALL SELECT 'equal', 'rows', count(*), count(*) FROM m""",
)
def determinism(spark, sf):
    """Two runs that must agree, and one over texts of which a known part was changed."""
    columns = ["message_id", "body_text_canonical", "headers_canonical", "body_original_hash", "pii_entities"]
    runs = [stored(_documents(spark, sf).select(*columns), f"run{i}") for i in (1, 2)]
    texts = mt.table(spark, sf, "documents").withColumn("text", F.expr("IF(doc_id % 7 = 3, 'parola ' || text, text)"))
    other = stored(docs.build_documents(mt.messages_of(texts), OPTIONS).select(*columns), "run3")
    changed = compare.differing_rows(runs[0], other, columns)
    equal = compare.differing_rows(*runs, columns)
    sides = [r.select(F.lit(int(r is runs[0])).alias("l"), F.lit(int(r is runs[1])).alias("r")) for r in runs]
    totals = sides[0].unionAll(sides[1]).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return (
        changed.select(F.lit("changed").alias("pair"), "message_id", "n_left", "n_right")
        .unionAll(equal.select(F.lit("equal"), "message_id", "n_left", "n_right"))
        .unionAll(totals.select(F.lit("equal"), F.lit("rows"), "n_left", "n_right"))
    )


@query(
    "version_drift",
    f"""WITH {sql.canonical_ctes(sql.source())}, {sql.canonical_ctes(sql.source(), _NO_QUOTES, "_b")}
    SELECT 'body' AS column_name, count(*) AS n_keys, count(*) FILTER (WHERE a.t <> b.t) AS n_differing
    FROM canon AS a JOIN canon_b AS b ON a.doc_id = b.doc_id
    UNION ALL SELECT 'source', count(*), 0 FROM documents""",
)
def version_drift(spark, sf):
    options = replace(OPTIONS, remove_quotes=False)

    def run(patterns):
        df = _canonical(spark, sf, patterns=patterns)
        return df.select("doc_id", F.col("canonical").alias("body"), F.lit("a").alias("source"))

    left, right = run(REMOVAL_PATTERNS), run(options.active_removal_patterns())
    return compare.drift_by_column(left, right, "doc_id", ["body", "source"])


@query(
    "missing_findings",
    f"""WITH RECURSIVE {sql.merged_ctes(sql.source())},
      expected AS (SELECT doc_id, 'IBAN' AS type, 'IT60X' || lpad(CAST(doc_id AS STRING), 10, '0') || '000000123456' AS value FROM documents)
    SELECT doc_id, type, value FROM expected AS e WHERE NOT EXISTS
      (SELECT 1 FROM merged AS m WHERE m.doc_id = e.doc_id AND m.type = e.type AND m.value = e.value)""",
)
def missing_findings(spark, sf):
    found = _detected(spark, sf).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.type", "h.value")
    expected = mt.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "'IBAN' AS type",
        "'IT60X' || lpad(CAST(doc_id AS STRING), 10, '0') || '000000123456' AS value",
    )
    return compare.missing_findings(expected, found, ["doc_id", "type", "value"])


# ---------------------------------------------------------------- streams


def _event_stream(spark, sf) -> DataFrame:
    return mt.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark, sf) -> DataFrame:
    return mt.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    return jobs.run_to_table(stream, scratch_dir(spark, name), scratch_dir(spark, name + "-state"))


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM events)"


@query(
    "stream_error_rate",
    f"""WITH slots AS (SELECT event_type, unnest(range(0, 5)) AS i, ts FROM events),
      w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(i AS INT)) AS s, event_type FROM slots)
    SELECT s AS window_start, s + INTERVAL 5 MINUTES AS window_end, count(*) AS n,
      count(*) FILTER (WHERE event_type = 'error') AS n_errors
    FROM w GROUP BY s HAVING count(*) FILTER (WHERE event_type = 'error') > 0.05 * count(*)
      AND s + INTERVAL 5 MINUTES <= {_CLOSED}""",
)
def stream_error_rate(spark, sf):
    stream = _event_stream(spark, sf).withColumn("is_error", F.col("event_type") == "error")
    return _plain_times(_run(jobs.error_rate(stream), "error-rate"), "window_start", "window_end")


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "stream_slow_windows",
    f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTES AS window_end,
      count(*) AS n, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2
    HAVING quantile_disc(value, 0.99) > 2 AND window_end <= {_CLOSED}""",
)
def stream_slow_windows(spark, sf):
    slow = jobs.slow_windows(_event_stream(spark, sf), duration="value")
    return _plain_times(_run(slow, "slow"), "window_start", "window_end")


@query(
    "stream_hourly_counts",
    f"""SELECT date_trunc('hour', ts) AS hour, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING hour + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def stream_hourly_counts(spark, sf):
    findings = _event_stream(spark, sf).withColumnRenamed("event_type", "type")
    return _plain_times(_run(jobs.hourly_counts(findings), "hourly"), "hour")


@query(
    "spikes",
    """WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT a.hour, a.type, a.n, b.n AS n_day_before FROM c AS a JOIN c AS b
      ON b.type = a.type AND b.hour = a.hour - INTERVAL 24 HOURS WHERE a.n > 2 * b.n""",
)
def spikes(spark, sf):
    counts = jobs.hourly_counts(_events(spark, sf).withColumnRenamed("event_type", "type"))
    return _plain_times(jobs.spikes(counts), "hour")


@query(
    "stream_spikes",
    f"""WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2
      HAVING hour + INTERVAL 1 HOUR <= {_CLOSED})
    SELECT a.hour, a.type, a.n, b.n AS n_day_before FROM c AS a JOIN c AS b
      ON b.type = a.type AND b.hour = a.hour - INTERVAL 24 HOURS WHERE a.n > 2 * b.n""",
)
def stream_spikes(spark, sf):
    findings = _event_stream(spark, sf).withColumnRenamed("event_type", "type")
    return _plain_times(_run(jobs.spikes_in_stream(findings), "spikes"), "hour")


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf):
    first = jobs.distinct_messages(_event_stream(spark, sf), ["user_id", "event_type"], late="60 days")
    return _run(first, "distinct").select("user_id", "event_type")


@query(
    "stream_documents_with_names",
    """SELECT doc_id, '[PII_NAME] <[PII_EMAIL]>' AS sender, 'Caro [PII_NAME],' AS first_line, 'ok' AS status, 'ok' AS pii_status
    FROM documents""",
)
def stream_documents_with_names(spark, sf):
    dictionary, m = _named(spark, sf, mt.table_stream(spark, sf, "documents"))
    versions, path, state = (scratch_dir(spark, name) for name in ("names", "clean", "clean-state"))
    jobs.write_names(dictionary, versions, 1)
    jobs.clean_stream_with_names(m, OPTIONS, versions, path, state, availableNow=True).awaitTermination()
    return _names_gone(jobs.read_batches(spark, path))


@query("stream_documents", f"{_DOCUMENTS_SQL} SELECT message_id, body_hash, n_pii FROM flat")
def stream_documents(spark, sf):
    rows = mt.table_stream(spark, sf, "documents")
    path = scratch_dir(spark, "clean")
    run = jobs.clean_stream(
        mt.messages_of(rows), OPTIONS, path, scratch_dir(spark, "clean-state"), availableNow=True
    )
    run.awaitTermination()
    back = sinks.read_documents(spark, path)
    return back.select(
        "message_id",
        F.col("body_original_hash").alias("body_hash"),
        F.size("pii_entities").cast("long").alias("n_pii"),
    )
