"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limpida.llm import byte_bpe, conversation_repair, decontaminate, exact_dedup, jaccard_join, language_id, near_dedup, quality, ranked_search, secret_scan, substring_dedup, suffix_tree, surrogates
from limpida.llm.tables import table
from limpida.session import ship_package

#: Key of the registered query; a real run brings its own.
KEY = b"registered-query-key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(ship_package(spark), sf_dir)
        if statement is not None:
            ORACLE[name] = statement
        return run

    return add


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that splits text before the merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query(
    "op2_grace_dedup",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
               FROM documents),
    g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
)
def op2(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), *vocabulary())


@query("op7_weak_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_owned_secrets")
def op8(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query("op9_bloom_language")
def op9(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query(
    "op4_containment_decontamination",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                      lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
    s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                      lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
    n AS (SELECT item_id, count(*) AS n_item_shingles FROM s GROUP BY item_id)
    SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*) / n_item_shingles AS containment
    FROM ds JOIN s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles
    HAVING count(*) * 100 >= n_item_shingles * 75""",
)
def op4(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_odd_sketch_dedup")
def op1(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_suffix_automata")
def op10(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), fixed_order=True).drop("kept_text")


@query("op3_suffix_tree")
def op3(spark, sf_dir):
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


@query("op5_surrogates")
def op5(spark, sf_dir):
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), KEY)


@query("op12_audit_repair")
def op12(spark, sf_dir):
    return conversation_repair.repair_conversations(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query(
    "op13_shared_search",
    r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    s AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
    t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
    f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
    v AS (SELECT term, floor(1000 * ln((2 * (SELECT n_all FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f GROUP BY term),
    g AS (SELECT item_id, r, doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))))::BIGINT AS score
          FROM i JOIN f USING (term) JOIN v USING (term), s GROUP BY ALL),
    k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
          FROM g WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""",
)
def op13(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_metric_join",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                      lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 180 * count(*) >= 80 * (na.n + nb.n)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def op11(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")
