"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4).

A test item is found in a document if at least 75 % of the item's distinct 5-word shingles are there.
Containment does not depend on how long the document is, so the item chooses what is looked up: the
k shingles with the least hashes. The items are partitioned by size, and k follows from the size:
up to ``MOST_KEYS`` it is one more than the number of shingles that may be missing, so that one of the
k must be in the document; above, k stays there, and all k are missed with probability 0.25^k at most.
A document only meets items of which it has shingles enough. Candidates are verified by the exact
number of shared shingles, compared as text. All of it is DataFrame functions.

The items' keys are broadcast if a count proves them small, and joined by shuffle otherwise.
Documents stream past them; only hits are shuffled. What was hit is written, told by a digest of the text, and meets
the texts again by a broadcast where a count proves it small, else by a shuffle. A passage that a third of all documents contain
makes one hit per document, which is the result itself.

Defined results: words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z); a text of one to four words has its whole
sequence as one shingle; null, empty and blank texts have none, and neither contain nor are contained
in anything. Very long texts are searched whole. Items with equal texts are all reported. What a document holds depends
on its text alone: rows without id and rows that repeat one are verified each. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.functions.spans import once
from limpida.llm.tables import stored

SHINGLE = 5
#: Containment as parts of 100.
AT_LEAST = 75
MOST_KEYS = 16
#: Keys (16 bytes each) up to which they are broadcast, and hits (of 40 bytes).
BROADCAST_KEYS = 1_000_000
BROADCAST_HITS = 500_000


def word_array(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(text: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of(words, start)`` for each shingle: one for a short text, none for an empty one.

    The words are bound as the variable of an outer lambda, so they are made once per text.
    """

    def each(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n >= SHINGLE, F.sequence(F.lit(1), n - (SHINGLE - 1))).when(n > 0, F.array(F.lit(1)))
        return F.coalesce(F.transform(starts, lambda i: of(words, i)), F.array())

    return once(F.flatten(F.transform(F.array(word_array(text)), each)))


def shingle_hashes(text: Column) -> Column:
    return _shingles(text, lambda words, i: F.xxhash64(*[F.get(words, i + (n - 1)) for n in range(SHINGLE)]))


def shingle_texts(text: Column) -> Column:
    return _shingles(text, lambda words, i: F.array_join(F.slice(words, i, SHINGLE), " "))


def item_keys(items: DataFrame) -> DataFrame:
    """item_id, needed (shared shingles at least), and one row per key hash."""
    hashed = items.select("item_id", shingle_hashes(F.col("text")).alias("h"))
    hashed = hashed.select("item_id", F.array_sort(F.array_distinct("h")).alias("h"))
    n = F.size("h")
    needed = F.ceil(n * AT_LEAST / 100).cast("int")
    keys = F.slice("h", 1, F.least(n - needed + 1, F.lit(MOST_KEYS)))
    return hashed.where(n > 0).select("item_id", needed.alias("needed"), F.explode(keys).alias("key"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digests of texts (__of) and the items that share a key with them, as a written table."""
    keys = item_keys(items)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    hashed = docs.select(_digest().alias("__of"), shingle_hashes(F.col("text")).alias("h"))
    hits = hashed.select("__of", F.size("h").alias("n"), F.explode("h").alias("key")).join(keys, "key").where(F.col("n") >= F.col("needed"))
    found = stored(hits.groupBy("__of").agg(F.collect_set("item_id").alias("__items")), "hits")
    number = found.agg(F.sum(F.size("__items"))).first()[0] or 0
    return F.broadcast(found) if number <= BROADCAST_HITS else found


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of doc_id, item_id, n_item_shingles, n_shared, containment."""
    texts = docs.select("doc_id", "text", _digest().alias("__of")).join(candidates(docs, items), "__of")
    return _verified(texts.select("doc_id", "text", "__items"), items)


def _verified(texts: DataFrame, items: DataFrame) -> DataFrame:
    of_docs = texts.select("doc_id", "__items", shingle_texts(F.col("text")).alias("__in_doc"))
    of_docs = of_docs.select("doc_id", F.explode("__items").alias("item_id"), "__in_doc")
    of_items = items.select("item_id", shingle_texts(F.col("text")).alias("s")).select("item_id", F.array_distinct("s").alias("__in_item"))
    shared = F.size(F.array_intersect("__in_item", "__in_doc"))
    size = F.size("__in_item")
    return (
        of_docs.join(of_items, "item_id")
        .select("doc_id", "item_id", size.cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
        .where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * AT_LEAST)
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows in which no item was found, with all their columns."""
    hit = docs.select("text", _digest().alias("__of")).join(candidates(docs, items), "__of")
    bad = stored(_verified(hit.select(F.col("__of").alias("doc_id"), "text", "__items"), items).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_HITS:
        bad = F.broadcast(bad)
    return docs.join(bad, _digest() == F.col("__bad"), "left_anti")
