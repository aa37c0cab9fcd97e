"""Secret scan with corpus-wide ownership frequency (operator 8).

Each text is scanned for three base kinds (assigned values, access keys, hexadecimal runs) and for
generic mixed tokens. Every candidate value is hashed, and the hashes are counted over the whole
corpus by distinct repositories and distinct owners. A value that many owners or many repositories carry
is an example that was copied around; one that stays with an owner and few repositories and looks random
is treated as live. Base spans always stay; a generic token adds a span only where it is live.

Counts are grouped by (value, owner, repository) first, then by (value, owner), then by value, so a
value that a third of all rows carry is thinned before each shuffle. The join back is on narrow rows,
and Spark splits it where it is skewed.

Defined results: null text counts as empty; a row without candidates has zero counts and the digest
of the empty string. A null owner or repository counts as one value of its own. Repeated rows are
rows of their own and the same repository. Spans are code points, end exclusive, of the whole match;
ties in start go by kind. Very long texts are scanned whole, as one row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpida.llm.tables import stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "generic")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: A value with at least so many distinct owners is a copied example.
EXAMPLE_OWNERS = 3
#: And so is one in at least so many distinct repositories, whoever owns them. Near copies alone do not
#: reach it: at scale factor 0.1 no value is in more than 3.
EXAMPLE_REPOSITORIES = 10
#: Bits a character from which a value looks random.
LIVE_ENTROPY = 3.0
GENERIC_ENTROPY = 3.8

FOUND = """repository string, owner string, doc_id long, n_assign long, n_access long, n_hex long,
    base_sha256 string, spans array<struct<start:int,kind:int,stop:int,value:string,random:boolean>>"""


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def generic_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed tokens outside the base spans."""
    out = []
    for m in GENERIC.finditer(text):
        value = m[0]
        if value.isalpha() or value.lower() == value or value.upper() == value or not any(c.isdigit() for c in value):
            continue
        if entropy(value) >= GENERIC_ENTROPY and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), value))
    return out


def label(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("random", pa.bool_())]))
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for n in range(3):
                    counts[n].append(sum(s[1] == n for s in base))
                digests.append(hashlib.sha256(label(base).encode()).hexdigest())
                spans.append(
                    [
                        {"start": a, "kind": k, "stop": b, "value": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= LIVE_ENTROPY}
                        for a, k, b, v in sorted(base + generic_spans(text or "", base))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("repository", "owner", "doc_id")]
                + [pa.array(c, pa.int64()) for c in counts]
                + [pa.array(digests, pa.string()), pa.array(spans, kind)],
                ["repository", "owner", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, and how many are live or examples."""
    scanned = docs.select(
        F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), "doc_id", "text"
    ).mapInArrow(_scan, FOUND)
    found = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    spans = found.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("s"))
    spans = spans.select("row", "repository", "owner", "s.start", "s.kind", "s.stop", "s.value", "s.random")
    owners = (
        spans.groupBy("value", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value")
        .agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    )
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    live = ~copied & F.col("random")
    marked = spans.join(owners, "value").select(
        "row", "n_repositories", copied.alias("copied"), live.alias("live"), F.struct("start", "kind", "stop").alias("s")
    )
    stays = (F.col("s.kind") < 3) | F.col("live")
    per_row = marked.groupBy("row").agg(
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if("copied").alias("n_copied"),
        F.max("n_repositories").alias("max_repositories"),
        F.array_sort(F.collect_list(F.when(stays, F.col("s")))).alias("s"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(
        F.transform("s", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
    per_row = per_row.select("row", "n_live", "n_copied", "max_repositories", text.alias("spans"))
    zero = F.lit(0).cast("long")
    return (
        found.drop("spans")
        .join(per_row, "row", "left")
        .select(
            "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
            F.coalesce("spans", F.lit("")).alias("spans"),
            *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_copied", "max_repositories")],
        )
    )
