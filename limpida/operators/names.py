"""Names and organisations: by dictionary or by a model the caller brings.

Findings are ``array<struct<label,span_start,span_end,value>>``; the rules for names
(length, titles, confidence) are applied to them later, whatever found them.

A dictionary is a table ``(name, label)`` with label NAME or ORG. Names match whole
words, blind to case, with single spaces between; the text must start with a capital.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.functions import spans
from limpida.session import stored

FOUND_TYPE = "array<struct<label:string,span_start:int,span_end:int,value:string>>"
MAX_LITERAL_NAMES = 20_000
#: A phrase with more than one part in so many of all phrases is salted.
HOT_PARTS = 1000
#: Runs or words whose lengths are added up at once, see ``_cut_up``.
BLOCK = 256
#: Words of a run up to which copying it costs less than picking words.
SHORT = 16
#: First words of phrases by which a dictionary is cut down, if there are no more: 4 MB of hashes.
MOST_FIRSTS = 500_000

#: Words with single spaces between. Possessive repeats keep the matcher off the stack.
_RUN = r"[\p{L}\p{N}_]++(?: [\p{L}\p{N}_]++)*+"

Finder = Callable[[Column], Column]


def _starts_with_capital(word: Column) -> Column:
    first = F.left(word, F.lit(1))
    return first != F.lower(first)


def _phrases(runs: Column, lengths: Sequence[int], made: Callable[[Column], Column]) -> Column:
    """Phrases of ``lengths`` words that start with a capital: where they are, and what ``made`` gives of them in lower case.

    A phrase lies inside a run, so a long name costs something only where a run is as long, and a run
    without capitals is not split.
    """
    counts = F.array(*(F.lit(n) for n in lengths))

    def of_run(run: Column) -> Column:
        def at(words: Column, low: Column) -> Column:
            capitals = F.filter(
                F.sequence(F.lit(0), F.size(low) - 1),
                lambda i: _starts_with_capital(F.get(words, i)),
            )
            return F.flatten(
                F.transform(
                    capitals,
                    lambda i: F.transform(
                        F.filter(counts, lambda n: i + n <= F.size(low)),
                        lambda n: F.struct(
                            run["run_no"].alias("run_no"),
                            i.alias("word_no"),
                            n.alias("n_words"),
                            made(F.when(F.size(low) <= SHORT, F.array_join(F.slice(low, i + 1, n), " ")).otherwise(_joined(low, i, n))).alias("made"),
                        ),
                    ),
                )
            )

        words = F.split(run["run"], " ", -1)
        return spans.let(words, lambda w: spans.let(F.transform(w, F.lower), lambda low: at(w, low)))

    numbered = F.transform(runs, lambda r, i: F.struct(i.alias("run_no"), r.alias("run")))
    return F.flatten(F.transform(F.filter(numbered, lambda r: r["run"] != F.lower(r["run"])), of_run))


def _joined(words: Column, at: Column, n: Column, made: Callable[[Column], Column] = lambda w: w) -> Column:
    """The ``n`` words from ``at``. ``slice`` would copy the whole run for each phrase."""
    return F.array_join(F.transform(F.sequence(at, at + n - 1), lambda i: made(F.get(words, i))), " ")


def _place(cut: Column, hit: Column) -> Column:
    """Span and surface text of a phrase: the length of the blocks before its own, then of the runs and
    gaps inside it, and the same again for the words of its run."""
    runs, gaps, of, at = cut["runs"], cut["gaps"], hit["run_no"], hit["word_no"]
    words, starts = F.get(cut["words"], of), F.get(cut["word_starts"], of)
    before = (
        F.get(cut["starts"], _block(of))
        + _total_length(runs, gaps, _inside(of))
        + F.length(F.get(gaps, of))
        + F.get(starts, _block(at))
        + _total_length(words, None, _inside(at))
    )
    value = _joined(words, at, hit["n_words"])
    return F.struct(
        hit["label"].alias("label"),
        before.alias("span_start"),
        (before + F.length(value)).alias("span_end"),
        value.alias("value"),
    )


def _block(at: Column) -> Column:
    return F.floor(at / BLOCK).cast("int")


def _inside(at: Column) -> Column:
    """The numbers before ``at`` in its block."""
    first = _block(at) * BLOCK
    return F.when(at > first, F.sequence(first, at - 1)).otherwise(F.array().cast("array<int>"))


def _total_length(pieces: Column, gaps: Column | None, numbers: Column) -> Column:
    """Characters of the pieces with these numbers and the gaps before them, or a space after each."""
    gap = (lambda i: F.length(F.get(gaps, i))) if gaps is not None else lambda i: F.lit(1)
    return F.aggregate(numbers, F.lit(0), lambda n, i: n + gap(i) + F.length(F.get(pieces, i)))


def _starts(pieces: Column, gaps: Column | None) -> Column:
    """Where every block of ``BLOCK`` pieces starts."""

    def block(no: Column) -> Column:
        last = F.least((no + 1) * BLOCK, F.size(pieces)) - 1
        return _total_length(pieces, gaps, F.sequence(no * BLOCK, last))

    whole = F.floor(F.size(pieces) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), whole - 1), block)
    summed = F.aggregate(
        blocks, F.array(F.lit(0)), lambda found, n: F.array_append(found, F.element_at(found, -1) + n)
    )
    return F.when(whole > 0, summed).otherwise(F.array(F.lit(0)))


def _runs(text: Column) -> Column:
    """Runs, words with single spaces between, and the gaps around them."""
    return F.struct(spans.matches(text, _RUN).alias("runs"), spans.gaps(text, _RUN).alias("gaps"))


def _cut_up(cut: Column) -> Column:
    """Runs with their gaps and words, and where every block of runs and, in each run, of words starts."""
    split = F.transform(cut["runs"], lambda r: F.split(r, " ", -1))
    return spans.let(
        F.struct(cut["runs"].alias("runs"), cut["gaps"].alias("gaps"), split.alias("words")),
        lambda c: F.struct(
            *(c[n].alias(n) for n in ("runs", "gaps", "words")),
            _starts(c["runs"], c["gaps"]).alias("starts"),
            F.transform(c["words"], lambda w: _starts(w, None)).alias("word_starts"),
        ),
    )


def _placed(text: Column, hits: Callable[[Column], Column], chosen: Callable[[Column, Column], Column]) -> Column:
    """Places of the hits ``hits`` gives of the runs; a text without hits is cut no further."""

    def of(x: Column) -> Column:
        there = spans.let(_cut_up(x["cut"]), lambda cut: F.transform(chosen(cut, x["hits"]), lambda h: _place(cut, h)))
        return F.when(F.size(x["hits"]) > 0, there).otherwise(F.array().cast(FOUND_TYPE))

    return spans.let(_runs(text), lambda cut: spans.let(F.struct(cut.alias("cut"), hits(cut["runs"]).alias("hits")), of))


def literal_finder(names: Sequence[str], organisations: Sequence[str]) -> Finder:
    """Finder for a dictionary small enough to be part of the plan (a hash set per task)."""
    people, firms = list(names), list(organisations)
    lengths = sorted({n.count(" ") + 1 for n in people + firms}) or [1]

    def label(phrase: Column) -> Column:
        result = F.when(F.lit(False), F.lit(None).cast("string"))
        if people:
            result = result.when(phrase.isin(people), "NAME")
        if firms:
            result = result.when(phrase.isin(firms), "ORG")
        return result

    def find(text: Column) -> Column:
        def hits(runs: Column) -> Column:
            return F.transform(
                F.filter(_phrases(runs, lengths, label), lambda p: p["made"].isNotNull()),
                lambda p: F.struct(*(p[n].alias(n) for n in ("run_no", "word_no", "n_words")), p["made"].alias("label")),
            )

        return _placed(text, hits, lambda cut, found: found)

    return find


def dictionary_finder(dictionary: DataFrame) -> Finder:
    """A literal finder when the dictionary is proven small, else an error.

    At most ``MAX_LITERAL_NAMES`` + 1 rows come to the driver; a larger dictionary is given to the
    job as a table (``with_found``).
    """
    rows = (
        dictionary.select(F.lower("name").alias("name"), "label")
        .distinct()
        .limit(MAX_LITERAL_NAMES + 1)
        .collect()
    )
    if len(rows) > MAX_LITERAL_NAMES:
        raise ValueError(f"more than {MAX_LITERAL_NAMES} names: use find_by_join")
    return literal_finder(
        sorted(r["name"] for r in rows if r["label"] == "NAME"),
        sorted(r["name"] for r in rows if r["label"] == "ORG"),
    )


def with_found(df: DataFrame, texts: dict[str, str], finder: Finder | DataFrame) -> DataFrame:
    """Add what ``finder`` finds in several text columns; ``texts`` maps output to text columns.

    A dictionary of any size may stand for the finder. Its names are joined: the rows so far are
    written once, under a number of their own, and read for phrases and for the join back. They hold
    texts not yet redacted: ``limpida.session.remove_scratch`` removes them once the result is written.
    """
    if not isinstance(finder, DataFrame):
        return df.withColumns({out: finder(F.col(f"`{column}`")) for out, column in texts.items()})
    if df.isStreaming:
        raise ValueError("a dictionary table cannot be joined here to a stream: give a finder")
    numbered = stored(df.withColumn("__row", F.monotonically_increasing_id()), "before-names")
    return find_by_join(numbered, "__row", texts, finder).drop("__row")


def _belongs_to(field: str) -> Callable[[Column], Column]:
    return lambda hit: hit["field"] == field


def find_by_join(df: DataFrame, key: str, texts: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """Find dictionary names of any number and length by a join, several text columns at once.

    ``texts`` maps output columns to text columns; ``key`` is unique per row. A phrase goes to
    the join as a hash, whatever its length, and texts move once, for the join back, where each
    name is compared with its place in the text. Only names that begin with a word of the texts are
    grouped and joined, where these words are few (``MOST_FIRSTS``, proven by a bounded read). Phrases are counted
    first: those that make up more than 1 / ``HOT_PARTS`` of all, at most that many, are dealt out by as many
    salts as their share asks for, so that no name piles up in one task.
    """
    named = dictionary.where("name <> ''")
    n_words = F.length("name") - F.length(F.replace("name", F.lit(" "), F.lit(""))) + 1
    # Single words are always there: with them begin the names that can be met.
    lengths = sorted({1, *(r[0] for r in named.select(n_words).distinct().collect())})

    def phrases_of(out: str, column: str) -> Column:
        runs = spans.matches(F.coalesce(F.col(f"`{column}`"), F.lit("")), _RUN)
        return F.transform(
            _phrases(runs, lengths, F.xxhash64),
            lambda p: F.struct(
                F.lit(out).alias("field"),
                p["run_no"].alias("run_no"),
                p["word_no"].alias("word_no"),
                (p["n_words"] == 1).alias("is_word"),
                p["made"].alias("hash"),
            ),
        )

    # ``once``: else Spark finds all phrases a second time, to see whether there are any.
    each = df.select(F.col(key).alias("__key"), spans.once(F.concat(*(phrases_of(*t) for t in texts.items()))).alias("p"))
    phrases = stored(each.select("__key", F.explode("p").alias("p")).select("__key", "p.*"), "phrases")
    named = named.select(F.lower("name").alias("name"), "label")
    firsts = phrases.where("is_word").select(F.col("hash").alias("first")).distinct().limit(MOST_FIRSTS + 1).toArrow()
    if firsts.num_rows <= MOST_FIRSTS:
        first = F.xxhash64(F.substring_index("name", " ", 1))
        few = F.broadcast(df.sparkSession.createDataFrame(firsts))
        named = named.withColumn("first", first).join(few, "first", "left_semi").drop("first")
    counted = phrases.groupBy("hash").agg(F.count("*").alias("times"))
    entries = (
        named.groupBy("name")
        .agg(F.min("label").alias("label"))  # NAME before ORG
        .select("name", "label", F.size(F.split("name", " ")).alias("n_words"), F.xxhash64("name").alias("hash"))
    )
    known = stored(entries.join(counted, "hash"), "known-names")
    share = F.col("times") * HOT_PARTS / F.lit(max(1, phrases.count()))
    hot = F.broadcast(known.where(share > 1).select("hash", F.ceil(share).cast("int").alias("salts")).distinct())
    salts = F.coalesce("salts", F.lit(1))
    found = (
        phrases.drop("is_word")
        .join(hot, "hash", "left")
        .withColumn("salt", F.pmod(F.xxhash64("__key", "run_no", "word_no"), salts).cast("int"))
        .join(
            known.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"),
            ["hash", "salt"],
        )
        .groupBy("__key")
        .agg(F.collect_list(F.struct("field", "run_no", "word_no", "n_words", "label", "name")).alias("__names"))
    )
    joined = df.join(found, df[key] == found["__key"], "left").drop("__key")
    none = F.array().cast("array<struct<field:string,run_no:int,word_no:int,n_words:int,label:string,name:string>>")
    columns = {}
    for out, column in texts.items():
        own = F.filter(F.coalesce(F.col("__names"), none), _belongs_to(out))
        columns[out] = _placed(F.coalesce(F.col(f"`{column}`"), F.lit("")), lambda _, own=own: own, _there)
    return joined.withColumns(columns).drop("__names")


def _there(cut: Column, hits: Column) -> Column:
    return F.array_sort(F.filter(hits, lambda h: _is_there(cut, h)))


def _is_there(cut: Column, hit: Column) -> Column:
    """Whether the words of a place are the name, and not only of one hash."""
    words = F.get(cut["words"], hit["run_no"])
    return _joined(words, hit["word_no"], hit["n_words"], F.lower) == hit["name"]


Triples = Sequence[tuple[str, int, int]]

#: Models of this Python worker by the key of their finder.
_models: dict[str, Callable[[Sequence[str]], Sequence[Triples]]] = {}


def _model(key: str, load: Callable[[], Callable[[Sequence[str]], Sequence[Triples]]]):
    if key not in _models:
        _models[key] = load()
    return _models[key]


def model_finder(find: Callable[[str], Triples]) -> Finder:
    """Finder around a small function: ``find(text)`` gives ``(label, start, end)`` triples.

    A text it fails on gives null, which the job records as a failed stage.
    """
    return loaded_finder(lambda: lambda texts: [find(t) for t in texts])


def loaded_finder(load: Callable[[], Callable[[Sequence[str]], Sequence[Triples]]]) -> Finder:
    """Finder around a model that ``load()`` brings up, once per Python worker.

    The model takes a batch of texts and gives one list of triples per text. If it fails on a
    batch, the texts are tried one by one, so that only those it fails on give null, as does a text
    that is no valid UTF-8. A model that cannot be loaded fails the job.
    """
    key = uuid.uuid4().hex

    def plain(found: Triples) -> list:
        return [(str(lb), int(s), int(e)) for lb, s, e in found]

    def one(model, text: str) -> list | None:
        try:
            return plain(model([text])[0])
        except Exception:
            return None

    def batch(model, texts: list[str]) -> list:
        try:
            found = [plain(f) for f in model(texts)]
            if len(found) == len(texts):
                return found
        except Exception:
            pass
        return [one(model, t) for t in texts]

    @F.pandas_udf("array<struct<label:string,span_start:int,span_end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            given = [i for i, t in enumerate(texts) if t is not None]
            for i, found in zip(given, batch(model, [texts.iloc[i] for i in given]) if given else []):
                out.iat[i] = found
            yield out

    run = run.asNondeterministic()  # see ``text.with_nfc``

    def finder(text: Column) -> Column:
        return F.transform(
            run(F.when(F.is_valid_utf8(text), text)),
            lambda e: F.struct(
                e["label"].alias("label"),
                e["span_start"].alias("span_start"),
                e["span_end"].alias("span_end"),
                F.substring(text, e["span_start"] + 1, e["span_end"] - e["span_start"]).alias(
                    "value"
                ),
            ),
        )

    return finder
