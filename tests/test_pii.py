import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import brute
from limpida import PiiMode
from limpida.functions import pii, spans
from limpida.functions.patterns import PiiPattern
from limpida.operators import names
from samples import SALT


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


def test_hits_and_redaction_equal_plain_python(texts, options):
    values = brute.random_texts(800, 11)
    df = pii.with_hits(texts(values), "t", options, "h").withColumn("r", pii.redact("t", "h"))
    df = df.withColumn("short", pii.redact_text("t", options))
    for value, (found, text, short) in zip(values, rows(df, "h", "r", "short")):
        want = brute.merge(brute.hits(value))
        assert [(h.span_start, h.span_end, h.type, h.method) for h in found] == want, repr(value)
        assert text == brute.redacted(value, want) == short
        assert all(value[h.span_start : h.span_end] == h.value for h in found)


def test_entities_in_both_modes(texts, options):
    df = pii.with_hits(texts(["Scrivi a mario@example.com"]), "t", options, "h")
    redact = rows(df.withColumn("e", pii.entities("h", options)), "e")[0][0][0]
    digest = hashlib.sha256(f"mario@example.com{SALT}".encode()).hexdigest()[:16]
    assert (redact.type, redact.original_hash, redact.redacted) == ("EMAIL", digest, "[PII_EMAIL]")
    only = replace(options, pii_mode=PiiMode.DETECT_ONLY)
    assert rows(df.withColumn("e", pii.entities("h", only)), "e")[0][0][0].redacted == "mario@example.com"


def test_merge_rules(spark):
    def merged(*found):
        hits = ", ".join(
            f"named_struct('span_start', {s}, 'rank', {r}, 'span_end', {e}, 'type', '{r}', 'value', 'v',"
            f" 'confidence', 1.0D, 'method', '{m}')"
            for r, (s, e, m) in enumerate(found)
        )
        from limpida.functions.spans import bind, merge_overlaps

        sql = bind("x", f"array({hits})", merge_overlaps("x", pii.HIT_TYPE))
        return [(h.span_start, h.span_end, h.method) for h in spark.range(1).select(F.expr(sql)).head()[0]]

    assert merged((0, 20, "regex"), (10, 25, "ner")) == [(0, 20, "regex")]
    assert merged((0, 20, "ner"), (10, 25, "regex")) == [(10, 25, "regex")]
    assert merged((0, 10, "ner"), (5, 20, "ner")) == [(5, 20, "ner")]
    assert merged((0, 10, "ner"), (5, 15, "ner")) == [(0, 10, "ner")]
    # A hit that lost does not bridge: (8, 12) overlaps only the loser of the first pair.
    assert merged((0, 8, "ner"), (4, 10, "ner"), (8, 12, "ner")) == [(0, 8, "ner"), (8, 12, "ner")]


def test_own_patterns(texts, options):
    own = replace(options, pii_patterns=(PiiPattern("BADGE", r"\bB-\d{3}\b", "B-"),), allow_patterns=())
    df = pii.with_hits(texts(["see B-123 and a@b.it"]), "t", own, "h")
    assert rows(df.withColumn("r", pii.redact("t", "h")), "r") == [("see [PII_BADGE] and a@b.it",)]


def test_names_by_literals_join_and_model(spark, texts, options):
    values = ["Mario Rossi lavora a Milano.", "L'azienda Microsoft ha sede.", "mario rossi", "Ada", "Prof Mario  Rossi"]
    dictionary = spark.createDataFrame(
        [("Mario Rossi", "NAME"), ("microsoft", "ORG"), ("Ada", "NAME"), ("Prof", "NAME")], "name STRING, label STRING"
    )
    want = [[("NAME", 0, 11, "Mario Rossi")], [("ORG", 10, 19, "Microsoft")], [], [], []]
    finder = names.dictionary_finder(dictionary)
    joined = names.find_by_join(texts(values), "n", {"f": "t", "g": "t"}, dictionary)
    for df in (texts(values).withColumn("f", finder(F.col("t"))), joined):
        got = rows(df.withColumn("h", F.expr(pii.name_hits_sql("f", options))), "h")
        assert [[(h.type, h.span_start, h.span_end, h.value) for h in r[0]] for r in got] == want
    assert [r[0] for r in rows(joined, "f")] == [r[0] for r in rows(joined, "g")]

    def model(text):
        if "Ada" in text:
            raise ValueError
        return [("PERSON", 0, 5)] if text.startswith("Mario") else []

    got = rows(texts(values).withColumn("f", names.model_finder(model)(F.col("t"))), "f")
    assert got[0][0][0].value == "Mario" and got[1][0] == [] and got[3][0] is None


def test_model_is_loaded_once_and_fails_alone(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os, uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(batch):
            if any("bad" in t for t in batch):
                raise ValueError
            return [[("PERSON", 0, 3)] for _ in batch]

        return model

    df = spark.range(400).selectExpr("id AS n", "IF(id % 50 = 7, 'bad', IF(id = 3, NULL, 'Ada si')) AS t").repartition(16)
    got = rows(df.withColumn("f", names.loaded_finder(load)(F.col("t"))), "t", "f")
    assert sum(f is None for _, f in got) == 8 + 1 and all(f is None for t, f in got if t != "Ada si")
    loads = list(tmp_path.iterdir())
    assert len(loads) == len({p.name.split("-")[0] for p in loads})


def test_many_hits_of_one_document(texts, options):
    """Blocks of a fold end inside these texts; characters of one to four bytes come before each hit."""
    for n in (1, 255, 256, 257, 700):
        text = "".join(f"\ufeffà😀 user{i}@example.it, " for i in range(n))
        df = pii.with_hits(texts([text]), "t", options, "h").withColumn("r", pii.redact("t", "h"))
        hits, redacted = rows(df, "h", "r")[0]
        assert [h.value for h in hits] == [f"user{i}@example.it" for i in range(n)]
        assert all(text[h.span_start:h.span_end] == h.value for h in hits)
        assert redacted == "\ufeffà😀 [PII_EMAIL], " * n


def test_allowed_spans_in_one_sweep(spark):
    """Against every pair in plain Python, and in linear time."""
    import random
    import time

    pick = random.Random(2)
    kind = "struct<span_start:int,span_end:int,value:string>"
    row = lambda n, top: [(a, a + pick.randint(1, 9), str(a)) for a in (pick.randint(0, top) for _ in range(n))]
    cases = [(row(pick.randint(0, 40), 200), row(pick.randint(0, 12), 200)) for _ in range(200)]
    sql = F.expr(spans.without_overlap("h", "a", kind))
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], f"n INT, h array<{kind}>, a array<{kind}>")
    for r in df.select("n", sql.alias("k")).collect():
        hits, allowed = cases[r.n]
        want = [h for h in hits if not any(a[0] < h[1] and h[0] < a[1] for a in allowed)]
        assert sorted(tuple(k) for k in r.k) == sorted(want)

    def seconds(n):
        big = spark.range(8).selectExpr(
            f"transform(sequence(1, {n}), i -> named_struct('span_start', i * 20, 'span_end', i * 20 + 5, 'value', 'x')) AS h",
            f"transform(sequence(1, {n}), i -> named_struct('span_start', i * 20 + 7, 'span_end', i * 20 + 9, 'value', 'x')) AS a",
        )
        began = time.monotonic()
        assert big.select(F.sum(F.size(sql))).first()[0] == 8 * n
        return time.monotonic() - began

    seconds(4000)
    assert seconds(16_000) < 4 * 2.3 * max(0.2, min(seconds(4000) for _ in range(3)))


def test_place_of_names_in_a_long_text(texts):
    text = "".join(f"w{i}, " for i in range(255)) + "Ada e Ada " * 300
    found = rows(texts([text]).withColumn("f", names.literal_finder(["ada"], [])(F.col("t"))), "f")[0][0]
    assert len(found) == 600 and all(text[h.span_start:h.span_end] == "Ada" for h in found)


def test_large_dictionary_is_not_collected(spark, monkeypatch):
    monkeypatch.setattr(names, "MAX_LITERAL_NAMES", 3)
    big = spark.range(5).selectExpr("concat('Nome', id) AS name", "'NAME' AS label")
    with pytest.raises(ValueError, match="find_by_join"):
        names.dictionary_finder(big)


def test_names_of_many_words(spark, texts):
    dictionary = spark.createDataFrame([("maria grazia de santis", "NAME")], "name STRING, label STRING")
    df = texts(["ciao Maria Grazia De Santis"])
    literal = rows(df.withColumn("f", names.dictionary_finder(dictionary)(F.col("t"))), "f")[0][0]
    joined = rows(names.find_by_join(df, "n", {"f": "t"}, dictionary), "f")[0][0]
    assert [h.value for h in literal] == [h.value for h in joined] == ["Maria Grazia De Santis"]


def test_names_of_any_length_by_a_join(spark, texts):
    """A name of 200 words beside 25 000 others, names inside names, breaks in runs, and a name in most phrases."""
    import time

    long = " ".join(f"parola{n}" for n in range(200))
    other = spark.range(25_000).selectExpr("concat('cliente', id, ' rossi') AS name", "'NAME' AS label")
    given = [(long, "NAME"), ("parola3", "ORG"), ("parola3 parola4", "NAME"), ("ada", "ORG"), ("ADA", "NAME"), ("", "NAME")]
    dictionary = other.union(spark.createDataFrame(given, "name STRING, label STRING"))
    title = long.title()
    values = [f"Caro {title}, ciao", title.replace(" ", "  ", 1), "Cliente77 Rossi e Cliente77. Rossi", "Ada " * 3000, "", None, title[:-1]]
    began = time.monotonic()
    df = texts(values)
    got = rows(names.find_by_join(df, "n", {"f": "t"}, dictionary), "f")
    assert time.monotonic() - began < 60
    parts = [("ORG", "Parola3"), ("NAME", "Parola3 Parola4")]
    hits = [[(h.label, h.value) for h in r[0]] for r in got]
    assert sorted(hits[0], key=lambda h: len(h[1])) == [*parts, ("NAME", title)] and sorted(hits[1], key=lambda h: len(h[1])) == parts
    assert hits[2] == [("NAME", "Cliente77 Rossi")] and hits[3] == [("NAME", "Ada")] * 3000 and hits[4:6] == [[], []]
    assert sorted(hits[6], key=lambda h: len(h[1])) == parts
    for text, (found,) in zip(values, got, strict=True):
        assert all(text[h.span_start : h.span_end] == h.value for h in found)


def test_scratch_tables_are_removed(spark, texts):
    import os

    from limpida.session import remove_scratch, scratch_folders

    remove_scratch()
    dictionary = spark.createDataFrame([("ada", "NAME")], "name STRING, label STRING")
    assert rows(names.find_by_join(texts(["Ada"]), "n", {"f": "t"}, dictionary), "f")[0][0][0].value == "Ada"
    made = scratch_folders()
    assert len(made) == 2 and all(os.listdir(p) for p in made)
    remove_scratch()
    assert not scratch_folders() and not any(os.path.exists(p) for p in made)


def test_name_confidence(texts, options):
    df = texts(["Luca Marte Ferdinando Bartolomeo"])
    found = names.literal_finder(["luca", "marte", "ferdinando bartolomeo"], [])
    df = df.withColumn("f", found(F.col("t")))
    hits = rows(df.withColumn("h", F.expr(pii.name_hits_sql("f", options))), "h")[0][0]
    assert [(h.value, round(h.confidence, 4)) for h in hits] == [("Marte", 0.75), ("Ferdinando Bartolomeo", 0.9)]


def test_only_names_that_can_be_met_are_joined(spark, texts, monkeypatch):
    """Names are cut down by the first words of the texts, where these are few; found are the same either way."""
    other = spark.range(2_000).selectExpr("concat('Cliente', id, ' rossi') AS name", "'NAME' AS label")
    given = [("Maria  Rosa", "NAME"), ("ada", "ORG"), ("ADA", "NAME"), ("ΟΔΟΣ Αθηνά", "NAME"), ("İda B", "NAME"), (None, "NAME"), ("e Maria", "NAME")]
    dictionary = other.union(spark.createDataFrame(given, "name STRING, label STRING"))
    values = ["Cliente7 Rossi, Ada e Maria", "ada. ΟΔΟΣ Αθηνά", "İDA B x", "Maria  Rosa", "Cliente7. Rossi", ""]
    read, tables = [], names.stored

    def noted(df, name):
        out = tables(df, name)
        read.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(names, "stored", noted)
    got = []
    for most in (names.MOST_FIRSTS, 0):
        monkeypatch.setattr(names, "MOST_FIRSTS", most)
        got.append([[(h.label, h.value) for h in r[0]] for r in rows(names.find_by_join(texts(values), "n", {"f": "t"}, dictionary), "f")])
    want = [[("NAME", "Cliente7 Rossi"), ("NAME", "Ada")], [("NAME", "ΟΔΟΣ Αθηνά")], [("NAME", "İDA B")], [], [], []]
    assert got == [want, want]
    assert [("LeftSemi" in plan) for name, plan in read if name == "known-names"] == [True, False]


def test_long_runs_and_many_hits_are_placed(texts):
    """Blocks of runs and of words end inside; runs of many words and texts of many runs take linear time."""
    import time

    def seconds(n):
        text = "".join(f"W{i}, à😀 Ada e. " for i in range(n)) + "Ada e " * n + "fine Ada"
        began = time.monotonic()
        found = rows(texts([text]).withColumn("f", names.literal_finder(["ada", "ada e"], [])(F.col("t"))), "f")[0][0]
        took = time.monotonic() - began
        assert len(found) == 4 * n + 1 and all(text[h.span_start : h.span_end] == h.value for h in found)
        return took

    for n in (1, 128, 256, 300):
        seconds(n)
    seconds(3000)
    assert seconds(12_000) < 4 * 2.3 * max(0.3, min(seconds(3000) for _ in range(2)))
