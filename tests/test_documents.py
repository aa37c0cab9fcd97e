import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from limpida import CleaningOptions, PiiMode
from limpida.functions import html
from limpida.operators import compare, dedup, masking, names, reports, validate
from limpida.plans import documents as docs
from limpida.session import stored
from limpida.sources import messages as src, sinks
from limpida.streaming import jobs
from samples import SALT

SCHEMA = (
    "uid STRING, uidvalidity STRING, mailbox STRING, message_id STRING, fetched_at STRING, size BIGINT,"
    " body_text STRING, body_html STRING, headers MAP<STRING,STRING>, raw_bytes BINARY, body_truncated BOOLEAN"
)
HEAD = {"from": "Mario <m@x.it>", "to": "a@x.it, b@x.it", "subject": "Tel 0551234567", "date": "d", "x-id": "k@x.it"}
RAW = bytearray(b"Content-Type: text/plain\r\n\r\nfrom raw 12345678901")


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        ("1", "1", "IN", "<1>", "2026-02-17T10:00:00Z", 1, "ciao m@x.it\n> q m@x.it", "", HEAD, None, False),
        ("2", "1", "IN", "<2>", "2026-02-17T11:00:00Z", 1, "cut", "", HEAD, RAW, True),
        ("3", "1", "IN", "", "2026-02-17T11:00:00Z", 1, "x", "", HEAD, None, False),
        ("4", "1", "IN", "<4>", None, 1, None, "", HEAD, None, False),
        ("5", "1", "IN", "<5>", "bad", 1, "x", "", {}, None, False),
        ("6", "1", "IN", "<6>", "2026-02-18T10:00:00Z", 1, "ciao m@x.it", "<p>uno due tre &amp; quattro</p>", {"x-id": "1"}, None, False),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def by_uid(df):
    return {r.uid: r for r in df.collect()}


def test_documents(messages, options):
    rows = by_uid(docs.build_documents(messages, options))
    one, two, six = rows["1"], rows["2"], rows["6"]
    assert one.body_text_canonical == "ciao [PII_EMAIL]" and one.from_addr_redacted == "Mario <[PII_EMAIL]>"
    assert one.body_original_hash == hashlib.sha256(b"ciao [PII_EMAIL]").hexdigest()
    assert one.to_addrs_redacted == ["[PII_EMAIL]", "[PII_EMAIL]"] and one.subject_canonical == "Tel [PII_PHONE_IT]"
    assert one.headers_canonical["x-id"] == "k@x.it" and one.removed_sections[0].content_preview == "> q [PII_EMAIL]"
    assert two.body_text_canonical == "from raw [PII_PIVA]" and two.body_source == "raw"
    assert six.from_addr_redacted == "[PII_EMAIL]" and six.body_text_canonical == "ciao [PII_EMAIL]\n\nuno due tre & quattro"
    errors = {u: r.error for u, r in rows.items() if r.status != "ok"}
    assert errors == {"3": "Missing message_id", "4": "Empty email body", "5": "Missing headers"}
    assert rows["3"].body_text_canonical == "[PREPROCESSING ERROR: Missing message_id]"
    assert rows["3"].headers_canonical == {"preprocessing-error": "Missing message_id"} and rows["3"].body_original_hash == ""


def test_modes(messages, options):
    only = by_uid(docs.build_documents(messages, replace(options, pii_mode=PiiMode.DETECT_ONLY)))["1"]
    assert only.body_text_canonical == "ciao m@x.it" and only.pii_entities[0].redacted == "m@x.it"
    assert only.from_addr_redacted == "Mario <m@x.it>" and only.removed_sections[0].content_preview == "> q m@x.it"
    off = by_uid(docs.build_documents(messages, replace(options, pii_mode="disabled")))["1"]
    assert off.body_text_canonical == "ciao m@x.it" and off.pii_entities == []
    kept = by_uid(docs.build_documents(messages, replace(options, remove_quotes=False)))["1"]
    assert "> q" in kept.body_text_canonical


def test_names_reach_body_and_headers(messages, options):
    finder = names.literal_finder(["mario"], [])
    rows = by_uid(docs.build_documents(messages.withColumn("body_text", F.lit("caro Mario!")), options, finder))
    assert rows["1"].body_text_canonical == "caro [PII_NAME]!" and rows["1"].from_addr_redacted == "[PII_NAME] <[PII_EMAIL]>"


def test_safe_levels(messages, options):
    def model(text):
        if "ciao" in text:
            raise MemoryError
        return []

    rows = by_uid(docs.build_documents(messages, options, names.model_finder(model), safe=True))
    assert {u: r.processing_level for u, r in rows.items()} == {
        "1": "regex_only", "2": "full", "3": "full", "4": "minimal", "5": "full", "6": "regex_only",
    }
    assert rows["1"].body_text_canonical == "ciao [PII_EMAIL]\n> q [PII_EMAIL]" and rows["1"].removed_sections == []
    assert rows["4"].body_text_canonical == "[BODY UNAVAILABLE]"


def test_failed_names_are_withheld(messages, options):
    def model(text):
        raise MemoryError

    named = messages.withColumn("body_text", F.lit("caro Mario Rossi"))
    for rows in (by_uid(docs.build_documents(named, options, names.model_finder(model))),):
        assert {r.status for r in rows.values()} <= {"quarantined", "rejected"}
        assert rows["1"].status == "quarantined" and rows["1"].error == "pii: name detection failed"
        assert not [r for r in rows.values() if "Mario" in str(r)]
    safe = by_uid(docs.build_documents(messages, options, names.model_finder(model), safe=True))
    assert not [r for r in safe.values() if "Mario" in str(r.headers_canonical) + r.from_addr_redacted]


BROKEN = bytearray(b"Content-Type: text/plain; a*1*\r\n\r\nMario Rossi")


def test_bytes_that_cannot_be_parsed(messages, options):
    broken = messages.withColumn("raw_bytes", F.lit(bytes(BROKEN))).withColumn("body_text", F.lit("ciao m@x.it"))
    rows = by_uid(docs.build_documents(broken, options))
    assert (rows["1"].status, rows["1"].error, rows["1"].pii_status) == ("quarantined", "parse: IndexError", "ok")
    assert rows["3"].status == "rejected" and {r.severity for r in docs.quarantine(docs.build_documents(broken, options)).collect()} == {"high", "low"}
    safe = by_uid(docs.build_documents(broken, options, safe=True))
    assert safe["1"].status == "ok" and safe["1"].body_source == "fallback" and safe["1"].body_text_canonical == "ciao [PII_EMAIL]"


def test_texts_that_are_no_utf8(messages, options):
    """Bytes that no Python stage can read cost the message its canonical text at most, not the job."""
    broken = messages.where("uid = '1'").withColumn("body_text", F.expr("CAST(concat(CAST('e\u0301 m@x.it ' AS BINARY), X'FF') AS STRING)"))
    broken = broken.withColumn("body_html", F.expr("CAST(concat(CAST('<p a=\\'>uno due' AS BINARY), X'FE', CAST('</p>' AS BINARY)) AS STRING)"))
    finder = names.model_finder(lambda t: [])
    one = docs.build_documents(broken, options, finder, safe=True).select("processing_level", F.contains("body_text_canonical", F.lit("m@x.it")), "status").first()
    assert tuple(one) == ("no_canon", False, "ok")
    whole = docs.build_documents(broken, options, finder).select(F.contains("body_text_canonical", F.lit("m@x.it")), "status").first()
    assert tuple(whole) == (False, "ok")


def test_raw_mail_keeps_its_body_without_names(messages, options):
    def model(text):
        raise MemoryError

    raw = messages.withColumn("body_text", F.lit("")).withColumn("raw_bytes", F.lit(bytes(RAW)))
    one = by_uid(docs.build_documents(raw, options, names.model_finder(model), safe=True))["1"]
    assert (one.processing_level, one.body_text_canonical, one.pii_status) == ("regex_only", "from raw [PII_PIVA]", "failed")


def test_dictionary_table_of_any_size(spark, messages, options, monkeypatch):
    monkeypatch.setattr(names, "MAX_LITERAL_NAMES", 2)
    people = ["mario", "maria grazia de santis", "ugo x", "ada"]
    table = spark.createDataFrame([(n, "NAME") for n in people], "name STRING, label STRING")
    far = "x " * 300_000
    named = messages.withColumn("body_text", F.lit(f"ciao Maria Grazia De Santis {far}Mario"))
    named = named.unionByName(named.where("uid = '1'"))
    rows = docs.build_documents(named, options, table).where("status = 'ok'").collect()
    assert sorted(r.uid for r in rows) == ["1", "1", "2", "4", "6"]
    for r in rows:
        if r.uid != "2":
            assert r.body_text_canonical.startswith("ciao [PII_NAME] x") and "x [PII_NAME]" in r.body_text_canonical
            assert r.uid == "6" or r.from_addr_redacted == "[PII_NAME] <[PII_EMAIL]>"
    detected = docs.build_documents(messages, replace(options, pii_mode=PiiMode.DETECT_ONLY), table)
    assert by_uid(detected)["1"].from_addr_redacted == "Mario <m@x.it>"


def test_message_files_are_parsed_once(spark, options):
    files = spark.createDataFrame([("f", RAW)], "path STRING, content BINARY").selectExpr(
        "path", "current_timestamp() AS modificationTime", "length(content) AS length", "content"
    )
    read = src.files_to_messages(files.withColumn("content", F.concat(F.lit(b"Message-ID: <1>\r\nFrom: a@x.it\r\n"), "content")))
    built = docs.build_documents(read, options)
    assert built.head().body_text_canonical == "from raw [PII_PIVA]" and built.head().status == "ok"
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [parse_message") == 1


def test_html_that_cannot_be_read_is_quarantined(messages, options, monkeypatch):
    monkeypatch.setattr(html, "_parse_batch", F.udf(lambda markup: None, "string").asNondeterministic())
    mixed = messages.withColumn("body_html", F.when(F.col("uid") == "1", "uno < due").otherwise(F.col("body_html")))
    rows = by_uid(docs.build_documents(mixed, options))
    assert (rows["1"].status, rows["1"].error, rows["1"].body_source) == ("quarantined", "parse: html", "fallback")
    assert rows["1"].body_text_canonical == "[PREPROCESSING ERROR: parse: html]"
    assert rows["6"].status == "ok" and rows["6"].body_text_canonical == "ciao [PII_EMAIL]\n\nuno due tre & quattro"
    safe = by_uid(docs.build_documents(mixed, options, safe=True))["1"]
    assert (safe.status, safe.body_source, safe.body_text_canonical) == ("ok", "fallback", "ciao [PII_EMAIL]")
    assert docs.with_merged_body(docs.with_bodies(mixed)).where("parse_error = 'parse: html'").count() == 1


def test_write_read_and_quarantine(spark, messages, options, tmp_path):
    sinks.write_documents(docs.build_documents(messages, options), str(tmp_path / "d"))
    assert sinks.read_documents(spark, str(tmp_path / "d")).count() == 3
    assert {r.severity for r in sinks.read_quarantine(spark, str(tmp_path / "d")).collect()} == {"low"}


def test_stream_gives_the_rows_of_the_batch(spark, messages, options, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.clean_stream(stream, options, out, str(tmp_path / "state"), availableNow=True).awaitTermination()
    columns = ["uid", "body_text_canonical", "headers_canonical", "pii_entities", "status"]
    batch = docs.build_documents(messages, options)
    assert compare.differing_rows(spark.read.parquet(out), batch, columns).isEmpty()


def test_windows_and_spikes(spark, tmp_path):
    events = spark.sql(
        "SELECT timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,i) AS ts, i % 10 = 0 AS is_error, i * 1.0D AS duration,"
        " 'EMAIL' AS type FROM (SELECT explode(sequence(0, 3000)) AS i)"
    )
    rates = {(r.n, r.n_errors) for r in jobs.error_rate(events).collect()}
    assert (5, 1) in rates and (5, 0) not in rates  # one event a minute, every tenth an error
    assert [r.p99 >= 60 for r in jobs.slow_windows(events, limit=60.0).collect()].count(False) == 0
    counts = jobs.hourly_counts(events)
    later = counts.selectExpr("hour + INTERVAL 24 HOURS AS hour", "type", "n * 3 AS n")
    assert jobs.spikes(counts.unionAll(later)).count() == counts.count()
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    first = jobs.run_to_table(jobs.distinct_messages(stream, ["type", "is_error"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert first.count() == 2


def test_spikes_of_a_stream(spark, tmp_path):
    """Two runs of one stream: the second finds the spike against the hour that the first stored."""
    schema = "ts TIMESTAMP, type STRING"
    folder, out = str(tmp_path / "in"), [str(tmp_path / n) for n in ("counts", "spikes", "state")]

    def arrive(day, n):
        rows = f"SELECT TIMESTAMP'2026-02-{day} 10:00:00' AS ts, 'mail' AS type FROM range({n}) UNION ALL SELECT TIMESTAMP'2026-02-{day} 12:00:00', 'mail'"
        spark.sql(rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.watch_spikes(jobs.hourly_counts(stream), *out, availableNow=True).awaitTermination()
        return [(str(r.hour), r.type, r.n, r.n_day_before) for r in jobs.read_spikes(spark, out[1]).collect()]

    assert arrive(10, 3) == []
    assert arrive(11, 7) == [("2026-02-11 10:00:00", "mail", 7, 3)]


@pytest.mark.parametrize("most", [dedup.BROADCAST_VALUES, 10])
def test_first_per_key_survives_a_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "BROADCAST_VALUES", most)
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id DIV 2 AS STRING)) AS k", "30000 - id AS o", "id AS v", "map('a', id) AS m")
    kept = {r.k: r.v for r in dedup.keep_first(df, ["k"], ["o"]).collect()}
    want = {}
    for i in range(30_000):
        want["hot" if i % 3 == 0 else str(i // 2)] = i
    assert kept == want


def test_first_per_key_is_narrow(spark, tmp_path, monkeypatch):
    """Null keys, null orders and ties; whole rows are never sorted, aggregated or exchanged."""
    rows = [(None, 2, "a"), (None, 1, "b"), ("x", None, "c"), ("x", 1, "d"), ("y", 5, "e"), ("z", 7, "f"), ("z", 7, "f")]
    spark.createDataFrame(rows, "k STRING, o INT, text STRING").write.parquet(f"{tmp_path}/rows")
    plans = []

    def written(table, name):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return stored(table, name)

    monkeypatch.setattr(dedup, "stored", written)
    df = spark.read.parquet(f"{tmp_path}/rows")
    kept = dedup.keep_first(df, ["k"], ["o"])
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, 1, "b"), ("x", None, "c"), ("y", 5, "e"), ("z", 7, "f")], key=str)
    assert kept.columns == df.columns
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert not any("SortAggregate" in p for p in plans)
    for plan in plans:
        assert not any("Exchange" in line and "text" in line for line in plan.splitlines())
    assert "WindowGroupLimit" in plans[2]
    assert dedup.keep_first(df.where("false"), ["k"], ["o"]).isEmpty()


def test_compare(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 'x', map('k', 1)), (2, 'y', map('k', 2)), (2, 'y', map('k', 2)) AS t(k, v, m)")
    b = spark.sql("SELECT * FROM VALUES (1, 'x', map('k', 1)), (2, 'z', map('k', 2)) AS t(k, v, m)")
    assert compare.is_deterministic([a, a], ["k", "v", "m"]) and not compare.is_deterministic([a, b], ["k", "v", "m"])
    drift = {r.column_name: (r.n_keys, r.n_differing) for r in compare.drift_by_column(a, b, "k", ["v", "m"]).collect()}
    assert drift == {"v": (2, 1), "m": (2, 1)}
    missing = compare.missing_findings(a.select("k", "v"), b, ["k", "v"])
    assert {r.k for r in missing.collect()} == {2}


def test_reports(spark, messages, options):
    built = docs.build_documents(messages, options)
    report = {(r.type, r.detection_method): r for r in reports.pii_report(built.select(F.inline("pii_entities"))).collect()}
    assert report[(None, None)].n == 3 and report[("EMAIL", "regex")].distinct_values == 1
    assert reports.batch_totals(built).head().success_count == 3
    stats = {r.message_id: r for r in reports.document_stats(built).collect()}
    assert stats["<1>"].pii_types == ["EMAIL"] and stats["<1>"].header_count == 5


def test_masking(spark):
    df = spark.sql("SELECT 'a' AS Email, named_struct('token', 't', 'x', map('Secret', 's', 'k', 'v')) AS s, map('phone', 1) AS m, array('e') AS l")
    row = masking.mask_sensitive(df).head()
    assert row.Email == "[REDACTED]" and row.s.token == "[REDACTED]" and row.s.x == {"Secret": "[REDACTED]", "k": "v"}
    assert row.m == {"phone": None} and row.l == ["e"]


@pytest.mark.parametrize(
    "message, level, retry",
    [("Out of Memory", "critical", False), ("PII broke", "high", True), ("canon step", "medium", True),
     ("Validation of x", "low", False), (None, "low", True)],
)
def test_severity(spark, message, level, retry):
    df = spark.createDataFrame([(message,)], "m STRING")
    row = df.select(validate.severity(F.col("m")), validate.may_retry(F.col("m"), F.lit(1)), validate.may_retry(F.col("m"), F.lit(3))).head()
    assert tuple(row) == (level, retry, False)


def test_options_reject_weak_salts_and_bad_bounds():
    for bad in ({"pii_salt": "short"}, {"pii_salt": "some-project-2026-pii-salt"}, {"pii_salt": SALT, "max_body_size_kb": 9},
                {"pii_salt": SALT, "ner_confidence_threshold": 1.1}, {"pii_salt": SALT, "pii_mode": "other"}):
        with pytest.raises(ValueError):
            CleaningOptions(**bad)
    assert SALT not in repr(CleaningOptions(pii_salt=SALT))
    assert CleaningOptions(pii_salt=SALT, ner_confidence_threshold=0.0).effective_threshold == 0.75


def test_filters_do_not_repeat_the_work(messages, options):
    """Neither a filter on a derived column nor a second Python stage copies the chain."""
    built = docs.build_documents(messages, options, names.model_finder(lambda t: []))
    plan = built.filter(F.size("pii_entities") > 0).filter("body_text_canonical LIKE '%x%'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Il giorno") <= 2 and text.count("ArrowEvalPython") <= 12
