"""Masking of any JSON, ordinals, replays, names and spikes on a stream, sketches that add up."""

import json
import random

import pytest
from pyspark.sql import functions as F

from limpida.functions.patterns import SENSITIVE_FIELDS
from limpida.operators import incremental, masking, names, order
from limpida.plans import documents as docs, replay
from limpida.session import scratch_folders
from limpida.streaming import jobs
from test_documents import HEAD, SCHEMA


def masked(value, depth=10**6):
    if not isinstance(value, dict):
        return value
    if depth == 0:
        return masking.MASK
    return {k: masking.MASK if k.lower() in SENSITIVE_FIELDS else masked(v, depth - 1) for k, v in value.items()}


def random_json(pick, depth):
    kind = pick.choice(["object"] * 3 + ["list", "text", "number", "null", "bool"]) if depth else pick.choice(["text", "number"])
    if kind == "object":
        return {pick.choice(["Token", "a", "b", "PASSWORD", "ü", "email", "x{", 'q"', "list"]): random_json(pick, depth - 1) for _ in range(pick.randint(0, 4))}
    if kind == "list":
        return [random_json(pick, depth - 1) for _ in range(pick.randint(0, 3))]
    return {"text": pick.choice(["", "{}", 'a"b\\', "é😀", "}{\n"]), "number": pick.choice([0, -5, 2**40, 1.25]), "null": None, "bool": True}[kind]


def test_json_of_any_shape_is_masked(spark):
    pick = random.Random(1)
    values = [random_json(pick, 6) for _ in range(300)] + [{"a": {"b": {"c": {"secret": [1, {"token": 2}], "d": 1}}}}, [{"token": 1}], "token"]
    texts = [json.dumps(v, ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, 2])) for v in values]
    bad = ['{"token": "x"', "", '{"a": 1, "a": {"token": 2}}', "no json"]
    df = spark.createDataFrame(list(enumerate(texts + bad + [None])), "n INT, t STRING").repartition(4)
    rows = {r.n: r for r in masking.with_masked_json(df, "t", "m").withColumn("cut", masking.mask_any_json(F.col("t"), 1)).collect()}
    for n, value in enumerate(values):
        assert json.loads(rows[n].m) == masked(value) and json.loads(rows[n].cut) == masked(value, 1)
    assert [rows[len(texts) + k].m for k in range(5)] == [f'"{masking.MASK}"'] * 4 + [None]


def test_deep_json_is_masked_whole_below_the_bound(spark):
    text = '{"a":' * 200 + '{"token":"t","b":1}' + "}" * 200
    df = spark.createDataFrame([(text,), ('{"a":"' + '\\"{' * 50_000 + '"}',)], "t STRING")
    assert [r.d for r in df.select(masking.json_depth(F.col("t")).alias("d")).collect()] == [201, 1]
    got = masking.with_masked_json(df, "t", "m").first().m
    assert got == '{"a":' * masking.MOST_DEPTH + f'"{masking.MASK}"' + "}" * masking.MOST_DEPTH


def test_ordinals_have_no_gaps(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS k", "IF(id % 7 = 0, NULL, id) AS v").repartition(7)
    rows = order.with_ordinal(df, ["k", "v"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(5000))
    assert [(r.k, r.v is not None, r.v or 0) for r in rows] == sorted((r.k, r.v is not None, r.v or 0) for r in rows)
    scan = spark.range(0, 100, 1, 9).withColumn("x", F.col("id") * 2)
    assert [(r.id, r.ordinal) for r in order.with_ordinal(scan).orderBy("id").collect()] == [(n, n) for n in range(100)]
    assert order.with_ordinal(scan.where("false"), ["id"]).collect() == []


def mail(spark, bodies):
    rows = [(str(n), "1", "IN", f"<{n}>", "2026-02-17T10:00:00Z", 1, b, "", HEAD, None, False) for n, b in enumerate(bodies)]
    return spark.createDataFrame([*rows, (None, "1", "IN", "<x>", None, 1, "two", "", HEAD, None, False)], SCHEMA)


def failing_on(*words):
    def model(text):
        if any(w in text for w in words):
            raise ValueError
        return []

    return names.model_finder(model)


def test_replays_count_attempts_and_double_no_row(spark, options, tmp_path):
    path, messages = str(tmp_path / "docs"), mail(spark, ["good", "one", "two", "never", None])

    def build(*words):
        return lambda m: docs.build_documents(m, options, failing_on(*words))

    def now():
        return {r.uid: (r.status, r.attempt) for r in replay.read_attempts(spark, path).collect()}

    replay.write_attempt(build("one", "two", "never")(messages), path)
    assert now() == {"0": ("ok", 1), "1": ("quarantined", 1), "2": ("quarantined", 1), "3": ("quarantined", 1), "4": ("rejected", 1), None: ("quarantined", 1)}
    for _ in range(2):  # the second run stands for one that broke off and is run again
        replay.replay(messages, path, build("two", "never"), 2)
        assert now() == {"0": ("ok", 1), "1": ("ok", 2), "2": ("quarantined", 2), "3": ("quarantined", 2), "4": ("rejected", 2), None: ("quarantined", 2)}
    replay.replay(messages, path, build("never"), 3)
    want = {"0": ("ok", 1), "1": ("ok", 2), "2": ("ok", 3), "3": ("quarantined", 3), "4": ("rejected", 3), None: ("ok", 3)}
    assert now() == want and replay.read_attempts(spark, path).count() == 6
    assert replay.due(spark, path, 4).isEmpty()
    replay.replay(messages, path, build("never"), 4)
    assert now() == want


def test_names_table_on_a_stream(spark, options, tmp_path):
    folder, names_path, out, state = (str(tmp_path / n) for n in ("in", "names", "out", "state"))
    jobs.write_names(spark.createDataFrame([("ada bianchi", "NAME")], "name STRING, label STRING"), names_path, 1)

    def arrive(first, bodies):
        mail(spark, bodies).where("uid IS NOT NULL").withColumn("uid", F.col("uid") + first).select(*(f.split()[0] for f in SCHEMA.split(", "))).withColumn("uid", F.col("uid").cast("string")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        before = set(scratch_folders())
        jobs.clean_stream_with_names(stream, options, names_path, out, state, availableNow=True).awaitTermination()
        assert set(scratch_folders()) == before
        return {int(float(r.uid)): r.body_text_canonical for r in jobs.read_batches(spark, out).collect()}

    assert arrive(0, ["Ada Bianchi qui", "Ugo Neri qui"]) == {0: "[PII_NAME] qui", 1: "Ugo Neri qui"}
    jobs.write_names(spark.createDataFrame([("ugo neri", "NAME")], "name STRING, label STRING"), names_path, 2)
    assert jobs._version_of(spark, names_path, out, 0) == 1
    assert arrive(10, ["Ada Bianchi qui", "Ugo Neri qui"]) == {0: "[PII_NAME] qui", 1: "Ugo Neri qui", 10: "Ada Bianchi qui", 11: "[PII_NAME] qui"}


def test_spikes_with_a_day_of_state(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(day, n):
        rows = f"SELECT TIMESTAMP'2026-02-{day} 10:00:00' AS ts, 'mail' AS type FROM range({n}) UNION ALL SELECT TIMESTAMP'2026-02-{day} 12:00:00', 'mail'"
        spark.sql(rows).coalesce(1).write.mode("append").parquet(folder)
        found = jobs.spikes_in_stream(spark.readStream.schema("ts TIMESTAMP, type STRING").parquet(folder))
        run = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
        held = sum(o["numRowsTotal"] for o in (run.lastProgress or {}).get("stateOperators", []))
        got = spark.read.schema(found.schema).parquet(out).collect()
        return sorted((str(r.hour), r.type, r.n, r.n_day_before) for r in got), held

    assert arrive(10, 3)[0] == []
    assert arrive(11, 7)[0] == [("2026-02-11 10:00:00", "mail", 7, 3)]
    first = arrive(12, 15)
    assert first[0] == [("2026-02-11 10:00:00", "mail", 7, 3), ("2026-02-12 10:00:00", "mail", 15, 7)]
    for day in range(13, 18):
        rows, held = arrive(day, 15)
    assert len(rows) == 2 and held <= first[1]


def test_sketches_add_up(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS k", "id % 11 AS day", "CAST(id % 9973 AS STRING) AS v", "IF(id % 100 = 0, NULL, sqrt(id)) AS x")
    day = F.col("day")
    for row in incremental.distinct_of_days(incremental.daily_distinct(df, day, "v", "k"), "k").collect():
        assert row.n == 20_000 and abs(row.n_values - 9973) <= 3 * incremental.HLL_ERROR * 9973
    daily = incremental.daily_quantiles(df, day, "x", "k")
    exact = {k: sorted(r.x for r in df.where(f"k = {k} AND x IS NOT NULL").collect()) for k in range(3)}
    for row in incremental.quantiles_of_days(daily, [0.5, 0.99], "k").collect():
        values = exact[row.k]
        assert row.n == len(values)
        for q, got in ((0.5, row.p50), (0.99, row.p99)):
            assert abs(sum(v <= got for v in values) / len(values) - q) <= incremental.KLL_ERROR
    some = incremental.daily_quantiles(df.where("day < 3"), day, "x").unionByName(incremental.daily_quantiles(df.where("day >= 3"), day, "x"))
    assert incremental.quantiles_of_days(some, [0.5]).first().n == sum(map(len, exact.values()))
