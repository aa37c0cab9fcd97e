import base64
import json
from email.headerregistry import HeaderRegistry

import pytest
from pyspark.sql import functions as F

from limpida.functions import body, headers as hd, mime
from limpida.plans import mail_tables as mt
from limpida.sources import messages as src
from limpida.streaming import jobs

MIXED = (
    b"Message-ID: <m1@x>\r\nFrom: =?utf-8?B?TWFyw61h?= <m@x.it>\r\nTo: a@x.it,\r\n\tb@x.it\r\n"
    b"Received: one\r\nReceived: two\r\nSubject: =?iso-8859-1?Q?citt=E0?= =?utf-8?Q?_bella?=\r\n"
    b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
    b"--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n"
    b"--C\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nperch=E9\r\n"
    b"--C\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>ciao</p>\r\n--C--\r\n"
    b"--B\r\nContent-Type: text/plain\r\nContent-Disposition: ATTACHMENT; filename=a.txt\r\n\r\nsecret\r\n"
    b"--B\r\nContent-Type: text/plain; charset=nonsense\r\n\r\nlost\r\n"
    b"--B\r\nContent-Type: text/plain\r\n\r\nfine\r\n--B--\r\n"
)


def test_parts_and_bodies(spark):
    raws = [bytearray(MIXED), bytearray(b"Content-Type: text/html\r\n\r\n<b>x</b>"), None, bytearray(b"")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n INT, raw BINARY")
    df = df.withColumn("p", mime.parse_message("raw")).orderBy("n")
    df = df.select(
        "p", mime.body_of(F.col("p.parts"), "text/plain").alias("plain"), mime.body_of(F.col("p.parts"), "text/html").alias("html")
    )
    first, second, third, fourth = df.collect()
    assert first.plain.replace("\n", "|") == "perché||fine" and first.html.strip() == "<p>ciao</p>"
    assert [(p.content_type, p.is_attachment) for p in first.p.parts][2] == ("text/plain", True)
    assert second.html == "<b>x</b>" and third.p.status is None and fourth.p.parts == []


def test_header_maps(spark):
    blocks = [MIXED.decode("ascii"), "A: 1\nB:2\n c\nA: 3\n\nbody: no", "no header here", "X: =?bad?Z?x?="]
    df = spark.createDataFrame(list(enumerate(blocks)), "n INT, b STRING")
    block = F.element_at(F.split("b", r"\r?\n\r?\n", 2), 1)
    got = [r.h for r in hd.with_header_map(df, block, "h").orderBy("n").collect()]
    assert got[0]["subject"] == "città bella" and got[0]["from"] == "María <m@x.it>"
    assert got[0]["to"] == "a@x.it,\tb@x.it" and got[0]["received"] == "one; two"
    assert got[1] == {"a": "1; 3", "b": "2 c"} and got[2] is None and got[3] == {"x": "=?bad?Z?x?="}


def test_address_lists(spark):
    df = spark.sql("SELECT ' a@x , ,b@y,' AS t UNION ALL SELECT CAST(NULL AS STRING)")
    assert sorted(r[0] for r in df.select(hd.split_addresses(F.col("t"))).collect()) == [[], ["a@x", "b@y"]]


@pytest.mark.parametrize(
    "plain, html, want",
    [
        ("only plain", "", "only plain"),
        ("", "only html", "only html"),
        (" \n", None, ""),
        ("one two three four five", "One TWO three", "one two three four five"),
        ("one two three four five", "one six", "one two three four five"),
        ("one two three four five", "six seven", "one two three four five\n\nsix seven"),
    ],
)
def test_merge_rules(spark, plain, html, want):
    df = spark.createDataFrame([(plain, html)], "p STRING, h STRING")
    assert df.select(body.merge_bodies(F.col("p"), F.col("h"))).head()[0] == want


def test_message_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MIXED)
    (tmp_path / "b.eml").write_bytes(b"Subject: x\n\n" + b"y" * 3000)
    (tmp_path / "c.txt").write_bytes(b"no message")
    rows = {r.subject: r for r in src.read_message_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"città bella", "x"}
    assert rows["città bella"].to_addrs == ["a@x.it", "b@x.it"] and rows["città bella"].body_text.strip() == "perché"
    assert len(rows["x"].body_text) == 3000 and rows["x"].message_id == "<unknown>" and rows["x"].size == 3012


def test_ingestion_json(spark, tmp_path):
    lines = [
        {"uid": 7, "uidvalidity": 1, "from": "a@x", "to": ["b@x", "c@x"], "headers": {"From": "a@x", "FROM": "z@x"},
         "body_text": "t" * 2000, "message_id": "<1>"},
        {"to": "b@x, ,c@x", "body_html_preview": "h" * 499, "message_id": "<2>"},
        {"message_id": "<3>"},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    first, second, third = src.read_ingestion(spark, str(tmp_path)).orderBy("message_id").collect()
    assert first.uid == "7" and first.to_addrs == ["b@x", "c@x"] and first.headers == {"from": "z@x"} and first.body_truncated
    assert second.to_addrs == ["b@x", "c@x"] and second.from_addr == "unknown@unknown.com" and not second.body_truncated
    assert third.to_addrs == [] and third.headers == {} and third.subject == "(no subject)" and third.uid == "0"


def test_requests(spark):
    rows = [
        ("<1>", "From: a@x\r\nFrom: b@x\r\nTo: c@x\r\n", "text", base64.b64encode(MIXED).decode()),
        ("<2>", "nothing", "text", "!!abcde"),
        ("<3>", "Subject: s", "text", None),
    ]
    df = spark.createDataFrame(rows, "message_id STRING, headers_raw STRING, body_text STRING, raw_bytes STRING")
    first, second, third = src.requests_to_messages(df).orderBy("message_id").collect()
    assert first.from_addr == "b@x" and bytes(first.raw_bytes) == MIXED and first.size == 4
    assert second.headers == {} and second.raw_bytes is None and second.to_addrs == ["unknown@unknown.com"]
    assert third.subject == "s" and third.uid == "api-request"


def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    for parts in (1, 3):
        base = tmp_path / f"sf{parts}"
        rows = spark.range(10).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(parts)
        rows.write.parquet(str(base / "documents.parquet"))
        if parts == 1:
            (one,) = (base / "documents.parquet").glob("part-*")
            content = one.read_bytes()
            base = tmp_path / "single"
            base.mkdir()
            (base / "documents.parquet").write_bytes(content)
        stream = mt.table_stream(spark, str(base), "documents")
        found = jobs.run_to_table(stream, f"{base}/out", f"{base}/state")
        assert sorted(r.doc_id for r in found.collect()) == list(range(10))


def test_messages_come_to_python_in_small_batches(spark):
    raws = spark.createDataFrame([(bytearray(MIXED),)], "raw BINARY")
    for df in (raws.select(mime.parse_message("raw")), hd.with_header_map(raws, hd.header_block(F.col("raw")), "h")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_part_types_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(mime, "_parse_header", lambda name, value: parsed.append(name) or HeaderRegistry()(name, value))
    mime._known_header.cache_clear()
    found = [mime._leaves(MIXED) for _ in range(3)]
    assert found[0] == found[1] == found[2] and len(found[0]["parts"]) == 5 and len(parsed) < 15
    long = b"Content-Type: text/plain; name=" + b"a" * 500 + b"\r\n\r\nx"
    known = mime._known_header.cache_info().currsize
    assert mime._leaves(long)["parts"][0][3] == "x" and mime._known_header.cache_info().currsize == known
    broken = b"Content-Type: text/plain; a*1*\r\n\r\nx"
    assert [mime._leaves(broken)["status"] for _ in range(2)] == ["failed"] * 2
    mime._known_header.cache_clear()
