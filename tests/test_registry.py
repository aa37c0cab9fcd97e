"""The registered queries run, and a sample of them equals its SQL in another engine."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
SAMPLE = ("canonical_text_marked", "pii_merged", "redacted_headers", "page_text", "message_parts", "first_per_body", "stream_hourly_counts")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(run) for run in entry.queries().values())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
def test_sample_against_sql():
    script = Path(__file__).with_name("oracle_check.py")
    done = subprocess.run([sys.executable, str(script), str(SMALL), *SAMPLE], capture_output=True, text=True, timeout=600)
    assert sorted(line.split()[:2] for line in done.stdout.splitlines()) == sorted(["ok", n] for n in SAMPLE), done.stdout
