"""Messages of the registered queries on the smallest tables."""

from pathlib import Path

import pytest

from limpida.plans import queries

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
@pytest.mark.parametrize("make", [queries._flawed, queries._degraded])
def test_bad_rows_keep_their_html(spark, make):
    rows = make(spark, str(SMALL)).select("doc_id", "body_html").collect()
    assert all((r.body_html != "") == (r.doc_id % 5 < 2 and r.doc_id % 10 != 1) for r in rows)
