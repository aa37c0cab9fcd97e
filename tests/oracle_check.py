"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

The engines run in different processes: Spark writes parquet, DuckDB reads it.
"""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

COMPARE = r"""
import hashlib, json, sys
import duckdb
sf, out, jobs = sys.argv[1], sys.argv[2], json.load(open(sys.argv[3]))
con = duckdb.connect()
con.execute("SET enable_progress_bar = false")
for t in sys.argv[4].split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)

def rows(rel):
    names = sorted(rel.columns)
    order = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())

for name, sql in jobs.items():
    try:
        got = rows(con.sql(f"SELECT * FROM '{out}/{name}/*.parquet'"))
        want = rows(con.sql(sql))
        if got == want:
            print(f"ok   {name} {len(got[1])}")
        else:
            print(f"DIFF {name} columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}")
            a, b = set(got[1]), set(want[1])
            for r in sorted(a - b)[:3]:
                print("   spark ", str(r)[:700])
            for r in sorted(b - a)[:3]:
                print("   oracle", str(r)[:700])
    except Exception as e:
        print(f"FAIL {name} {str(e)[:600]}")
    sys.stdout.flush()
"""


def check(sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Lines of the comparison, one or more per query."""
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from limpida.session import local_session

    spark = local_session(8)
    out = tempfile.mkdtemp(prefix="run-")
    queries, oracle = entry.queries(), entry.oracle_sql()
    lines, jobs = [], {}
    for name, run in queries.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = run(spark, sf_dir)
            result.write.parquet(f"{out}/{name}")
            if name in oracle:
                jobs[name] = oracle[name]
            else:
                n = spark.read.parquet(f"{out}/{name}").count()
                lines.append(f"rows {name} {n}")
        except Exception as problem:
            lines.append(f"FAIL {name} (spark) {str(problem)[:900]}")
        print(f"  {name} {time.time() - started:.1f}s", file=sys.stderr, flush=True)
    Path(f"{out}/jobs.json").write_text(json.dumps(jobs))
    done = subprocess.run(
        [sys.executable, "-c", COMPARE, sf_dir, out, f"{out}/jobs.json", " ".join(TABLES)],
        capture_output=True,
        text=True,
        timeout=3000,
    )
    return lines + done.stdout.splitlines() + done.stderr.splitlines()[-5:]


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for line in check(sf, sys.argv[2:]):
        print(line)
