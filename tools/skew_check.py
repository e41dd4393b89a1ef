"""Skew check: every registered query on a copy of a driver scale where
one key holds about a third of the rows, compared with DuckDB.

    python tools/skew_check.py [base_sf_dir] [copies]

Builds, in a fresh /tmp folder (never under the repository):
  events    = `copies` shifted copies; user 0 gets ~1/3 of all events
  lineitem  = `copies` copies; order 0 (one task id) gets ~1/3 of the lines
  documents = source 'src0' gets ~1/3 of the documents
Other tables are linked unchanged.  Then runs tools/check_oracle.py on it.
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

import duckdb


def build(base: str, copies: int) -> str:
    out = tempfile.mkdtemp(prefix="skew-", dir="/tmp")
    con = duckdb.connect()
    con.execute(f"""COPY (
      SELECT (c * 100000000 + event_id)::BIGINT AS event_id, ts + to_days(c * 31) AS ts,
             CASE WHEN hash(c, event_id) % 3 = 0 THEN 0 ELSE user_id END AS user_id,
             event_type, value, props
      FROM read_parquet('{base}/events.parquet'), range({copies}) t(c))
      TO '{out}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (
      SELECT CASE WHEN hash(c, l_orderkey, l_linenumber, l_partkey) % 3 = 0 THEN 0
                  ELSE l_orderkey END AS l_orderkey,
             l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
             l_returnflag, l_linestatus, l_shipdate
      FROM read_parquet('{base}/lineitem.parquet'), range({copies}) t(c))
      TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (
      SELECT doc_id, text, lang, CASE WHEN hash(doc_id) % 3 = 0 THEN 'src0' ELSE source END AS source,
             n_chars
      FROM read_parquet('{base}/documents.parquet'))
      TO '{out}/documents.parquet' (FORMAT parquet)""")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "embeddings", "pages",
              "benchmark", "labels", "conversations"):
        os.symlink(f"{base}/{t}.parquet", f"{out}/{t}.parquet")
    return out


def main():
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    out = build(base.rstrip("/"), copies)
    print("skewed tables in", out, flush=True)
    here = os.path.dirname(os.path.abspath(__file__))
    subprocess.run([sys.executable, os.path.join(here, "check_oracle.py"), out], check=False)


if __name__ == "__main__":
    main()
