"""Run registered queries beside their SQL on DuckDB and compare whole results.

usage: python check_queries.py [--sf 0.01] [name-substring ...]
"""

from __future__ import annotations

import argparse
import time

import duckdb
import pyarrow as pa

from eventlens.plans import ORACLES, QUERIES
from eventlens.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(t: pa.Table):
    names = sorted(t.column_names)
    rows = sorted((tuple(map(repr, r.values())) for r in t.select(names).to_pylist()))
    return names, {n: str(t.schema.field(n).type) for n in names}, rows


def _dtype(s: str) -> str:
    return s.replace("large_string", "string").replace("timestamp[us, tz=UTC]", "timestamp[us]").replace(" not null", "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    d = f"/root/testdata/sf{a.sf}"
    spark = build_session("check", "local[8]")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if a.names and not any(x in name for x in a.names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, d).toArrow()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {str(e)[:1500]}")
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"rows {name}: {got.num_rows} rows {t1 - t0:.2f}s (no SQL)")
            continue
        try:
            exp = con.execute(ORACLES[name]).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql error {str(e)[:1500]}")
            continue
        gn, gt, gr = _norm(got)
        en, et, er = _norm(exp)
        types = {n: (gt[n], et.get(n)) for n in gn if _dtype(gt[n]) != _dtype(et.get(n, ""))}
        if gn != en or gr != er:
            bad += 1
            print(f"FAIL {name}: cols {gn == en} rows {len(gr)} vs {len(er)} types {types}")
            if gn != en:
                print("   ", gn, en)
            diff = [(g, e) for g, e in zip(gr, er) if g != e][:3]
            for g, e in diff:
                print("    spark ", str(g)[:600])
                print("    duckdb", str(e)[:600])
        else:
            note = f" TYPES {types}" if types else ""
            print(f"ok   {name}: {len(gr)} rows spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s{note}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
