"""Run query keys on Spark and their SQL twins on DuckDB and compare (local check tool).

    python -m folio.plans.check [sf_dir] [key ...]

Columns are compared by name (sorted); rows as multisets after sorting; floats within 1e-9.
"""

from __future__ import annotations

import math
import sys
import time

import pandas as pd


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = _rows(spark_pdf), _rows(oracle_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: {str(bad[0])[:600]}"
    return True, f"{len(a)} rows equal"


def duck(sf_dir: str):
    import duckdb
    from folio.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv: list[str]) -> int:
    from folio.plans.oracle import ORACLE
    from folio.plans.queries import QUERIES
    from folio.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = get_session()
    con = duck(sf_dir)
    failed = 0
    for k in keys:
        t0 = time.time()
        try:
            spdf = QUERIES[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:800]}")
            failed += 1
            continue
        t1 = time.time()
        if k not in ORACLE:
            print(f"ROWS {k}: {len(spdf)} rows (no oracle) spark {t1 - t0:.1f}s")
            continue
        try:
            opdf = con.sql(ORACLE[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: oracle error {type(e).__name__}: {str(e)[:800]}")
            failed += 1
            continue
        ok, msg = compare(spdf, opdf)
        failed += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {msg} (spark {t1 - t0:.1f}s, duckdb {time.time() - t1:.1f}s)", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
