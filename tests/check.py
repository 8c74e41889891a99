"""Compare registered queries with their SQL in DuckDB.

python tests/check.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        s = pdf[c]
        if s.map(lambda v: isinstance(v, (list, np.ndarray))).any():
            pdf[c] = s.map(lambda v: None if v is None else str([float(x) if isinstance(x, (float, np.floating)) else x for x in v]))
        elif s.dtype == object:
            pdf[c] = s.map(lambda v: None if v is None or v is pd.NA else v)
    return pdf


def kind(s: pd.Series) -> str:
    k = s.dtype.kind
    if k == "O":
        vals = [v for v in s.head(200) if v is not None and v == v]
        if vals and all(isinstance(v, (bool, np.bool_)) for v in vals):
            return "b"
        if vals and all(isinstance(v, (int, float, np.number)) for v in vals):
            return "f"
        return "O"
    return {"i": "f" if s.isna().any() else "i", "u": "i"}.get(k, k)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    a, b = normal(a), normal(b)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} != {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for c in a.columns:
        ka, kb = kind(a[c]), kind(b[c])
        if ka != kb and not {ka, kb} <= {"f", "i"} or {ka, kb} == {"i", "f"} and not (a[c].isna().any() or b[c].isna().any()):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
    cols = list(a.columns)

    def keyed(d: pd.DataFrame) -> pd.DataFrame:
        k = pd.DataFrame({c: d[c].map(lambda v: "~" if v is None or v != v else (f"{float(v):.4e}" if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else str(v))) for c in cols})
        order = sorted(cols, key=lambda c: kind(d[c]) == "f")
        return d.loc[k.sort_values(order, kind="stable").index].reset_index(drop=True)

    a, b = keyed(a), keyed(b)
    exact = True
    for c in cols:
        if kind(a[c]) in "if":
            x = pd.to_numeric(a[c]).astype(float).to_numpy()
            y = pd.to_numeric(b[c]).astype(float).to_numpy()
            if not np.array_equal(x, y, equal_nan=True):
                exact = False
                bad = ~(np.isclose(x, y, rtol=1e-9, atol=2e-6, equal_nan=True))
                if bad.any():
                    i = int(np.argmax(bad))
                    return f"{c}: {int(bad.sum())} values differ, e.g. {x[i]} != {y[i]} in {a.iloc[i].to_dict()} / {b.iloc[i].to_dict()}"
        else:
            x = a[c].map(lambda v: None if v is None or v != v else str(v))
            y = b[c].map(lambda v: None if v is None or v != v else str(v))
            if not (x.fillna("~") == y.fillna("~")).all():
                i = int(np.argmax((x.fillna("~") != y.fillna("~")).to_numpy()))
                return f"{c}: {x[i]!r} != {y[i]!r}"
    return "ok" if exact else "ok (last digits differ)"


def main(argv: list[str]) -> int:
    from platewise.session import local_session
    import __spark_entry__ as entry

    sf = "sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{DATA}/{sf}"
    con = duck(folder)
    qs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = []
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            got = df.toPandas()
            t1 = time.time()
            res = "rows only" if n not in sql else compare(got, con.execute(sql[n]).df())
            if len(got) == 0:
                res += " EMPTY"
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            got = []
            res = "ERROR " + str(e)[:900].replace("\n", " ")
        if not res.startswith("ERROR"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            res += "".join(f" [{k}]" for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan)
        flag = "" if res.startswith(("ok", "rows only")) and "EMPTY" not in res and "digits" not in res else "  <<<<<<"
        print(f"{n:32s} {t1 - t0:6.2f}s duck {time.time() - t1:5.2f}s rows {len(got):7d} {res}{flag}", flush=True)
        if flag:
            failed.append(n)
    print("FAILED", failed, "of", len(names))
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
