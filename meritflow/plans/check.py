"""Side-by-side check of a registered query against its DuckDB oracle SQL.

Used by the tests and by hand: ``python -m meritflow.plans.check /root/testdata/sf0.01 [names...]``.
"""

from __future__ import annotations

import math
import os
import sys

from ..sources.tables import TABLES, table_path


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", None):
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        if v.is_integer() and abs(v) < 2**53:
            return (4, repr(int(v)))
        return (2, repr(round(v, 9)))
    if isinstance(v, (list, tuple)):
        return (3, repr([_norm(x) for x in v]))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return (4, repr(v))


def _kind(dtype) -> str:
    s = str(dtype).lower()
    for k in ("int64", "int32", "int16", "int8", "float64", "float32", "bool", "datetime"):
        if k in s:
            return k
    return "object"


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> bool:
    from .oracle import oracle_sql
    from .queries import QUERIES
    con = con or duckdb_connection(sf_dir)
    sp = QUERIES[name](spark, sf_dir).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        if verbose:
            print(f"{name}: rows={len(sp)} (no oracle)")
        return True
    dk = con.execute(sql).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dk)
    has_null = {c for c in sp.columns if sp[c].isna().any()} | {c for c in dk.columns if dk[c].isna().any()}
    t1 = {c: _kind(sp[c].dtype) for c in sp.columns if c not in has_null}
    t2 = {c: _kind(dk[c].dtype) for c in dk.columns if c not in has_null}
    ok = c1 == c2 and r1 == r2 and t1 == t2
    if t1 != t2 and verbose:
        print("  dtypes differ:", {c: (t1.get(c), t2.get(c)) for c in set(t1) | set(t2) if t1.get(c) != t2.get(c)})
    if verbose:
        print(f"{name}: spark={len(r1)} duckdb={len(r2)} cols_ok={c1 == c2} {'OK' if ok else 'MISMATCH'}")
        if not ok:
            if c1 != c2:
                print("  spark cols", c1, "duckdb cols", c2)
            else:
                s1, s2 = set(r1), set(r2)
                print("  only spark:", sorted(s1 - s2)[:3])
                print("  only duckdb:", sorted(s2 - s1)[:3])
    return ok


def main(argv):
    from ..session import get_spark
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from .queries import QUERIES
    names = argv[2:] or list(QUERIES)
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_connection(sf)
    bad = [n for n in names if not compare(spark, n, sf, con)]
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
