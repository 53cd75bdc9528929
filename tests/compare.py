"""Run registered queries in Spark and their oracle in DuckDB and compare all rows."""
import datetime as dt
import math
import sys
import time

import duckdb

from floetrack.plans.fixtures import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"f{v + 0.0!r}" if v != 0 else "f0.0"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, dt.datetime):
        return f"t{v.isoformat()}"
    if isinstance(v, dt.date):
        return f"d{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"s{v}"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data), [cols[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, gc = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(got), None
    cur = con.execute(sql)
    want, wc = rows([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return "columns", len(got), (gc, wc)
    if len(got) != len(want):
        return "count", len(got), (len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    if got != want:
        sw, sg = set(want), set(got)
        a, b = [x for x in got if x not in sw], [x for x in want if x not in sg]
        return "values", len(got), (len(a), a[:3], b[:3])
    return "ok", len(got), None


if __name__ == "__main__":
    import __spark_entry__ as e
    from floetrack.session import get_session
    sf = sys.argv[1]
    picks = sys.argv[2:]
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                       "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            st, n, info = compare(spark, con, q[name], o.get(name), sf)
        except Exception as ex:
            st, n, info = "error", 0, f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += st not in ("ok", "rows-only")
        print(f"{st:9s} {name:34s} rows={n:<8d} {time.time() - t:5.1f}s", info or "", flush=True)
    print("bad:", bad)
