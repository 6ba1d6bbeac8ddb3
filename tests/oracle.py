"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, con, folder, fn, sql, strict_types=True):
    """(rows, problem or None)."""
    started = time.time()
    df = fn(spark, folder)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    took = time.time() - started
    if sql is None:
        return len(mine), None, took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return len(mine), f"columns {columns} vs {sorted(names)}", took
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if len(mine) != len(theirs):
        return len(mine), f"rows {len(mine)} vs {len(theirs)}; only mine {list(set(mine) - set(theirs))[:3]}; only SQL {list(set(theirs) - set(mine))[:3]}", took
    bad = [(m, t) for m, t in zip(mine, theirs) if m != t]
    if bad:
        return len(mine), f"{len(bad)} rows differ: {list(set(mine) - set(theirs))[:2]} vs {list(set(theirs) - set(mine))[:2]}", took
    return len(mine), None, took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import importlib

    from vellum.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    from vellum.registry import Registry, everything

    registry = Registry()
    for module in [w for w in wanted if w.startswith("@")]:
        m = importlib.import_module(f"vellum.registry.{module[1:]}").R
        registry.queries.update(m.queries)
        registry.sql.update(m.sql)
    if not registry.queries:
        registry = everything()
    names = [w for w in wanted if not w.startswith("@")]
    failed = 0
    for name, fn in registry.queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            rows, problem, took = compare(spark, con, folder, fn, registry.sql.get(name))
        except Exception as error:
            rows, problem, took = -1, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {took:.1f}s {'' if name in registry.sql else '(rows only) '}{(problem or '')[:900]}", flush=True)
    print("failed", failed)
