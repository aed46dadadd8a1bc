"""Run registered queries beside their SQL on DuckDB and report differences.

usage: python tools/check.py [sf_dir] [name-substring ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from vigilgrid.catalog import load
from vigilgrid.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def compare(df, con, sql):
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    theirs_names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}", len(mine)
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rows)
    if mine == theirs:
        kinds = dict(zip(theirs_names, [str(d[1]) for d in rel.description]))
        odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if KIND.get(t) and KIND[t] not in kinds[c]]
        return ("types " + ", ".join(odd) if odd else "ok"), len(mine)
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return (f"rows {len(mine)} vs {len(theirs)}; only ours {len(a)} {sorted(a)[:2]}; "
            f"only sql {len(b)} {sorted(b)[:2]}"), len(mine)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH"}


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    if args and args[0].startswith("@"):
        import importlib
        importlib.import_module("vigilgrid.catalog." + args.pop(0)[1:])
        from vigilgrid.catalog.registry import ENTRIES as entries
    else:
        entries = load()
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, e in entries.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            df = e.run(spark, sf_dir)
            verdict, n = compare(df, con, e.sql) if e.sql else ("no sql", df.count())
        except Exception as err:
            verdict, n = "ERROR " + str(err).replace("\n", " ")[:700], -1
        bad += verdict not in ("ok", "no sql")
        print(f"{'   ' if verdict in ('ok', 'no sql') else '***'} {name} rows={n} {time.time() - t:.1f}s {verdict}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
