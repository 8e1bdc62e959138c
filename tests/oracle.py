"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [--sf DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool) else (x is None, "n", float(x)) for x in r))


def compare(spark_df, con, sql):
    """Return '' on agreement, else the first difference."""
    cols, rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    ocols, orows = canonical(names, cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(rows) != len(orows):
        only = [r for r in rows if r not in set(orows)][:2]
        oonly = [r for r in orows if r not in set(rows)][:2]
        return f"rows {len(rows)} != {len(orows)}; spark-only {only}; sql-only {oonly}"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    for r, o in zip(rows, orows):
        if r != o:
            return f"first difference {dict(zip(cols, r))} != {dict(zip(cols, o))} types {types}"
    otypes = dict(zip(names, kinds))
    want = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = {c: (t, otypes[c]) for c, t in types.items() if want.get(t) != otypes[c]}
    if bad:
        return f"types {bad}"
    return "" if rows else "no rows on either side"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark, con = make_session(), duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                msg = compare(df, con, sqls[name])
                msg = "ok" if not msg else "FAIL " + msg
            else:
                msg = f"rows-only rows={df.count()}"
        except Exception as e:  # report and go on to the next query
            msg = "FAIL " + type(e).__name__ + " " + str(e)[:900]
        if msg.startswith("FAIL"):
            failed.append(name)
        print(f"{name}: {msg} [{time.time() - t:.1f}s]", flush=True)
    print("FAILED:", failed, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
