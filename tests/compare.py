"""Run registered queries against their SQL and report the differences.

    python tests/compare.py SF_DIR [name-part ...]
"""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(shaped, key=lambda r: [(v is None, str(v)) for v in r])


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def difference(frame, con, sql):
    result = con.sql(sql)
    want_kinds = {n: str(t) for n, t in zip(result.columns, result.types)}
    got_kinds = {n: KINDS.get(t, t) for n, t in frame.dtypes}
    want = normal(list(result.columns), result.fetchall())
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} want {want[0]}", len(got[1])
    if want_kinds != got_kinds:
        bad = {n: (got_kinds[n], want_kinds[n]) for n in want_kinds if got_kinds[n] != want_kinds[n]}
        return f"types {bad}", len(got[1])
    if len(want[1]) != len(got[1]):
        return f"rows {len(got[1])} want {len(want[1])}", len(got[1])
    for a, b in zip(got[1], want[1]):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"\n   got  {dict(zip(got[0], a))}\n   want {dict(zip(want[0], b))}", len(got[1])
    return None, len(got[1])


def close(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 1.5e-6 * max(1.0, abs(y))
    return x == y


def main(sf_dir, parts):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from slotward.session import build_session

    spark, con, oracle, failed = build_session("8"), connect(sf_dir), entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            frame = build(spark, sf_dir)
            if name in oracle:
                problem, count = difference(frame, con, oracle[name])
            else:
                problem, count = None, len(frame.collect())
        except Exception as error:  # noqa: BLE001 - report every query
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", -1
        verdict = "ok" if problem is None else "DIFF"
        print(f"{verdict:5s} {'sql ' if name in oracle else 'rows'} {name:45s} {count:7d} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"failed {len(failed)}: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
