"""Compare queries with their SQL: python tests/oracle.py [folder] [name...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def views(con, d: str) -> None:
    for p in sorted(Path(d).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")


def canon(v):
    import datetime
    import decimal

    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == v.to_integral_value() else f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, d: str) -> str:
    df = query(spark, d)
    mine = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    other = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if mine != other:
        a, b = set(mine) - set(other), set(other) - set(mine)
        return f"rows {len(mine)} / {len(other)}; only here {list(a)[:3]}; only in SQL {list(b)[:3]}"
    return ""


def main(args: list[str]) -> int:
    import duckdb

    import __spark_entry__ as entry
    from voxelake.session import build_session

    d = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    only = [a for a in args if "/" not in a]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    views(con, d)
    failed = 0
    sqls = entry.oracle_sql()
    for name, q in entry.queries().items():
        if only and not any(name == o or name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, q, sqls[name], d) if name in sqls else f"({q(spark, d).count()} rows, no SQL)"
        except Exception as e:  # noqa: BLE001
            why = f"error {type(e).__name__}: {str(e)[:600]}"
        bad = bool(why) and not why.startswith("(")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - t:.1f}s {why}", flush=True)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
