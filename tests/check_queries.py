"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [prefix ...]"""

from __future__ import annotations

import decimal
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sillage.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, list):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canon(v)) for k, v in value.items())
    return value


def kind(dtype) -> str:
    text = str(dtype)
    return {"large_string": "string", "string_view": "string"}.get(text, text).replace("large_", "").replace("[us, tz=UTC]", "[us]")


def rows_of(table) -> list[str]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(repr(tuple(canon(v) for v in row)) for row in zip(*cols))


def compare(df, con, sql: str) -> list[str]:
    got = df.toArrow()
    rel = con.execute(sql)
    want = rel.to_arrow_table() if hasattr(rel, "to_arrow_table") else rel.fetch_arrow_table()
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}"]
    for name in got.column_names:
        a, b = kind(got.schema.field(name).type), kind(want.schema.field(name).type)
        if a != b:
            problems.append(f"type of {name}: {a} vs {b}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} vs {want.num_rows}")
    a, b = rows_of(got), rows_of(want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lacking = [r for r in b if r not in set(a)][:2]
        problems.append(f"values; only Spark {extra}; only SQL {lacking}"[:900])
    if got.num_rows == 0:
        problems.append("EMPTY")
    return problems


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in queries:
        if not key.startswith(prefixes):
            continue
        begun = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                problems = compare(df, con, oracles[key])
            else:
                n = df.count()
                problems = ["no rows"] if n == 0 else []
        except Exception as error:  # noqa: BLE001
            problems = ["error " + (str(error) or traceback.format_exc())[:1200]]
        took = time.time() - begun
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if key in oracles else "ok (rows only)")
        print(f"{mark:5} {key:40} {took:5.1f}s  {' | '.join(problems)}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
