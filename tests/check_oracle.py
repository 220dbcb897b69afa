"""Run registered queries against their SQL on DuckDB: ``python tests/check_oracle.py [sf_dir] [names...]``."""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def lines(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(row)) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    a, b = lines(spark_frame), lines(sql_frame)
    if hashlib.md5("\n".join(a).encode()).digest() != hashlib.md5("\n".join(b).encode()).digest():
        differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        return f"{len(differ)} rows differ, first: {differ[0]}"
    if kinds(spark_frame) != kinds(sql_frame):
        return "types " + str({c: (kinds(spark_frame)[c], kinds(sql_frame)[c]) for c in kinds(spark_frame) if kinds(spark_frame)[c] != kinds(sql_frame)[c]})
    return None


def main() -> None:
    from tidemark.plans import ORACLE, QUERIES
    from tidemark.session import create_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = create_session(
        "check",
        **{"spark.master": f"local[{__import__('os').environ.get('CHECK_CPUS', '8')}]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLE:
                note = f"rows only, {len(got)}"
            else:
                note = compare(got, con.execute(ORACLE[name]).df()) or f"ok {len(got)}"
        except Exception as error:  # noqa: BLE001
            took = time.time() - start
            note = f"ERROR {str(error)[:700]}"
        bad += not note.startswith(("ok", "rows only"))
        print(f"{name:28s} {took:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    spark.stop()


if __name__ == "__main__":
    main()
