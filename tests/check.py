"""Run registered queries against their SQL twins: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from mixframe.session import build_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-")})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    modules = {n for n in names if n.endswith("_queries")}
    for name, fn in queries.items():
        if names and name not in names and fn.__module__.split(".")[-1] not in modules:
            continue
        t, spent = time.time(), 0
        try:
            df = fn(spark, folder)
            df.write.format('noop').mode('overwrite').save() if '--time' in sys.argv else None
            spent = time.time() - t
            if name in oracles:
                ok, message = compare(df, con, oracles[name])
            else:
                n = df.count()
                ok, message = n > 0, f"{n} rows (no SQL)"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}/{time.time() - t:.1f}s {message}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", [a for a in sys.argv[2:] if a != '--time']), 1))
