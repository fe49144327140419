"""Run registered queries next to their SQL and report differences.

python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(_cell)
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def _cell(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = normal(left), normal(right)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} rows differ\n{a[bad].head(4).to_string()}\n{b[bad].head(4).to_string()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from plantscope.session import build_session

    spark = build_session()
    con = connect(sf_dir)
    found, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or found:
        start = time.time()
        try:
            got = found[name](spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            note = f"rows-only {len(got)}"
            if name in sqls:
                note = differences(got, con.execute(sqls[name]).df()) or f"ok {len(got)}"
            bad = not (note.startswith("ok") or note.startswith("rows-only"))
        except Exception as error:
            took, note, bad = time.time() - start, f"ERROR {str(error)[:1500]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {name} {took:.1f}s sql {time.time() - start:.1f}s: {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
