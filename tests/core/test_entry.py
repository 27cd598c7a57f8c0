import importlib
import pathlib
import re

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_stands_alone():
    """Nothing outside the training-data package imports it but the guarded entry."""
    root = pathlib.Path(__spark_entry__.__file__).parent / "meshwork"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p
    importlib.import_module("meshwork.jobs.queries")


def test_queries_agree_with_sql(spark, tmp_path):
    """A few queries on the smallest tables, where these are."""
    duckdb = importlib.import_module("duckdb")
    sf = pathlib.Path("/root/testdata/sf0.001")
    if not sf.exists():
        return
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("spmv_ghost", "ghost_need_counts", "load_balance", "strong_scaling", "mtx_read_summary"):
        got = __spark_entry__.queries()[name](spark, str(sf))
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        flat = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
        assert flat(map(tuple, got.collect())) == flat(want), name
