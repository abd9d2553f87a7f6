import json
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 8)} <= set(entry.queries())


def test_core_does_not_import_the_text_subpackage():
    code = "import sys, factbase, factbase.plans.catalog, factbase.plans.data_queries; print([m for m in sys.modules if m.startswith('factbase.llm')])"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.strip() == "[]"


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_and_queries_against_sql(spark):
    """The flagship query runs, and a query of each kind equals its SQL."""
    assert entry.entry(spark).count() > 0
    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, str(ROOT / "tools"))
    from compare import plain

    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    names = ["q_ref_join", "q_or_bag", "q_not_or", "q_multiway5", "q_rule_recursive_cycle", "q_as_of_tx", "q_tsv_roundtrip", *[f"p{n}_found" for n in range(1, 8)]]
    for n in names:
        got, want = entry.queries()[n](spark, str(DATA)).toPandas(), db.execute(entry.oracle_sql()[n]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want), n


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_growing_tables_are_streamed(spark):
    got = {r.attr: r.n for r in entry.queries()["q_stream_tables"](spark, str(DATA)).collect()}
    for attr, name in (("Supplier/s_suppkey", "supplier"), ("Part/p_partkey", "part"), ("Order/o_orderkey", "orders")):
        assert got[attr] == spark.read.parquet(f"{DATA}/{name}.parquet").count()


def test_bench_prints_one_line():
    if not DATA.exists():
        pytest.skip("no test tables")
    out = subprocess.run([sys.executable, "bench.py", "q_scan_filter"], cwd=ROOT, capture_output=True, text=True, env={**__import__("os").environ, "BENCH_SF_DIR": str(DATA), "BENCH_CPUS": "2"})
    line = json.loads(out.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and set(line["queries"]) == {"q_scan_filter"}
