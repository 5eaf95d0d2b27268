"""The driver's contract, and that the core stands without the text package."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 80


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "hype_index" in df.columns


def test_problem_queries_run(spark, sf):
    qs = entry.queries()
    for name in ("p1_found", "p1_change_counts", "p2_found", "p2_report"):
        assert qs[name](spark, sf).count() > 0


def test_core_does_not_import_llm():
    code = "import sys; import chartlake.plans; print([m for m in sys.modules if m.startswith('chartlake.llm')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert out.strip() == "[]"
    for p in (ROOT / "chartlake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "chartlake.llm" not in p.read_text(encoding="utf-8")
