import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_need_optional_parts():
    code = "import sys; sys.modules['pathloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport pathloom.plans.catalogue, pathloom.streaming.arrivals, pathloom.operators.forest"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
