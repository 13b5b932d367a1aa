"""The contract of __spark_entry__.py."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') for k in q))"


def counted(folder) -> list[int]:
    out = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return [int(x) for x in out.stdout.split()]


def test_queries_are_registered_without_a_session():
    assert counted(ROOT)[0] >= 100


def test_the_rest_stands_alone(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemark/llm", ignore_errors=True)
    (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    n, own = counted(tmp_path)
    assert n >= 100 and not own


def test_entry_gives_rows(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[0] == "symbol"
