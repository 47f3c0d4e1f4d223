"""The driver's contract holds with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    for p in ("sigstrata", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sigstrata" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'wave_levels' in e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
