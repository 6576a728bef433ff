"""The driver's contract, with and without the subpackage that may be absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_alone(tmp_path):
    """Without the subpackage and the pipeline, the entry still imports and has the other queries."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "voxelarium", tmp_path / "voxelarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vol_construct' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"})
