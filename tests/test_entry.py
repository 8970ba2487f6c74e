import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """The package still works after those folders are deleted."""
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "prismatica", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "prismatica").mkdir()
    for p in (ROOT / "prismatica").iterdir():
        if p.name != "llm":
            (tmp_path / "prismatica" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(n.startswith('op1') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
