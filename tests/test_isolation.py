"""The rest works from a copy without the training-data part, whichever of its pieces are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(s) <= set(q)"


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_training_data_part(tmp_path, pipeline):
    shutil.copytree(TOP / "mdspark", tmp_path / "mdspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (TOP / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(TOP / name, tmp_path / name)
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, check=True, timeout=120)
