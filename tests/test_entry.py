"""The driver contract holds without the optional subpackage, whether it is away or broken."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


def said(folder, code=SAY):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout, run.stderr


def copied(tmp_path):
    for name in ("headmint", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


def test_without_the_subpackage(tmp_path):
    copied(tmp_path)
    shutil.rmtree(tmp_path / "headmint" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    from headmint.plans.oracles import ORACLES
    from headmint.plans.queries import QUERIES

    out, err = said(tmp_path)
    assert out.strip() == f"{sorted(QUERIES)} {sorted(ORACLES)}" and "UserWarning" not in err


@pytest.mark.skipif(not (ROOT / "headmint" / "llm").is_dir(), reason="the subpackage is away")
def test_with_a_library_missing(tmp_path):
    """Without one of its libraries, the subpackage's queries are left out with a warning."""
    copied(tmp_path)
    out, err = said(tmp_path, "import sys; sys.modules['zstandard'] = None\n" + SAY)
    assert "'parse_email'" in out and "op1_" not in out and "pipeline" not in out and "can't be imported" in err


@pytest.mark.skipif(not (ROOT / "corpus_pipeline.py").exists(), reason="the pipeline is away")
def test_without_the_pipeline(tmp_path):
    copied(tmp_path)
    (tmp_path / "corpus_pipeline.py").unlink()
    out, err = said(tmp_path)
    assert "'pipeline'" not in out and "UserWarning" not in err and ("op1_" in out) == (ROOT / "headmint" / "llm").is_dir()
