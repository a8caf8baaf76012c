import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderstatus", "total"] and df.count() == 3


@pytest.mark.parametrize("left_out", [(), ("rillflow/llm", "tests/llm", "corpus_pipeline.py"), ("rillflow/llm", "tests/llm")])
def test_imports_without_the_training_data_part(tmp_path, left_out):
    for name in ("rillflow", "__spark_entry__.py", "corpus_pipeline.py"):
        at = os.path.join(ROOT, name)
        if os.path.exists(at):
            (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    for name in left_out:
        at = tmp_path / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, extra = out.stdout.split(maxsplit=1)
    assert int(n) >= 50 and extra.strip() == "[]"
