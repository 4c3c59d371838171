import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registries_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "positive_map" in __spark_entry__.queries()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_works_without_the_corpus_part(tmp_path):
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{HERE}/quarryline", tmp_path / "quarryline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'positive_map' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
