"""The entry module loads without a Spark jar and without the optional packages."""

import os
import shutil
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from phraselens.functions.words import BASE_STOP_WORDS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stop_words_are_sparks(spark):
    assert list(BASE_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_entry_imports_without_jars(tmp_path):
    code = (f"import sys, pyspark; sys.path.insert(0, {ROOT!r}); pyspark.__file__ = {str(tmp_path / '__init__.py')!r}\n"
            "import __spark_entry__ as e; assert len(e.queries()) >= 58 and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_entry_without_the_optional_package(tmp_path):
    """With both llm folders gone, the pipeline module left behind or not, all core queries are there and one runs."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = ("import __spark_entry__ as e; q = e.queries(); assert len(q) >= 58 and not [n for n in q if n.startswith('op') or n == 'pipeline']\n"
            "assert set(e.oracle_sql()) <= set(q)\n"
            "from phraselens.session import local_session\n"
            "assert q['label_codes'](local_session('2'), '/root/testdata/sf0.001').count() == 2")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, timeout=300, env=os.environ | {"PYTHONPATH": str(copy)})
    (copy / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) >= 58"], check=True, cwd=copy, timeout=120,
                   env=os.environ | {"PYTHONPATH": str(copy)})
