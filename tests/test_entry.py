import re
import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_subpackage(tmp_path):
    """With ordix/llm and its tests gone, with and without the pipeline's file, entry points import and list the other queries."""
    shutil.copytree(TOP / "ordix", tmp_path / "ordix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'succ_global' in q and set(o) <= set(q) and not any(x.startswith('op') for x in q) and 'pipeline' not in q"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        if (TOP / "corpus_pipeline.py").exists():
            shutil.copy(TOP / "corpus_pipeline.py", tmp_path)


def test_nothing_else_imports_the_subpackage():
    for f in (TOP / "ordix").rglob("*.py"):
        if "llm" not in f.relative_to(TOP).parts:
            assert not re.search(r"\bllm\b", f.read_text())
