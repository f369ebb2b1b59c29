import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_llm_folder():
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT).as_posix()
        if rel.startswith(("lakeloom/llm/", "tests/llm/")) or rel in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        assert not re.search(r"^\s*(from|import) lakeloom\.llm", p.read_text(), re.M), rel


def test_the_entry_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    for name in ("__spark_entry__.py", "lakeloom"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, any_llm = out.stdout.split()
    assert int(n) > 50 and any_llm == "False"
