"""Without the training-data folder and its pipeline everything else still imports and registers."""
import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()[-2:]]


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(os.path.join(HERE, "tidewright"), tmp_path / "tidewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    queries, sql = names(tmp_path)
    assert len(queries) > 200 and sql <= queries and not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_nothing_else_imports_it():
    for top, _, files in os.walk(os.path.join(HERE, "tidewright")):
        for f in files:
            if f.endswith(".py") and os.path.basename(top) != "llm":
                text = open(os.path.join(top, f)).read()
                assert "import llm" not in text and ".llm" not in text


def test_entry_without_a_library_of_the_optional_part(tmp_path):
    """The folder is there, but what it imports is not: the other queries still register."""
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')\n")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, optional = out.stdout.split()[-2:]
    assert int(count) > 200 and optional == "False"
