"""The subpackage stands alone: nothing else in the library imports it, and the entry does without it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_it():
    for path in (ROOT / "featstab").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry_without_it(tmp_path):
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))"
    for name in ("featstab", "jobs", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(["cp", "-r", ROOT / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-r", tmp_path / "featstab" / "llm"], check=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.stdout.split() == ["0", "True", "True"], out.stderr


def test_entry_has_one_query_of_each_operator():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 13)) and "pipeline" in entry.queries()
