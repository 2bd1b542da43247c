"""The driver contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
from importlib.abc import MetaPathFinder

class Gone(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in BLOCKED or any(name.startswith(b + ".") for b in BLOCKED):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), sum(k.startswith("op") and k[2:3].isdigit() for k in q), "pipeline" in q, set(o) <= set(q))
"""


def names(*blocked):
    code = f"BLOCKED = {blocked!r}\n{BLOCK}"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, numbered, pipeline, oracles = out.stdout.split()
    assert oracles == "True"
    return int(total) - int(numbered) - (pipeline == "True"), int(numbered), pipeline == "True"


@pytest.mark.parametrize("blocked", [("tollgauge.llm",), ("tollgauge.llm", "corpus_pipeline"), ("zstandard",)])
def test_queries_without_the_subpackage(blocked):
    core, numbered, pipeline = names(*blocked)
    assert core >= 99 and numbered == 0
    if blocked != ("zstandard",):
        assert not pipeline


def test_no_part_of_the_library_imports_the_subpackage():
    for path in (ROOT / "tollgauge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tollgauge.llm" not in path.read_text(), path
