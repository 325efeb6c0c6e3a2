import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("kindred.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(n.startswith("op") for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""


def test_the_rest_stands_without_the_training_data_part():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_it():
    for f in (ROOT / "kindred").rglob("*.py"):
        if "llm" not in f.parts:
            assert "kindred.llm" not in f.read_text()
