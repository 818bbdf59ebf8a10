"""The registry works where the training-data folder was taken out."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("plantflow.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql()
assert not any(n == "pipeline" or n[:2] == "op" and n[2:3].isdigit() for n in e.queries())
"""


def test_entry_without_training_data():
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=REPO, check=True)
