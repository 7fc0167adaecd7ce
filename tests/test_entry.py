"""The driver's entry point in an installation without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import importlib.machinery, sys

real = importlib.machinery.PathFinder.find_spec

def find(name, path=None, target=None):
    return None if name == "trajlake.llm" or name.startswith("trajlake.llm.") else real(name, path, target)

importlib.machinery.PathFinder.find_spec = find
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert names == set(entry.oracle_sql()), names ^ set(entry.oracle_sql())
assert "grpo_advantage" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert not any(m.startswith("trajlake.llm") for m in sys.modules)
print(len(names))
"""


def test_entry_without_the_llm_folders():
    code = HIDDEN.format(root=str(ROOT))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd="/tmp")
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100
