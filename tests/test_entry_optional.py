"""The entry offers the core queries whatever the optional part lacks."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.abc, sys
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as E
print(len(E.queries()), "genome_sentences" in E.queries(), any(q.startswith("op") for q in E.queries()), "pipeline" in E.queries())
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "seqloom.llm", "corpus_pipeline", "tokenizers_that_nobody_needs"])
def test_entry_survives_a_missing_module(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    n, core, ops, pipeline = done.stdout.split()[-4:]
    optional_there = name == "tokenizers_that_nobody_needs" and os.path.isdir(f"{ROOT}/seqloom/llm")
    assert int(n) > 80 and core == "True" and (ops, pipeline) == ((str(optional_there),) * 2)
