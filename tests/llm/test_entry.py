"""What is registered where modules are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def names(*missing):
    code = f"import sys; sys.modules.update(dict.fromkeys({missing!r})); import __spark_entry__ as e; print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


@pytest.mark.parametrize("missing", ["tiktoken", "zstandard", "xxhash", "public_tokenizers"])
def test_a_missing_library_is_an_error(missing):
    run = names(missing)
    assert run.returncode and "ModuleNotFoundError" in run.stderr and missing in run.stderr


@pytest.mark.parametrize("missing, ops, pipeline", [
    ((), 13, True), (("corpus_pipeline",), 13, False), (("pathlift.llm",), 0, False)])
def test_what_may_be_left_out(missing, ops, pipeline):
    run = names(*missing)
    found = run.stdout.split()
    assert run.returncode == 0, run.stderr
    assert sum(n.startswith("op") and n[2].isdigit() for n in found) == ops and ("pipeline" in found) == pipeline
