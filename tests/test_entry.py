"""The entry point with and without what the corpus operators need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(*missing):
    code = f"import sys\nfor m in {missing!r}: sys.modules[m] = None\nimport __spark_entry__ as e\nprint(*e.queries())\nprint(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()[-2:]]


def test_what_cannot_be_imported_is_left_out():
    core = names("spanforge.llm")
    assert "pipeline_build_edl" in core[0] and core[1] <= core[0] and not any(n.startswith("op1_") for n in core[0])
    # a library that only the corpus operators use
    assert names("xxhash") == core
    assert names("corpus_pipeline")[0] >= core[0]
