"""The entry module with the text subpackage taken away."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_text_subpackage(tmp_path):
    (tmp_path / "tidemark").mkdir()
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    for p in (ROOT / "tidemark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql();"
            "print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), set(o) <= set(q))")
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, text=True, capture_output=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-800:]
    n, *flags = out.stdout.split()
    assert int(n) > 200 and flags == ["False", "False", "True"]


def test_entry_without_a_library_of_the_text_operators(tmp_path):
    """A missing third-party module takes the text queries away, with a warning, and nothing else."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q = e.queries();"
            "print(len(q), any(n.startswith('op') for n in q))")
    out = subprocess.run([sys.executable, "-B", "-c", code, str(tmp_path)], cwd=ROOT, text=True, capture_output=True,
                         env={**os.environ, "PYTHONPATH": str(ROOT)})
    assert out.returncode == 0 and "text operators left out" in out.stderr, out.stderr[-800:]
    n, some = out.stdout.split()
    assert int(n) > 200 and some == "False"


def test_all_declared_references_are_checked(spark):
    from __spark_entry__ import queries
    from tidemark.schema import TABLES
    got = {(r.table_name, r.rule) for r in queries()["v9_foreign_keys"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(n, f"{c} missing from {ref}") for n, t in TABLES.items() for c, ref, _ in t.references}
