"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_training_data_ones_has_sql():
    assert {n for n in entry.queries() if n not in ORACLE and not n.startswith(("op", "pipeline"))} == set()


def test_every_oracle_gives_rows(con):
    """An agreement of nothing with nothing would say nothing."""
    for name in sorted(ORACLE):
        assert con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] > 0, name


def test_the_entry_module_needs_no_training_data_operators(tmp_path):
    """Without them it imports; a broken import inside them is no silent loss."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/ratelake", tmp_path / "ratelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), e.llm)"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    out = run()
    assert out.returncode == 0 and out.stdout.split()[1] == "None" and int(out.stdout.split()[0]) > 90
    (tmp_path / "ratelake" / "llm").mkdir()
    (tmp_path / "ratelake" / "llm" / "__init__.py").write_text("")
    (tmp_path / "ratelake" / "llm" / "queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr
