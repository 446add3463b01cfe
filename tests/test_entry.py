"""The driver's entry: every structure query against its SQL, and the entry without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from strandloom.plans import more_queries  # noqa: F401
from strandloom.plans.queries import ORACLE, QUERIES

ROOT = str(Path(__file__).resolve().parents[1])


def same(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(same, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        places = {c[0]: i for i, c in enumerate(found.description)}
        assert sorted(places) == columns
        assert rows == sorted(tuple(same(r[places[c]]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == QUERIES["atoms_by_chain_bbox"](spark, "/root/testdata/sf0.001").columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_corpus_operators(tmp_path):
    """The rest imports where the corpus operators and their pipeline are gone."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'atoms_parse' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, check=True)
