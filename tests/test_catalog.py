"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from braidql import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert len(df.columns) > 0
        return
    found = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    assert got == want


def test_entry_works_without_the_llm_subpackage(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are gone."""
    for p in os.listdir(REPO):
        if p not in (".git", "corpus_pipeline.py", "braidql"):
            os.symlink(f"{REPO}/{p}", tmp_path / p)
    os.mkdir(tmp_path / "braidql")
    for p in os.listdir(f"{REPO}/braidql"):
        if p != "llm":
            os.symlink(f"{REPO}/braidql/{p}", tmp_path / "braidql" / p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{REPO}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
