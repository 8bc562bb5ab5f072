"""Every registered query against its SQL in DuckDB, on the smallest tables, and the driver's entry."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quillmere import registry

DATA = os.environ.get("QUILLMERE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    place = [names.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_everything_else_works_without_the_optional_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillmere.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'o1_bm25_top10' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not [m for m in sys.modules if m.startswith('quillmere.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
