"""Every registered query against its SQL, on two sizes of the given tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def data(request):
    path = f"/root/testdata/{request.param}"
    return path, connect(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    path, con = data
    if name not in ORACLE and not path.endswith("sf0.001"):
        pytest.skip("without SQL only that it runs is seen here; its own tests look at its result")
    df = QUERIES[name](spark, path)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "label", "sample_idx", "text"]
    assert df.count() == 87
