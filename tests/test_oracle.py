import oracle
import pytest

from quern.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, con, name):
    oracle.assert_same(con, QUERIES[name](spark, sf), ORACLE[name])


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert entry.entry(spark).count() > 0
