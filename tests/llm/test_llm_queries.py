"""Every query against its SQL over a small folder; a query without SQL is computed whole."""

import pytest

from spliceframe.llm import queries, sql
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), sql.oracle_sql()


#: queries without a row in this folder
EMPTY = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert difference(spark, FOLDER, QUERIES[name], SQL[name]) == ("no rows" if name in EMPTY else "")
    else:
        assert (QUERIES[name](spark, FOLDER).count() > 0) == (name not in EMPTY)


def test_pairs_of_one_read(spark):
    every = SQL["p5_pairs"].removesuffix(" WHERE n_ab >= 2")
    assert every != SQL["p5_pairs"]
    assert difference(spark, FOLDER, QUERIES["p5_all_pairs"], every) == ""
