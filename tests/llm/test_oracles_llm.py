import pytest
from compare import database, differences

from pairlens.llm.oracles import oracle_sql
from pairlens.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(name, spark, sf):
    assert differences(queries()[name](spark, sf), database(sf), oracle_sql()[name]) == ""
