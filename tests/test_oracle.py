"""Every query of the library that has SQL gives the rows of that SQL."""

import pytest
from compare import oracle_rows, spark_rows

from lexspan import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, name):
    want = oracle_rows(catalog.ORACLES[name], sf_dir)
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == want
