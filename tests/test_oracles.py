"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import same

from quillgrove import plans, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, data, name):
    same(registry.QUERIES[name](spark, data), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
