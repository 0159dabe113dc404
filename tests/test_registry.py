"""Every query of the engine's own operators against its DuckDB equivalent."""

import pytest

from marlstone.plans import folds, governance, ledgers, readouts, registry, views  # noqa: F401
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, name):
    oracle.same(registry.QUERIES[name](spark, sf), sf, registry.ORACLE[name])
