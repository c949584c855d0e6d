import pytest

import quirewise.plans
from quirewise.plans.registry import ORACLE, QUERIES
from tests.harness import compare

SF = "/root/testdata/sf0.001"
quirewise.plans.load()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE[name], SF) is None
