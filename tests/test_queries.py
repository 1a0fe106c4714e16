import pytest

from ordix import queries as core

from . import oracle


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, name):
    if name in core.ORACLES:
        oracle.check(spark, sf_dir, core.QUERIES[name], core.ORACLES[name])
    else:
        assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(core.ORACLES) <= set(core.QUERIES)
