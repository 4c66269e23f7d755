"""Registered queries against their SQL."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tests.compare import connect, difference
from workload.oracle import ORACLE
from workload.queries import REGISTRY

WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_a_reason():
    assert set(REGISTRY) - set(ORACLE) == WITHOUT_SQL and set(ORACLE) <= set(REGISTRY)


@pytest.fixture(scope="module")
def outcomes(spark, con, sf_dir):
    """Every query compared, six at a time: on small tables planning takes longer than running."""

    def compare(name):
        try:
            return difference(REGISTRY[name], ORACLE[name], spark, con.cursor(), sf_dir)
        except Exception as error:
            return f"{type(error).__name__}: {error}"[:2000]

    names = sorted(ORACLE)
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(compare, names)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, outcomes):
    assert outcomes[name] is None


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
