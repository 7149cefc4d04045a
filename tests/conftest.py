import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fraudlake.plans.fixtures import Fixture  # noqa: E402
from fraudlake.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4)


@pytest.fixture(scope="session")
def fx(spark):
    return Fixture(spark, SMALL)


@pytest.fixture
def conf(spark):
    """Set session settings for one block and restore them."""
    @contextmanager
    def use(**kv):
        old = {k: spark.conf.get(k, None) for k in kv}
        for k, v in kv.items():
            spark.conf.set(k, str(v))
        try:
            yield
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return use


def rows(df, *order):
    out = [tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(out, key=str)
