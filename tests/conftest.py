import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from chunkloom.session import build_session

    return build_session("tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


def rows(df):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(x)) for x in t])
