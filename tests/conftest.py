import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools"), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    import check
    s = check.session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def con():
    import check
    from support import SF
    return check.oracle(SF)
