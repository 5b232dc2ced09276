import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def odd(spark):
    from frames import odd_documents

    return odd_documents(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    from frames import no_documents

    return no_documents(spark)
