import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from limpida import CleaningOptions  # noqa: E402
from limpida.session import local_session  # noqa: E402
from samples import SALT  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g")


@pytest.fixture(scope="session")
def options():
    return CleaningOptions(pii_salt=SALT)


@pytest.fixture(scope="session")
def texts(spark):
    """A one-column table from a list of texts, with their positions."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "n INT, t STRING").coalesce(2)

    return make
