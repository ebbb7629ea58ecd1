import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_rows import AWKWARD, SCHEMA, rows  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    table = rows(AWKWARD)
    table.append(table[12])  # a repeated row
    table.append((None, *table[13][1:]))  # a null id
    table.append((None, None, *[None] * 14))
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
