from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from lumenfold.session import local_session

    s = local_session("tests", cores=4, partitions=4, memory="4g")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s


@pytest.fixture()
def scratch(spark, request):
    from lumenfold.session import Scratch

    return Scratch(spark, request.node.name.replace("[", "-").replace("]", "").replace("/", "-")[:40])
