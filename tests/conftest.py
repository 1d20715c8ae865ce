import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricloom.schemas import frame_schema  # noqa: E402
from metricloom.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("metricloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


T0 = datetime(2024, 3, 1, 10, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def ms(moment: datetime) -> int:
    return round(moment.replace(tzinfo=timezone.utc).timestamp() * 1000)


_SEQ = iter(range(1, 10**9))


def frame(agent="a1", fleet="f1", when=0.0, key=None, cpu=None, used=0, total=0, rx=None, labels=None, seq=None,
          received=None, system=None, traceparent=None):
    """One frame; ``cpu=None`` means no system metrics, ``rx=None`` no network metrics."""
    seq = next(_SEQ) if seq is None else seq
    system = (cpu, used, total, 0.0, 0.0) if cpu is not None and system is None else system
    collected = at(when) if when is not None else None
    return (
        agent, fleet, collected, f"k{seq}" if key is None else key, system,
        None if rx is None else (rx, 0.0, 0, 0), labels or {},
        at(received if received is not None else (when or 0.0)), seq, traceparent,
    )


@pytest.fixture
def frames(spark):
    def build(*rows, uint64="bigint"):
        return spark.createDataFrame(list(rows), frame_schema(uint64))

    return build
