import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import prepare_session  # noqa: E402

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare_session(session)
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of one symbol from closes; other columns default to something plain."""

    def make(closes, symbol="A", hours=None, **columns):
        rows = []
        for i, close in enumerate(closes):
            row = {
                "symbol": symbol,
                "bar_start": T0 + timedelta(hours=hours[i] if hours else i),
                "open": close,
                "high": close,
                "low": close,
                "close": close,
                "volume": 10.0,
                "spread": 0.0,
                "tick_count": 5,
            }
            row.update({k: v[i] for k, v in columns.items()})
            rows.append(row)
        schema = (
            "symbol string, bar_start timestamp, open double, high double, low double, close double, "
            "volume double, spread double, tick_count bigint"
        )
        known = {f.split()[0] for f in schema.split(", ")}
        for name in columns:
            if name not in known:
                kind = "int" if isinstance(columns[name][0], int) else "double"
                schema += f", {name} {kind}"
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([[r[n] for n in names] for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def make_ticks(spark):
    schema = (
        "symbol string, timestamp timestamp, seq bigint, ask double, bid double, "
        "ask_volume double, bid_volume double"
    )

    def make(rows):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def long_bars(spark):
    """Two random-walk series, one much longer than the other."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("LONG", 2600), ("SHORT", 70)):
        close = 100 + np.cumsum(rng.normal(0, 0.1, n))
        open_ = close + rng.normal(0, 0.05, n)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "bar_start": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), unit="h"),
                    "open": open_,
                    "high": np.maximum(open_, close) + rng.uniform(0, 0.1, n),
                    "low": np.minimum(open_, close) - rng.uniform(0, 0.1, n),
                    "close": close,
                    "volume": rng.integers(1, 50, n).astype(float),
                    "spread": rng.uniform(0.01, 0.05, n),
                    "tick_count": rng.integers(1, 40, n),
                    "signal": rng.choice([-1, 1], n),
                }
            )
        )
    from barloom.session import materialize

    return materialize(spark.createDataFrame(pd.concat(frames)), "long_bars")
