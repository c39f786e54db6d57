import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tidemark-tests")
    yield session
    session.stop()


def price_frame(symbols=("AAA", "BBB"), n=300, seed=42):
    """Geometric random walks on business days, one bar per symbol and date."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, s in enumerate(symbols):
        dates = pd.bdate_range("2018-01-01", periods=n + 7 * i)[7 * i :]
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
        spread = np.abs(rng.normal(0, 0.5, (2, n)))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "date": dates.date,
                    "open": close,
                    "high": close + spread[0],
                    "low": close - spread[1],
                    "close": close,
                    "volume": 1.0,
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def prices():
    return price_frame()


@pytest.fixture(scope="session")
def bars(spark, prices):
    from tidemark.sources.tables import BARS

    return spark.createDataFrame(prices, BARS).cache()


def by_symbol(df, symbol):
    pdf = df.where(df.symbol == symbol).toPandas().sort_values("date").reset_index(drop=True)
    return pdf
