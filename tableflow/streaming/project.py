"""Stateless projection of counter rows to ticks, for batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.functions.columns import named

# --- Fixed values: symbols by parity, price from the counter --------------------------------
EVEN_SYMBOL = "BTC"
ODD_SYMBOL = "ETH"
PRICE_CYCLE = 200
PRICE_BASE = 10000.0
# -------------------------------------------------------------------------------------------


def project_ticks(df: DataFrame, time: str = "timestamp", value: str = "value") -> DataFrame:
    """``(event_time, symbol, close, value)`` from rows with a time and a counter."""
    counter = named(value)
    even = F.coalesce(counter % 2 == 0, F.lit(False))
    return df.select(
        named(time).alias("event_time"),
        F.when(even, F.lit(EVEN_SYMBOL)).otherwise(F.lit(ODD_SYMBOL)).alias("symbol"),
        (counter % PRICE_CYCLE + F.lit(PRICE_BASE)).alias("close"),
        counter.alias("value"),
    )
