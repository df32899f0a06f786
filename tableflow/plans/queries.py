"""Registered queries: every operator over whole tables.

Each takes (spark, folder of the Parquet tables). Times come out without zone, so results do not
depend on the session time zone; fractional results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.functions import columns as rules
from tableflow.operators import bars as bar_ops
from tableflow.operators import clean, contracts, dedupe, indicators, profiles, ranges, repair, upsert
from tableflow.operators.ranges import RangeSplit
from tableflow.operators.segments import Split
from tableflow.operators.skew import HotKeys
from tableflow.plans import jobs
from tableflow.sources import buckets, landing, partitions, readers, sinks, versions
from tableflow.sources.scratch import scratch_dir, written
from tableflow.streaming import append, bars as bar_stream, project, upsert as upsert_stream

AS_OF = "2026-01-01 12:30:00"
SINCE = "2024-01-15 00:00:00"

#: Small segments, so that series are cut already at sf0.01.
SMALL_SEGMENTS = Split(rows_per_segment=500)

INDICATOR_COLUMNS = [
    "moving_avg_14",
    "rsi_14",
    "ema_fast_12",
    "ema_slow_26",
    "macd",
    "macd_signal_9",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticks(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col(key).alias("symbol"), F.col("ts").alias("event_time"), F.col("value").alias("close")
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- Window family ---------------------------------------------------------------------------


def indicator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    return _rounded(indicators.indicators(ticks, tiebreak=[]), *INDICATOR_COLUMNS)


def indicators_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    result = indicators.indicators(ticks, tiebreak=[], split=SMALL_SEGMENTS)
    return _rounded(result, *INDICATOR_COLUMNS)


def indicators_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    start = F.lit(SINCE).cast("timestamp_ntz")
    return _rounded(indicators.indicators(ticks, tiebreak=[], since=start), *INDICATOR_COLUMNS)


def moving_avg_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "user_id")
    return _rounded(indicators.moving_average(ticks, 14, tiebreak=[]), "moving_avg")


def rsi_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "user_id")
    return _rounded(indicators.rsi(ticks, 14, tiebreak=[]), "rsi")


def macd_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "user_id")
    return _rounded(indicators.macd(ticks, 12, 26, tiebreak=[]), "macd")


def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "user_id")
    bands = indicators.bollinger(ticks, 20, 2.0, tiebreak=[])
    return _rounded(bands, "bb_lower", "bb_mid", "bb_upper")


def bollinger_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    bands = indicators.bollinger(ticks, 20, 2.0, tiebreak=[], split=SMALL_SEGMENTS)
    return _rounded(bands, "bb_lower", "bb_mid", "bb_upper")


def bollinger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "user_id")
    bands = indicators.bollinger_latest(ticks, 20, 2.0, tiebreak=[])
    return _rounded(bands, "bb_lower", "bb_mid", "bb_upper")


def moving_avg_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    return _rounded(indicators.moving_average(ticks, 150, tiebreak=[]), "moving_avg")


def bollinger_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    bands = indicators.bollinger(ticks, 150, 2.0, tiebreak=[])
    return _rounded(bands, "bb_lower", "bb_mid", "bb_upper")


def period_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and defined means per series for a period that some series are too short for, and whether bad periods are refused."""
    ticks = _ticks(spark, sf_dir, "user_id")
    refused = []
    for period in (0, -14):
        for refuse in (indicators.moving_average, indicators.rsi, indicators.bollinger):
            try:
                refuse(ticks, period, tiebreak=[])
                refused.append(False)
            except ValueError:
                refused.append(True)
    means = indicators.moving_average(ticks, 67, tiebreak=[]).groupBy("symbol")
    counted = means.agg(F.count("*").alias("rows"), F.count("moving_avg").alias("means"))
    return counted.withColumn("refused", F.lit(all(refused)))


def price_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type")
    return _rounded(
        indicators.price_delta(ticks, tiebreak=[]), "price_diff", "gain", "loss"
    )


def _broken_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with nulls and NaNs among the prices."""
    event = F.col("event_id")
    price = F.when(event % 97 == 0, float("nan")).when(event % 31 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("event_time"), price.alias("close")
    )


def _without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaNs as -1, since engines compare them differently."""
    return _rounded(
        df.withColumns({c: F.when(F.isnan(c), -1.0).otherwise(F.col(c)) for c in columns}), *columns
    )


def price_delta_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = indicators.price_delta(_broken_ticks(spark, sf_dir), tiebreak=[])
    return _without_nan(result, "close", "price_diff", "gain", "loss")


def indicators_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = indicators.indicators(_broken_ticks(spark, sf_dir), tiebreak=[])
    return _without_nan(result, "close", *INDICATOR_COLUMNS)


def indicators_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows from a time on, after a run that stored the last rows of each series before it."""
    ticks = _ticks(spark, sf_dir, "event_type")
    start = F.lit(SINCE).cast("timestamp_ntz")
    tail, _ = written(
        indicators.indicator_tail(ticks.filter(F.col("event_time") < start), tiebreak=[]), "tail"
    )
    new = ticks.filter(F.col("event_time") >= start)
    result = indicators.indicators(new, tiebreak=[], since=start, earlier=tail)
    return _rounded(result, *INDICATOR_COLUMNS)


def indicators_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table without some ticks and with others wrong, repaired by these ticks."""
    event = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("event_time"), F.col("value").alias("close"), "event_id"
    )
    wrong = F.when(event % 211 == 7, F.col("close") + 5).otherwise(F.col("close"))
    before = events.where(event % 197 != 3).withColumn("close", wrong)
    stored, _ = written(indicators.indicators(before, tiebreak=["event_id"]), "stored")
    changes = events.where((event % 197 == 3) | (event % 211 == 7))
    rows = repair.repair_indicators(stored, changes, tiebreak=["event_id"], bucket="6 hours")
    whole = repair.replace_rows(stored, written(rows, "repaired")[0], ["symbol", "event_time", "event_id"])
    return _rounded(whole.drop("event_id"), *INDICATOR_COLUMNS)


# --- Dedupe, cleaning, contracts ---------------------------------------------------------------

LINE_TIEBREAK = [
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return dedupe.latest_per_key(
        lines, ["l_orderkey", "l_linenumber"], "l_shipdate", LINE_TIEBREAK
    )


def clean_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int"))
    padded = table(spark, sf_dir, "documents").select(
        F.concat(spaces, "text", F.lit(" ")).alias("text"),
        F.concat("lang", spaces).alias("lang"),
        F.concat(F.lit(" "), "source").alias("source"),
    )
    return dedupe.clean_distinct(padded)


def _raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text versions: padded ids, and times that do not all parse."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit(" "), "user_id", F.lit("-"), "event_type", F.lit("  ")).alias("id"),
        F.when(F.col("event_id") % 50 == 0, F.lit("junk"))
        .otherwise(F.col("ts").cast("string"))
        .alias("updated_at"),
        "value",
        "event_id",
    )


def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = jobs.curate_plan(
        _raw_versions(spark, sf_dir), tiebreak=["event_id"], as_of=AS_OF
    )
    return _zoneless(result, "updated_at", "ingest_ts")


def ingest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns(rules.ingest_stamp(AS_OF))
    return _zoneless(orders, "ingest_ts")


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.quality_report(
        table(spark, sf_dir, "customer"),
        required=["c_custkey", "c_name", "c_phone"],
        types={"c_custkey": "bigint", "c_nationkey": "bigint", "c_phone": "string"},
        prices=["c_acctbal"],
        complete=["c_custkey", "c_name", "c_acctbal"],
    )


def contract_report_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.quality_report(
        table(spark, sf_dir, "customer"),
        types={"c_custkey": "BIGINT", "c_name": "String", "c_acctbal": "decimal(10,2)"},
        case_sensitive=False,
    )


def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that pass an exact schema; the same rows in another order of columns must not."""
    orders = table(spark, sf_dir, "orders")
    expected = contracts.require_schema(orders, orders.schema).schema
    try:
        contracts.require_schema(orders.select(*reversed(orders.columns)), expected)
    except contracts.ContractError:
        return orders.withColumn("outcome", F.lit("refused"))
    return orders.withColumn("outcome", F.lit("accepted"))


def null_nan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn(
        "value",
        F.when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("value")),
    )
    return contracts.null_nan_profile(events)


def _order_states(orders: DataFrame) -> DataFrame:
    return profiles.profile_state(orders.drop("o_orderpriority"), by=["o_orderstatus"])


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes of orders from stored states per status, after pending orders changed and were profiled anew."""
    orders = table(spark, sf_dir, "orders")
    pending = orders.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 0")
    changed = pending.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")))
    changed = changed.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    folder = scratch_dir(spark, "profiles")
    states = _order_states(orders)
    sinks.write_table(states, folder, partition_by="o_orderstatus")
    stored = readers.read_table(spark, folder, "parquet", states.schema)
    now = stored.filter("o_orderstatus <> 'P'").unionByName(_order_states(changed))
    merged = profiles.merge_profiles(now)
    return merged.drop("distinct_sketch", "value_sketch", "type")


def profile_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of orders drift when prices are trebled, some customers get lost, and one status is left."""
    orders = table(spark, sf_dir, "orders").drop("o_orderdate", "o_orderpriority")
    customer = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey"))
    after = orders.withColumns({"o_totalprice": F.col("o_totalprice") * 3, "o_custkey": customer, "o_orderstatus": F.lit("O")})
    states = [profiles.merge_profiles(profiles.profile_state(df)) for df in (orders, after)]
    drift = profiles.profile_drift(*states).select("column", "nulls_before", "nulls_after", F.array_join("reasons", ",").alias("reasons"))
    return _rounded(drift, "nulls_before", "nulls_after")


def price_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = clean.split_prices(table(spark, sf_dir, "customer"), "c_acctbal")
    return good.withColumn("outcome", F.lit("good")).unionByName(
        bad.withColumn("outcome", F.lit("quarantined"))
    )


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns(
        {
            "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
            "event_type": F.when(F.col("event_id") % 5 != 0, F.col("event_type")),
        }
    )
    return clean.complete_rows(events, ["event_type", "value"])


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        F.when(nation == 0, F.lit(" \t"))
        .when(nation == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t ")))
        .alias("segment"),
        F.when(nation == 2, F.lit("")).otherwise(F.concat(F.lit(" "), "c_name")).alias("name"),
    )
    return clean.standardize(
        raw,
        {
            "segment": rules.normalize_symbol("segment"),
            "name": rules.default_if_blank("name", "nobody"),
            "ratio": F.round(rules.safe_ratio("c_acctbal", "c_nationkey", -1.0), 6),
        },
    )


def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    seconds_text = F.regexp_replace(F.col("o_orderdate").cast("string"), " ", "T")
    day_text = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(order % 4 == 0, F.concat(seconds_text, F.lit("Z")))
        .when(order % 4 == 1, F.concat(seconds_text, F.lit("+02:00")))
        .when(order % 4 == 2, seconds_text)
        .otherwise(day_text)
        .alias("instant_text"),
        F.when(order % 3 == 0, day_text)
        .when(order % 3 == 1, F.concat(F.substring(day_text, 1, 8), F.lit("31")))
        .otherwise(F.regexp_replace(day_text, "-0", "-"))
        .alias("day_text"),
        (order * 86_399_500 - 1_000).alias("millis"),
    )
    return clean.standardize(
        raw,
        {
            "instant_millis": rules.epoch_millis("instant_text"),
            "day": rules.strict_date("day_text"),
            "millis_text": rules.iso_instant("millis"),
        },
    )


# --- Upsert --------------------------------------------------------------------------------------


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, keyed by twice their number."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 2).alias("event_id"),
        "o_orderdate",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
    )


def _order_rule() -> dict:
    return {
        "on": ["event_id"],
        "set": {"event_type": "o_orderstatus", "value": F.col("source.o_totalprice")},
        "insert": {
            "event_id": "event_id",
            "ts": "o_orderdate",
            "user_id": "o_custkey",
            "event_type": "o_orderstatus",
            "value": "o_totalprice",
        },
    }


def upsert_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into events: updates, inserts and kept rows."""
    return upsert.upsert(
        table(spark, sf_dir, "events"), _order_events(spark, sf_dir), **_order_rule()
    )


def upsert_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as for a large source: one full outer join."""
    return upsert.upsert(
        table(spark, sf_dir, "events"),
        _order_events(spark, sf_dir),
        hot=None,
        broadcast_bytes=0,
        **_order_rule(),
    )


def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both tables in buckets of the key, so that the merge shuffles neither."""
    stored = []
    for name, rows in (("events", table(spark, sf_dir, "events")), ("orders", _order_events(spark, sf_dir))):
        path = scratch_dir(spark, f"bucketed_{name}")
        stored.append(buckets.write_bucketed(rows, path.rpartition("/")[2].replace("-", "_"), path, ["event_id"], 8))
    return upsert.upsert(*stored, hot=None, broadcast_bytes=0, **_order_rule())


def upsert_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' totals into events by user, with users of many events handled as hot keys."""
    totals = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.max("o_totalprice").alias("most"))
    )
    return upsert.upsert(
        table(spark, sf_dir, "events"),
        totals,
        on=["user_id"],
        set={"value": "most"},
        insert={"user_id": "user_id", "value": "most"},
        hot=HotKeys(min_rows=8, sample_fraction=1.0),
        broadcast_bytes=0,
    )


def upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into a written table of events, in two batches, read back."""
    root = scratch_dir(spark, "stored")
    versions.write_version(table(spark, sf_dir, "events"), root)
    orders = _order_events(spark, sf_dir)
    versions.upsert_table(root, orders.filter("event_id % 4 = 0"), **_order_rule())
    return versions.upsert_table(root, orders.filter("event_id % 4 <> 0"), **_order_rule())


def upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders changed and added in a table partitioned by status; the other partitions stay as they are."""
    folder = scratch_dir(spark, "partitions")
    orders = table(spark, sf_dir, "orders")
    sinks.write_partitioned(orders, folder, "o_orderstatus")
    pending, key = orders.where("o_orderstatus = 'P'"), F.col("o_orderkey")
    changed = pending.where(key % 2 == 0).withColumn("o_totalprice", F.lit(0.5) + key)
    added = pending.where(key % 5 == 0).withColumn("o_orderkey", -1 - key)
    return partitions.upsert_partitions(
        spark,
        folder,
        changed.unionByName(added),
        schema=orders.schema,
        partition_by="o_orderstatus",
        on=["o_orderstatus", "o_orderkey"],
        set={"o_totalprice": "o_totalprice"},
        insert=upsert.copy_columns([c for c in orders.columns if c != "o_orderstatus"]) | {"o_orderstatus": "o_orderstatus"},
    )


def upsert_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order per customer into events of that user whose value is above a threshold."""
    events = table(spark, sf_dir, "events")
    last_order = dedupe.latest_per_key(
        table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]
    )
    return upsert.upsert_where(
        events,
        last_order,
        on=[("user_id", "o_custkey")],
        condition=F.col("target.value") > F.col("source.o_totalprice") / 5_000.0,
        target_id=["event_id"],
        set={"value": "o_totalprice", "event_type": F.lit("matched")},
        insert={
            "event_id": -1 - F.col("source.o_orderkey"),
            "ts": "o_orderdate",
            "user_id": "o_custkey",
            "event_type": F.lit("inserted"),
            "value": "o_totalprice",
        },
    )


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a span of 15 seconds each, one every 20 seconds."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").withColumn("low", start + F.make_dt_interval(secs=F.col("o_orderkey") * 20))
    return orders.withColumn("high", F.col("low") + F.make_dt_interval(secs=F.lit(15)))


def upsert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into the events of their time span; orders without one are inserted."""
    return upsert.upsert_range(
        table(spark, sf_dir, "events"),
        _order_spans(spark, sf_dir),
        point="ts",
        low="low",
        high="high",
        target_id=["event_id"],
        set={"value": "o_totalprice", "event_type": "o_orderstatus"},
        insert={
            "event_id": -1 - F.col("source.o_orderkey"),
            "ts": "low",
            "user_id": "o_custkey",
            "event_type": F.lit("inserted"),
            "value": "o_totalprice",
        },
        split=RangeSplit(rows_per_bin=500),
    )


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events lie in spans of one to 40 hours that orders open every hour, and their total."""
    hour = F.col("o_orderkey") % 720
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    spans = table(spark, sf_dir, "orders").groupBy(hour.alias("hour")).agg(F.max(F.col("o_custkey") % 40 + 1).alias("hours"))
    spans = spans.select(
        "hour",
        (start + F.make_dt_interval(hours=F.col("hour"))).alias("low"),
        (start + F.make_dt_interval(hours=F.col("hour") + F.col("hours"))).alias("high"),
    )
    joined = ranges.interval_join(
        table(spark, sf_dir, "events"), spans, point="ts", low="low", high="high", split=RangeSplit(rows_per_bin=300)
    )
    return joined.groupBy("hour", "event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


# --- Bars ------------------------------------------------------------------------------------------


def bars_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of times cut to hours, so that open and close depend on the tiebreak."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("event_time"),
        F.col("value").alias("close"),
        "event_id",
    )
    return bar_ops.bars(ticks, "1 day", tiebreak=["event_id"]).drop("volume")


def bars_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from stored hourly ones, into which the states of late ticks were merged."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("event_time"), F.col("value").alias("close"), "event_id"
    )
    rule = {"tiebreak": ["event_id"], "volume": "close"}
    late = F.col("event_id") % 7 == 3
    stored, _ = written(bar_ops.bar_states(ticks.where(~late), "1 hour", **rule), "bars")
    further = bar_ops.bar_states(ticks.where(late), "1 hour", **rule)
    hourly = upsert.upsert(
        stored, further, on=["symbol", "event_time"], set=bar_ops.merge_rule(), insert=upsert.copy_columns(stored.columns)
    )
    return _rounded(bar_ops.without_state(bar_ops.roll_up(hourly, "1 day")), "volume")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir, "event_type").withColumn("volume", F.col("close"))
    return _rounded(bar_ops.bars(ticks, "1 hour", tiebreak=[], volume="volume"), "volume")


# --- Sources, sinks, jobs ----------------------------------------------------------------------------

ORDER_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and as JSON lines, read back with a declared schema."""
    orders = table(spark, sf_dir, "orders")
    folder = scratch_dir(spark, "text_sources")
    orders.write.option("header", True).csv(f"{folder}/csv")
    orders.write.json(f"{folder}/json")
    from_csv = readers.read_table(spark, f"{folder}/csv", "csv", ORDER_SCHEMA, probe=True)
    from_json = readers.read_table(
        spark, f"{folder}/absent", "json", ORDER_SCHEMA, fallback_path=f"{folder}/json"
    )
    return from_csv.withColumn("read_from", F.lit("csv")).unionByName(
        from_json.withColumn("read_from", F.lit("json"))
    )


def landed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV with its columns in another order, and as JSON, both with broken lines."""
    folder = scratch_dir(spark, "landed_text")
    names = ["o_totalprice", "o_orderstatus", "o_orderkey", "o_custkey"]
    orders = table(spark, sf_dir, "orders").select(*names)
    key = F.col("o_orderkey")
    csv = F.concat_ws(",", *names, F.when(key % 20 == 0, F.lit("one,two")))
    # One column, named like the whole header and never quoted, makes files of whole lines.
    lines = orders.select(csv.alias(",".join(names))).write.option("header", True)
    lines.option("sep", "\u0001").option("quote", "\u0000").csv(f"{folder}/csv")
    json = F.when(key % 25 == 0, F.concat(F.lit("{broken "), key)).otherwise(F.to_json(F.struct(*names)))
    orders.select(json.alias("value")).write.text(f"{folder}/json")
    parts = []
    for fmt in ("csv", "json"):
        landed = landing.land_text(
            spark,
            f"{folder}/{fmt}",
            fmt,
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double",
            quarantine_path=f"{folder}/broken_{fmt}",
        )
        broken = readers.read_table(spark, f"{folder}/broken_{fmt}", "parquet", landing.QUARANTINE_SCHEMA)
        number = F.regexp_extract("line", r"^\{broken (\d+)$|^[^,]*,[^,]*,(\d+),", 0)
        parts.append(landed.rows.withColumn("read_from", F.lit(fmt)))
        parts.append(
            broken.select(
                F.regexp_extract(number, r"(\d+),?$", 1).cast("bigint").alias("o_orderkey"),
                F.lit(None).cast("bigint").alias("o_custkey"),
                F.lit(None).cast("string").alias("o_orderstatus"),
                F.lit(None).cast("double").alias("o_totalprice"),
                F.lit(f"broken {fmt}").alias("read_from"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one folder of CSV files with three headers, some lines broken, landed into one table."""
    folder = scratch_dir(spark, "mixed_headers")
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("note", F.concat(F.lit("note "), key))
    headers = [
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"],
        ["o_totalprice", "note", "o_orderstatus", "o_orderkey", "o_custkey"],
        ["o_orderstatus", "o_orderkey"],
    ]
    for i, names in enumerate(headers):
        line = F.concat_ws(",", *names, F.when(key % 20 == 0, F.lit("one,two")))
        files = orders.filter(key % 3 == i).select(line.alias(",".join(names))).write.mode("append").option("header", True)
        files.option("sep", "\u0001").option("quote", "\u0000").csv(f"{folder}/in")
    landed = landing.land_text(
        spark,
        f"{folder}/in",
        "csv",
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double",
        quarantine_path=f"{folder}/broken",
        mixed_headers=True,
    )
    broken = readers.read_table(spark, f"{folder}/broken", "parquet", landing.QUARANTINE_SCHEMA)
    lines = broken.groupBy(F.size(F.split("line", ",")).cast("bigint").alias("o_custkey")).agg(F.count("*").alias("o_orderkey"))
    counts = lines.select(
        "o_orderkey", "o_custkey", F.lit("broken").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice")
    )
    return landed.rows.unionByName(counts)


def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a table in two halves, by partition, read back."""
    folder = scratch_dir(spark, "append")
    orders = table(spark, sf_dir, "orders")
    for half in (0, 1):
        part = orders.filter(F.col("o_orderkey") % 2 == half)
        sinks.write_table(part, f"{folder}/out", mode="append", partition_by="o_orderstatus")
    return readers.read_table(spark, f"{folder}/out", "parquet", orders.schema).select(*orders.columns)


def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the bronze table."""
    folder = scratch_dir(spark, "bronze_rows")
    orders = table(spark, sf_dir, "orders")
    orders.write.option("header", True).csv(f"{folder}/raw")
    jobs.bronze_job(
        spark,
        f"{folder}/raw",
        f"{folder}/bronze",
        schema=ORDER_SCHEMA.replace("timestamp_ntz", "string"),
        time="o_orderdate",
        partition_by="o_orderstatus",
        as_of=AS_OF,
    )
    stored = readers.read_table(
        spark,
        f"{folder}/bronze",
        "parquet",
        ORDER_SCHEMA.replace("timestamp_ntz", "timestamp") + ", ingest_ts timestamp, ingest_date date",
    )
    return _zoneless(stored, "o_orderdate", "ingest_ts")


def verified_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by status and verified, and the same with two prices swapped between rows of one status."""
    orders = table(spark, sf_dir, "orders")
    report, all_there = sinks.write_and_verify(orders, scratch_dir(spark, "verified"), "o_orderstatus")
    pair = orders.groupBy("o_orderstatus").agg(
        F.max(F.struct("o_totalprice", "o_orderkey")).alias("high"), F.min(F.struct("o_totalprice", "o_orderkey")).alias("low")
    )
    price = F.when(F.col("o_orderkey") == F.col("high.o_orderkey"), F.col("low.o_totalprice")).when(
        F.col("o_orderkey") == F.col("low.o_orderkey"), F.col("high.o_totalprice")
    )
    pending = F.col("o_orderstatus") == "P"
    swapped = orders.join(pair, "o_orderstatus").withColumn(
        "o_totalprice", F.when(pending, F.coalesce(price, F.col("o_totalprice"))).otherwise(F.col("o_totalprice"))
    )
    compared = sinks.reconcile_contents(orders, swapped.select(*orders.columns), "o_orderstatus")
    columns = ["o_orderstatus", "rows_sent", "rows_read", "ok"]
    return report.select(*columns).withColumn("whole", F.lit(all_there)).unionByName(
        compared.select(*columns).withColumn("whole", F.lit(None).cast("boolean"))
    )


def bronze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "bronze")
    orders = table(spark, sf_dir, "orders")
    orders.write.option("header", True).csv(f"{folder}/raw")
    schema = ORDER_SCHEMA.replace("timestamp_ntz", "string")
    report, _ = jobs.bronze_job(
        spark,
        f"{folder}/raw",
        f"{folder}/bronze",
        schema=schema,
        time="o_orderdate",
        partition_by="o_orderstatus",
        as_of=AS_OF,
    )
    return report


def market_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "market")
    ticks = _ticks(spark, sf_dir, "event_type").withColumn(
        "event_time", F.col("event_time").cast("string")
    )
    ticks.write.option("header", True).csv(f"{folder}/ticks")
    result = jobs.market_job(
        spark,
        f"{folder}/ticks",
        f"{folder}/out",
        tiebreak=[],
        schema="symbol string, event_time string, close string",
        as_of=AS_OF,
    )
    return _zoneless(_rounded(result, *INDICATOR_COLUMNS), "event_time", "ingest_ts")


def curate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "curate")
    _raw_versions(spark, sf_dir).write.json(f"{folder}/raw")
    result = jobs.curate_job(
        spark,
        f"{folder}/raw",
        f"{folder}/out",
        tiebreak=["event_id"],
        schema="id string, updated_at string, value double, event_id bigint",
        as_of=AS_OF,
    )
    return _zoneless(result, "updated_at", "ingest_ts")


# --- Streaming -----------------------------------------------------------------------------------------


def _event_files(spark: SparkSession, sf_dir: str, folder: str, files: int) -> DataFrame:
    """Events as a folder of several files; returns a DataFrame with their schema."""
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(files, "event_id").write.parquet(folder)
    return events


def stream_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "stream_project")
    events = _event_files(spark, sf_dir, f"{folder}/in", 4)
    jobs.tick_stream_job(
        spark,
        f"{folder}/in",
        f"{folder}/out",
        f"{folder}/checkpoint",
        events.schema,
        run_seconds=None,
        available_now=True,
        max_files_per_trigger=2,
        time="ts",
        value="event_id",
    )
    written = project.project_ticks(events, "ts", "event_id").schema
    return readers.read_table(spark, f"{folder}/out", "parquet", written)


def stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job over CSV files whose columns stand in another order than declared."""
    folder = scratch_dir(spark, "stream_csv")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    texts = events.withColumn("ts", F.col("ts").cast("string"))  # Spark's own text of a time in CSV has no microseconds
    turned = texts.select(*reversed(events.columns)).repartitionByRange(4, "event_id")
    turned.write.option("header", True).csv(f"{folder}/in")
    jobs.tick_stream_job(
        spark,
        f"{folder}/in",
        f"{folder}/out",
        f"{folder}/checkpoint",
        events.schema,
        run_seconds=None,
        available_now=True,
        max_files_per_trigger=2,
        time="ts",
        value="event_id",
        input_format="csv",
    )
    return readers.read_table(spark, f"{folder}/out", "parquet", project.project_ticks(events, "ts", "event_id").schema)


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "stream_bars")
    events = _event_files(spark, sf_dir, f"{folder}/in", 4)
    ticks = readers.read_stream(spark, f"{folder}/in", events.schema).select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("close"),
    )
    closed = bar_stream.stream_bars(ticks, "1 hour", "1 hour", tiebreak=[])
    query = append.start_append(
        closed, f"{folder}/out", f"{folder}/checkpoint", available_now=True
    )
    append.run_to_end(query)
    stored = readers.read_table(spark, f"{folder}/out", "parquet", closed.schema)
    return _zoneless(stored, "event_time").drop("volume")


def stream_bars_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a backfill, and those that were still open at its end."""
    ticks = _ticks(spark, sf_dir, "event_type")
    still_open = bar_stream.open_bars(ticks, "1 hour", "1 hour", tiebreak=[])
    still_open = _zoneless(still_open, "event_time").drop("volume")
    return stream_bars(spark, sf_dir).unionByName(still_open)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "stream_upsert")
    events = _event_files(spark, sf_dir, f"{folder}/in", 3)
    stream = readers.read_stream(
        spark, f"{folder}/in", events.schema, max_files_per_trigger=1
    )
    rule = {"keys": ["user_id", "event_type"], "order_by": "ts", "tiebreak": ["event_id"]}
    append.run_to_end(
        upsert_stream.start_upsert(stream, f"{folder}/table", f"{folder}/checkpoint", **rule)
    )
    return upsert_stream.current_table(spark, f"{folder}/table", events.schema, **rule)


def stream_upsert_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with other batches, rows without a key, and a compaction between two runs."""
    folder = scratch_dir(spark, "stream_upsert")
    user = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    events = table(spark, sf_dir, "events").withColumn("user_id", user)
    rule = {"keys": ["user_id", "event_type"], "order_by": "ts", "tiebreak": ["event_id"]}
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        events.filter(part).repartition(4).write.mode("append").parquet(f"{folder}/in")
        stream = readers.read_stream(
            spark, f"{folder}/in", events.schema, max_files_per_trigger=2
        )
        append.run_to_end(
            upsert_stream.start_upsert(stream, f"{folder}/table", f"{folder}/checkpoint", **rule)
        )
        upsert_stream.compact(spark, f"{folder}/table", events.schema, **rule)
    return upsert_stream.current_table(spark, f"{folder}/table", events.schema, **rule)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "indicators": indicator_table,
    "indicators_segmented": indicators_segmented,
    "indicators_since": indicators_since,
    "indicators_incremental": indicators_incremental,
    "indicators_repaired": indicators_repaired,
    "indicators_nan": indicators_nan,
    "moving_avg_strict": moving_avg_strict,
    "rsi_strict": rsi_strict,
    "macd_strict": macd_strict,
    "bollinger": bollinger,
    "moving_avg_long": moving_avg_long,
    "bollinger_long": bollinger_long,
    "period_guards": period_guards,
    "bollinger_segmented": bollinger_segmented,
    "bollinger_latest": bollinger_latest,
    "price_delta": price_delta,
    "price_delta_nan": price_delta_nan,
    "latest_per_key": latest_per_key,
    "clean_distinct": clean_distinct,
    "curate": curate,
    "ingest_stamp": ingest_stamp,
    "contract_report": contract_report,
    "contract_report_any_case": contract_report_any_case,
    "schema_gate": schema_gate,
    "null_nan_profile": null_nan_profile,
    "profile_merged": profile_merged,
    "profile_drifted": profile_drifted,
    "price_split": price_split,
    "complete_rows": complete_rows,
    "standardize": standardize,
    "date_rules": date_rules,
    "upsert_equi": upsert_equi,
    "upsert_large": upsert_large,
    "upsert_bucketed": upsert_bucketed,
    "upsert_hot": upsert_hot,
    "upsert_stored": upsert_stored,
    "upsert_partitions": upsert_partitions,
    "upsert_theta": upsert_theta,
    "upsert_range": upsert_range,
    "interval_join": interval_join,
    "bars_rolled_up": bars_rolled_up,
    "bars_hourly": bars_hourly,
    "bars_tiebreak": bars_tiebreak,
    "text_sources": text_sources,
    "landed_text": landed_text,
    "mixed_headers": mixed_headers,
    "append_twice": append_twice,
    "verified_write": verified_write,
    "bronze_roundtrip": bronze_roundtrip,
    "bronze_rows": bronze_rows,
    "market_job": market_job,
    "curate_job": curate_job,
    "stream_project": stream_project,
    "stream_csv": stream_csv,
    "stream_bars": stream_bars,
    "stream_bars_all": stream_bars_all,
    "stream_upsert": stream_upsert,
    "stream_upsert_null_keys": stream_upsert_null_keys,
}
