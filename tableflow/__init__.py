"""tableflow: table and stream jobs on Spark DataFrames."""

from tableflow.functions.columns import (
    all_present,
    default_if_blank,
    epoch_millis,
    ingest_stamp,
    is_valid_price,
    iso_instant,
    normalize_symbol,
    parse_double,
    parse_timestamp,
    safe_ratio,
    strict_date,
)
from tableflow.operators.bars import bar_states, bars, merge_rule, roll_up, without_state
from tableflow.operators.clean import (
    complete_rows,
    split_prices,
    split_rows,
    standardize,
    trim_strings,
)
from tableflow.operators.contracts import (
    ContractError,
    has_columns,
    null_nan_profile,
    quality_report,
    require_clean,
    require_columns,
    require_no_nan,
    require_schema,
    require_types,
)
from tableflow.operators.dedupe import clean_distinct, latest_per_key
from tableflow.operators.indicators import (
    bollinger,
    bollinger_latest,
    indicator_tail,
    indicators,
    macd,
    moving_average,
    price_delta,
    rsi,
)
from tableflow.operators.profiles import merge_profiles, profile_drift, profile_state, read_profile
from tableflow.operators.ranges import RangeSplit, interval_join
from tableflow.operators.repair import repair_indicators, replace_rows
from tableflow.operators.segments import Split
from tableflow.operators.skew import HotKeys
from tableflow.operators.upsert import copy_columns, newest_wins, upsert, upsert_range, upsert_where
from tableflow.plans.jobs import bronze_job, curate_job, market_job, tick_stream_job
from tableflow.sources.buckets import open_bucketed, write_bucketed
from tableflow.sources.landing import Landed, land_text
from tableflow.sources.partitions import upsert_partitions
from tableflow.sources.readers import read_stream, read_table
from tableflow.sources.scratch import drop_scratch, scratch_dir, scratch_scope
from tableflow.sources.sinks import (
    reconcile,
    reconcile_contents,
    write_and_reconcile,
    write_and_verify,
    write_partitioned,
    write_table,
)
from tableflow.sources.versions import read_version, upsert_table, write_version
from tableflow.streaming.append import run_bounded, run_to_end, start_append
from tableflow.streaming.bars import open_bars, stream_bars
from tableflow.streaming.project import project_ticks
from tableflow.streaming.upsert import compact, current_table, start_upsert, upsert_batch

__all__ = [
    "Landed",
    "compact",
    "drop_scratch",
    "land_text",
    "read_version",
    "scratch_dir",
    "scratch_scope",
    "upsert_table",
    "write_version",
    "ContractError",
    "HotKeys",
    "RangeSplit",
    "Split",
    "all_present",
    "bar_states",
    "bars",
    "bollinger",
    "bollinger_latest",
    "bronze_job",
    "clean_distinct",
    "complete_rows",
    "copy_columns",
    "curate_job",
    "current_table",
    "default_if_blank",
    "epoch_millis",
    "has_columns",
    "indicator_tail",
    "indicators",
    "ingest_stamp",
    "interval_join",
    "is_valid_price",
    "iso_instant",
    "latest_per_key",
    "macd",
    "market_job",
    "merge_profiles",
    "merge_rule",
    "moving_average",
    "newest_wins",
    "normalize_symbol",
    "null_nan_profile",
    "parse_double",
    "parse_timestamp",
    "price_delta",
    "profile_drift",
    "profile_state",
    "project_ticks",
    "quality_report",
    "read_profile",
    "read_stream",
    "read_table",
    "reconcile",
    "reconcile_contents",
    "repair_indicators",
    "replace_rows",
    "require_clean",
    "require_columns",
    "require_no_nan",
    "require_schema",
    "require_types",
    "roll_up",
    "rsi",
    "run_bounded",
    "run_to_end",
    "safe_ratio",
    "split_prices",
    "split_rows",
    "standardize",
    "start_append",
    "start_upsert",
    "open_bars",
    "open_bucketed",
    "stream_bars",
    "strict_date",
    "tick_stream_job",
    "trim_strings",
    "upsert",
    "upsert_batch",
    "upsert_partitions",
    "upsert_range",
    "upsert_where",
    "without_state",
    "write_and_reconcile",
    "write_and_verify",
    "write_bucketed",
    "write_partitioned",
    "write_table",
]
