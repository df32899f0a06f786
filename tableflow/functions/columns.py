"""Column rules used by the table operators.

Each rule is one Spark expression, so any number of them folds into a single projection and
works the same on a batch and on a streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: results depend on these exact texts and numbers -------------------------
UNKNOWN_SYMBOL = "UNKNOWN"
BLANK_PATTERN = r"^\p{javaWhitespace}*\z"
TRIM_PATTERN = r"^[\x00-\x20]+|[\x00-\x20]+\z"
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}\z"
DATE_FORMAT = "yyyy-MM-dd"
MILLIS_PER_DAY = 86_400_000
# -------------------------------------------------------------------------------------------

BAD_VALUE_POLICIES = ("null", "raise")


def named(name: str) -> Column:
    """Column by its literal name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: str | Column) -> Column:
    return named(value) if isinstance(value, str) else value


def is_blank(value: str | Column) -> Column:
    """True for null, empty and whitespace-only text; never null."""
    c = as_column(value)
    return c.isNull() | c.rlike(BLANK_PATTERN)


def normalize_symbol(value: str | Column) -> Column:
    """Upper-case text without leading and trailing control characters or spaces.

    Null and blank input becomes ``UNKNOWN``.
    """
    c = as_column(value)
    trimmed = F.regexp_replace(c, TRIM_PATTERN, "")
    return F.when(is_blank(c), F.lit(UNKNOWN_SYMBOL)).otherwise(F.upper(trimmed))


def default_if_blank(value: str | Column, default: str) -> Column:
    """``default`` for null or blank text, otherwise the text unchanged (not trimmed)."""
    c = as_column(value)
    return F.when(is_blank(c), F.lit(default)).otherwise(c)


def safe_ratio(numerator: str | Column, denominator: str | Column, default: float) -> Column:
    """numerator / denominator, or ``default`` where the denominator is zero.

    A null on either side stays null. Safe with ANSI mode on.
    """
    n = as_column(numerator).cast("double")
    d = as_column(denominator).cast("double")
    return F.when(d == 0.0, F.lit(float(default))).otherwise(n / d)


def parse_timestamp(value: str | Column) -> Column:
    """Text to timestamp; text that does not parse becomes null instead of failing the job."""
    return F.try_to_timestamp(as_column(value))


def parse_double(value: str | Column) -> Column:
    """Anything to double; text that does not parse becomes null."""
    return as_column(value).try_cast("double")


def is_valid_price(value: str | Column) -> Column:
    """True for a number above zero; false (never null) for null, NaN, zero and negatives."""
    c = as_column(value).cast("double")
    return F.coalesce(~F.isnan(c) & (c > 0), F.lit(False))


def all_present(*values: str | Column) -> Column:
    """True where no listed value is null. NaN counts as present; an empty list is true."""
    return reduce(lambda acc, v: acc & as_column(v).isNotNull(), values, F.lit(True))


def _with_policy(source: Column, parsed: Column, on_bad: str, what: str) -> Column:
    if on_bad not in BAD_VALUE_POLICIES:
        raise ValueError(f"on_bad must be one of {BAD_VALUE_POLICIES}, got {on_bad!r}")
    if on_bad == "null":
        return parsed
    message = F.concat(F.lit(f"Invalid {what}: "), source)
    return F.when(
        source.isNotNull() & parsed.isNull(), F.raise_error(message).cast("string")
    ).otherwise(parsed.cast("string"))


def epoch_millis(value: str | Column, on_bad: str = "null") -> Column:
    """ISO-8601 instant text (date, ``T``, time with seconds, zone) to epoch milliseconds.

    Text without a zone or without a time is invalid. ``on_bad`` is ``null`` or ``raise``; to
    quarantine bad rows, split the table on the result being null.
    """
    c = as_column(value)
    parsed = F.when(c.rlike(INSTANT_PATTERN), F.unix_millis(c.try_cast("timestamp")))
    return _with_policy(c, parsed, on_bad, "ISO timestamp").cast("bigint")


def strict_date(value: str | Column, on_bad: str = "null") -> Column:
    """``yyyy-MM-dd`` text of a real calendar day, unchanged; anything else is invalid."""
    c = as_column(value)
    real_day = F.when(c.rlike(DATE_PATTERN), c).try_cast("date").isNotNull()
    return _with_policy(c, F.when(real_day, c), on_bad, "date, expected yyyy-MM-dd")


def iso_instant(millis: str | Column) -> Column:
    """Epoch milliseconds to ISO text in UTC, leaving out seconds and fraction when zero.

    Integer arithmetic only, so the session time zone has no influence. Null where the number of
    days is beyond the DATE type.
    """
    ms = as_column(millis).cast("bigint")
    rest = ms % MILLIS_PER_DAY
    before_epoch = rest < 0
    of_day = F.when(before_epoch, rest + MILLIS_PER_DAY).otherwise(rest)
    whole_days = F.round((ms - rest) / MILLIS_PER_DAY).cast("bigint")
    days = F.when(before_epoch, whole_days - 1).otherwise(whole_days).try_cast("int")

    def digits(part: Column, width: int) -> Column:
        return F.lpad(F.floor(part).cast("string"), width, "0")

    minute_text = F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"),
        F.lit("T"),
        digits(of_day / 3_600_000, 2),
        F.lit(":"),
        digits(F.pmod(of_day / 60_000, F.lit(60)), 2),
    )
    second_text = digits(F.pmod(of_day / 1_000, F.lit(60)), 2)
    fraction_text = digits(F.pmod(of_day, F.lit(1_000)), 3)
    tail = (
        F.when(of_day % 60_000 == 0, F.lit(""))
        .when(of_day % 1_000 == 0, F.concat(F.lit(":"), second_text))
        .otherwise(F.concat(F.lit(":"), second_text, F.lit("."), fraction_text))
    )
    return F.concat(minute_text, tail, F.lit("Z"))


def ingest_stamp(as_of: str | Column | None = None) -> dict[str, Column]:
    """The two ingest columns, for ``df.withColumns(...)``.

    ``as_of`` fixes the instant (a timestamp text or Column) so that a re-run or a test gives
    the same result; by default it is the query's start time. ``ingest_date`` is the date in
    the session time zone.
    """
    if as_of is None:
        instant = F.current_timestamp()
    elif isinstance(as_of, str):
        instant = F.lit(as_of).cast("timestamp")
    else:
        instant = as_of
    return {"ingest_ts": instant, "ingest_date": F.to_date(instant)}
