"""Batch writes with contract checks and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import named
from tableflow.operators.contracts import ContractError, require_appendable, require_columns

WRITE_MODES = ("append", "overwrite")


def _location(path: str, with_host: bool) -> str:
    parts = urlsplit(path)
    return (f"{parts.netloc}/" if with_host else "") + parts.path.strip("/")


def input_roots(df: DataFrame) -> list[str]:
    """The paths that ``df`` scans as they were given, not the files below them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        relation = leaf.relation() if leaf.nodeName().startswith("LogicalRelation") else None
        if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation":
            continue
        paths = relation.location().rootPaths()
        roots += [paths.apply(k).toString() for k in range(paths.size())]
    return roots


def refuse_overwriting_input(df: DataFrame, path: str) -> None:
    """Raise if ``df`` reads files below ``path``: an overwrite deletes them before the read."""
    with_host = bool(urlsplit(path).netloc)
    target = _location(path, with_host) + "/"
    for root in input_roots(df):
        source = _location(root, with_host and bool(urlsplit(root).netloc)) + "/"
        if source.startswith(target) or target.startswith(source):
            raise ValueError(f"The rows to write are read from {root}; write to another path")


def existing_schema(spark: SparkSession, path: str, fmt: str) -> T.StructType | None:
    """Schema of the table at ``path``, or None where there is no table yet."""
    try:
        return spark.read.format(fmt).load(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def existing_partitioning(spark: SparkSession, path: str, fmt: str) -> list[str] | None:
    """Partition columns of a table of files, told from the place of one file; None if empty."""
    stored = spark.read.format(fmt).load(path).select(F.input_file_name().alias("file"))
    one = stored.limit(1).first()
    if one is None:
        return None
    with_host = bool(urlsplit(path).netloc)
    inside = _location(one.file, with_host)[len(_location(path, with_host)) :]
    return [unquote(step.split("=")[0]) for step in inside.split("/")[:-1] if "=" in step]


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Write a table; an append to an existing table must match its columns and types.

    Parquet itself accepts a mismatched append and fails or loses rows at a later read. Partition
    columns are compared by name only, since a read infers their types from directory names.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}, got {mode!r}")
    if partition_by is not None:
        require_columns(df, [partition_by])
    if mode == "append":
        existing = existing_schema(df.sparkSession, path, fmt)
        if existing is not None:
            wanted = [] if partition_by is None else [partition_by]
            found = existing_partitioning(df.sparkSession, path, fmt)
            if found is not None and found != wanted:
                raise ContractError(f"The table is partitioned by {found}, not by {wanted}")
            checked = T.StructType([f for f in existing.fields if f.name != partition_by])
            require_appendable(df.drop(partition_by) if partition_by else df, checked)
    else:
        refuse_overwriting_input(df, path)
    writer = df.write.format(fmt).mode(mode)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return df


def write_partitioned(df: DataFrame, path: str, partition_by: str = "symbol") -> DataFrame:
    """Overwrite a Parquet table partitioned by one column.

    Rebalancing groups the rows of a partition value, which bounds the number of files, and
    splits a value that is too large for one task, which a plain repartition would not.
    """
    require_columns(df, [partition_by])
    refuse_overwriting_input(df, path)
    (
        df.hint("rebalance", named(partition_by))
        .write.mode("overwrite")
        .partitionBy(partition_by)
        .parquet(path)
    )
    return df


def row_fingerprint(columns: Sequence[str], schema: T.StructType) -> Column:
    """A whole number for each row, from all of its columns by name, types included; sums of it do not depend on the order of rows.

    It is cut from a SHA-256 digest, so that two changes hardly ever cancel out. Columns of maps have no fixed order and are refused.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    if maps := [c for c in columns if "map<" in kinds[c].simpleString()]:
        raise ContractError(f"Columns with maps have no fingerprint: {maps}")
    parts = [
        F.coalesce(F.concat(F.lit(f"{c}={kinds[c].simpleString()}:"), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{c}:null"))
        for c in sorted(columns)
        for text in [_exact_text(named(c), kinds[c])]
    ]
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def _exact_text(value: Column, kind: T.DataType) -> Column:
    """A text that unequal values do not share; -0.0 counts as 0.0."""
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))
    return value.cast("string")


def reconcile_contents(sent: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Rows and fingerprints of both tables per value of ``by``: ``(by, rows_sent, rows_read, print_sent, print_read, ok)``.

    A fingerprint is the sum of :func:`row_fingerprint` over the columns of ``sent``, so ``ok`` says that both tables hold the same rows the same number
    of times, in any order. Each side is one scan, combined in the map tasks.
    """
    require_columns(stored, sent.columns)
    sides = []
    for side, df in (("sent", sent), ("read", stored)):
        value = row_fingerprint(sent.columns, sent.schema)
        typed = df.select(*(named(f.name).cast(f.dataType).alias(f.name) for f in sent.schema.fields))
        sides.append(
            typed.groupBy(named(by)).agg(F.count(F.lit(1)).alias(f"rows_{side}"), F.sum(value).alias(f"print_{side}"))
        )
    quoted = by.replace("`", "``")
    same = F.col(f"s.`{quoted}`").eqNullSafe(F.col(f"r.`{quoted}`"))
    joined = sides[0].alias("s").join(sides[1].alias("r"), same, "full_outer")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("rows_sent", "rows_read", "print_sent", "print_read")}
    return joined.select(
        F.coalesce(F.col(f"s.`{quoted}`"), F.col(f"r.`{quoted}`")).alias(by),
        *(v.cast("bigint" if c.startswith("rows") else "decimal(38,0)").alias(c) for c, v in numbers.items()),
        ((numbers["rows_sent"] == numbers["rows_read"]) & (numbers["print_sent"] == numbers["print_read"])).alias("ok"),
    )


def write_and_verify(df: DataFrame, path: str, partition_by: str = "symbol") -> tuple[DataFrame, bool]:
    """Write a partitioned table and compare what was read back with what passed to the writer.

    Returns (report, whether all rows are there unchanged). The fingerprint of all rows is taken by ``observe`` while they are written, so ``df`` is
    evaluated once for it; after the loss of an executor it can count repeated work twice, and the answer is then no rather than yes. The
    report, :func:`reconcile_contents`, is exact, runs only when used, and reads ``df`` again.
    """
    sent = Observation()
    value = F.sum(row_fingerprint(df.columns, df.schema)).alias("print")
    write_partitioned(df.observe(sent, F.count(F.lit(1)).alias("rows"), value), path, partition_by)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    read = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_fingerprint(df.columns, df.schema)).alias("print")).first()
    return reconcile_contents(df, stored, partition_by), (sent.get["rows"], sent.get["print"]) == (read["rows"], read["print"])


def write_and_reconcile(
    df: DataFrame, path: str, partition_by: str = "symbol"
) -> tuple[DataFrame, int]:
    """Write a partitioned table and compare it with what was sent.

    Returns (report, rows sent). Rows sent are counted as they pass to the writer; after the loss
    of an executor they can count repeated work twice. The report is exact and runs only when
    used: one line per partition value, ``(partition_by, rows_sent, rows_read, ok)``, from one
    column of the input and the file footers of the output. The input is read again for that, so pass a
    stored table, as the jobs do, and not a parse of raw text.
    """
    sent = Observation()
    write_partitioned(df.observe(sent, F.count(F.lit(1)).alias("rows")), path, partition_by)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return reconcile(df, stored, partition_by), int(sent.get["rows"])


def reconcile(sent: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Row counts per value of ``by`` in both tables, side by side."""
    left = sent.groupBy(named(by)).agg(F.count(F.lit(1)).alias("rows_sent"))
    right = stored.groupBy(named(by)).agg(F.count(F.lit(1)).alias("rows_read"))
    same = F.col("s.`" + by + "`").eqNullSafe(F.col("r.`" + by + "`"))
    none = F.lit(0).cast("bigint")
    return (
        left.alias("s")
        .join(right.alias("r"), same, "full_outer")
        .select(
            F.coalesce(F.col("s.`" + by + "`"), F.col("r.`" + by + "`")).alias(by),
            F.coalesce("rows_sent", none).alias("rows_sent"),
            F.coalesce("rows_read", none).alias("rows_read"),
            (F.coalesce("rows_sent", none) == F.coalesce("rows_read", none)).alias("ok"),
        )
    )
