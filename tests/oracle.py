"""Compare a registered query with its SQL: columns, kinds of types, rows and values."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return f"float:{value + 0.0!r}"
    return f"{type(value).__name__}:{value}"


def _rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(t[i]) for i in order) for t in tuples)


def compare(df, con, sql):
    """Differences as text; empty when the results are equal."""
    spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} / {sorted(names)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows: {len(spark_rows)} / {len(duck_rows)}"
    wrong = [(s, d) for s, d in zip(spark_rows, duck_rows) if s != d]
    if wrong:
        return f"{len(wrong)} of {len(spark_rows)} rows differ, first {wrong[0]}"
    return ""
