"""What several operators share: bounded Arrow batches, tables written between steps, sorted group streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tristrata.session import new_work_path


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> SparkSession:
    """Keep Arrow batches small, as single texts may be long: at most ``rows`` rows and about ``megabytes`` each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return spark


#: Short rows (some numbers) of one file between steps.
FILE_ROWS = 200_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most about ``rows`` short rows in as many partitions as these fill, but enough for all cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS + 1))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared work folder and read back, so that a lost executor costs no recomputation.

    The files stay until the folder is cleaned, as lazy results may still read them.
    """
    spark, path = df.sparkSession, new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from one sequence per field."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of sorted batches, one table for each run; runs may cross batches.

    Only for keys whose number of rows is bounded, as a run is held in memory.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for rows in batches:
        if not rows.num_rows:
            continue
        values = list(zip(*(rows.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start]:
                continue
            if held and values[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(rows.slice(start, i - start))
            last, start = values[start], i
    if held:
        yield pa.Table.from_batches(held)


def bounded_sample(df: DataFrame, label: str, key: str, rows: dict | int) -> DataFrame:
    """About ``rows[l]`` rows (all, if there are fewer) of each label ``l``, chosen by a hash of ``key``; one for each key.

    Rows of equal label and key count once, however often they repeat, and one of them is taken. The choice does not
    depend on how the table is split; the number of rows varies with its square root. A number holds for all labels.
    """
    placed = df.withColumn("__place", F.xxhash64(F.col(key), F.lit(17)))
    wanted = placed if isinstance(rows, int) else placed.filter(F.col(label).isin(list(rows)))
    counts = {r[label]: r["count"] for r in wanted.select(label, "__place").distinct().groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    shares = [(value, min(1.0, (rows if isinstance(rows, int) else rows[value]) / n)) for value, n in counts.items()]
    limits = F.create_map(*(F.lit(x) for value, share in shares for x in (value, int(share * (1 << 30)))))
    chosen = wanted.filter(F.pmod("__place", F.lit(1 << 30)) < limits[F.col(label)])
    rest = [c for c in df.columns if c != label]
    single = chosen.groupBy(label, "__place").agg(*(F.any_value(c).alias(c) for c in rest))
    return single.select(*df.columns)
