"""Facts and aggregates fed by a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tristrata.functions.keys import surrogate_key
from tristrata.functions.scalars import grain_unit, to_grain
from tristrata.operators.gold import aggregate
from tristrata.plans.specs import GoldSpec, Metric
from tristrata.sources.incremental import DEFAULT_LOOKBACK_DAYS, upsert_incremental


def read_file_stream(
    spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files arriving in ``folder``, each read once."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_fact(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, key: str, date: str, checkpoint: str,
    order_by: tuple[str, ...] = (), key_has_date: bool = False,
) -> StreamingQuery:
    """Keep the dated fact at ``path`` up to date with the stream, each micro-batch upserted by ``key``.

    ``build`` turns a batch of source rows into fact rows. A batch repeated after a failure changes nothing.
    The query stops when all files present have been read; start it again with the same checkpoint to go on.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        upsert_incremental(build(batch), path, key, date, order_by, key_has_date)

    return (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def windowed_gold(
    stream: DataFrame, spec: GoldSpec, measures: Sequence[str] = (), lateness_days: int = DEFAULT_LOOKBACK_DAYS,
    approx: bool = False,
) -> DataFrame:
    """Streaming form of a daily or weekly aggregate whose state is bounded by a watermark.

    Rows later than ``lateness_days`` are dropped, as the lookback of an incremental fact does, and so are rows without
    a date, which no watermark passes; ``grouped_gold`` keeps both."""
    if not approx:
        _no_exact_distinct(spec)
    unit = grain_unit(spec.grain)
    if unit not in ("day", "week"):
        raise ValueError(f"{spec.name}: a stream is aggregated by day or week, not by {unit}")
    if stream.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError("streaming windows count from midnight UTC: set spark.sql.session.timeZone to UTC")
    # Watermarks need zoned timestamps; windows count from a Thursday, weeks start four days later.
    event_time = F.col(spec.date).cast("timestamp")
    window = F.window("__t", "1 day") if unit == "day" else F.window("__t", "7 days", startTime="4 days")
    metrics: list[Column] = [aggregate(m, measures, approx=approx) for m in spec.metrics]
    late = stream.withColumn("__t", event_time).withWatermark("__t", f"{lateness_days} days")
    grouped = late.groupBy(window.alias("__w"), *spec.dimensions).agg(*metrics)
    return grouped.select(F.col("__w.start").cast("date").alias(f"{spec.grain}_date"), *spec.dimensions,
                          *(m.name for m in spec.metrics))


def grouped_gold(
    stream: DataFrame, spec: GoldSpec, measures: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Streaming form of an aggregate of any grain that drops nothing: late rows count, rows without a date form their
    own group, as in ``build_gold``. State has one entry per row of the aggregate, kept on disk by RocksDB.

    Distinct counts are exact unless ``approx``: each value of a group passes once, and a row for it joins the rows that
    are aggregated. That state has an entry per group and value."""
    distinct = [] if approx else [m for m in spec.metrics if m.aggregation == "COUNT_DISTINCT"]
    period = to_grain(spec.date, spec.grain).alias(f"{spec.grain}_date")
    if not distinct:
        return stream.groupBy(period, *spec.dimensions).agg(*(aggregate(m, measures, approx=approx) for m in spec.metrics))
    groups = [period, *(F.col(d) for d in spec.dimensions)]
    numbers = {c: i + 1 for i, c in enumerate(dict.fromkeys(m.column for m in distinct))}
    values = {c: f"__v{i}" for i, c in enumerate(dict.fromkeys(m.column for m in spec.metrics if m.column != "*"))}
    rows = stream.select(*groups, F.lit(0).alias("__kind"), *(F.col(c).alias(v) for c, v in values.items()))
    for column, i in numbers.items():
        seen = stream.filter(F.col(column).isNotNull()).select(*groups, F.col(column).alias("__value")).dropDuplicates()
        rows = rows.unionByName(seen.drop("__value").withColumn("__kind", F.lit(i)), allowMissingColumns=True)
    whole = F.col("__kind") == 0

    def metric(m: Metric) -> Column:
        if m in distinct:
            return F.count_if(F.col("__kind") == numbers[m.column]).alias(m.name)
        if m.aggregation == "COUNT" and (m.column == "*" or m.column in measures):
            return F.count_if(whole).alias(m.name)
        return aggregate(replace(m, column=values[m.column]), approx=approx)

    return rows.groupBy(f"{spec.grain}_date", *spec.dimensions).agg(*map(metric, spec.metrics))


def _no_exact_distinct(spec: GoldSpec) -> None:
    exact = [m.name for m in spec.metrics if m.aggregation == "COUNT_DISTINCT"]
    if exact:
        raise ValueError(f"{spec.name}: behind a watermark distinct values are counted by sketches only; ask for them with approx: {', '.join(exact)}")


def stream_gold(
    stream: DataFrame, spec: GoldSpec, path: str, checkpoint: str, measures: Sequence[str] = (),
    lateness_days: int | None = None, approx: bool = False,
) -> StreamingQuery:
    """Keep the aggregate at ``path`` up to date: groups that changed are upserted after each micro-batch.

    Nothing is dropped, and all grains and rows without a date are kept up to date (``grouped_gold``). With
    ``lateness_days`` a watermark bounds the state instead (``windowed_gold``: days and weeks, dated rows that are not
    later; distinct counts need ``approx`` there, which sketches them). The table also has ``<name>_sk`` over date and dimensions, by which groups are replaced.
    """
    date, key = f"{spec.grain}_date", f"{spec.name}_sk"

    def upsert(batch: DataFrame, _: int) -> None:
        rows = batch.select(surrogate_key([date, *spec.dimensions]).alias(key), "*")
        upsert_incremental(rows, path, key, date, key_has_date=True)

    gold = grouped_gold(stream, spec, measures, approx) if lateness_days is None else windowed_gold(
        stream, spec, measures, lateness_days, approx)
    return (gold.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
