"""Loads as Structured Streaming jobs that process what is new and stop.

The file source keeps the high-water mark in its checkpoint, so each run picks up only files
it has not seen, and a restarted run continues where the failed one stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.functions.numeric import count_if, n_rows
from rosterlens.operators.ranking import latest_per_key
from rosterlens.plans import changes, storing


def file_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def load_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything new to a parquet folder, exactly once, then stop."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: Sequence[str], width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Rows per tumbling window and group; a window comes out when the watermark has passed its end.

    Rows later than the watermark are not counted; see late_rows. A bounded input is ended by end_of_input.
    """
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("window"), *by).agg(
        F.count(F.lit(1)).alias("n")
    )


def end_of_input(rows: DataFrame, ts: str, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """One row far enough behind the last one that its arrival closes every window before; its own stays open."""
    after = F.max(ts) + F.expr(f"interval {lateness}") + F.expr(f"interval {width}") * 2
    other = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != ts]
    return rows.agg(after.alias(ts)).select(F.col(ts), *other).select(*rows.columns)


def late_rows(rows: DataFrame, ts: str, mark) -> DataFrame:
    """Rows of a delivery that lie before the mark reached by earlier deliveries, for a side table."""
    return rows.where(F.col(ts) < mark)


def counts_with_late_rows(out: str, ts: str, by: Sequence[str], width: str = "1 day", lateness: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: rows per tumbling window and group, rows behind the watermark included.

    The watermark of a batch is the newest time of all earlier batches less `lateness`. Rows behind it go to the side table
    `out`/late as they are, and every batch adds its counts, late ones told apart, to `out`/counts; read_counts adds them up, so a late row is
    merged into its window. Each batch writes folders named after it, so a replay after a failure replaces what it wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if storing.exists(spark, f"{out}/marks"):
            marks = spark.read.schema("mark timestamp, batch bigint").parquet(f"{out}/marks")
            mark = marks.where(F.col("batch") < batch_id).agg(F.max("mark") - F.expr(f"interval {lateness}")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        rows = batch.withColumn("__late", late)
        window = F.window(ts, width)
        counts = rows.where(F.col(ts).isNotNull()).groupBy(window.alias("window"), *by).agg(n_rows().alias("n"), count_if(F.col("__late")).alias("n_late"))
        rows.where("__late").drop("__late").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        counts.select("window.start", "window.end", *by, "n", "n_late").write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        batch.agg(F.max(ts).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    return handle


def read_counts(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """start, end, the groups, n and n_late of all windows, late rows merged in."""
    return spark.read.parquet(f"{out}/counts").groupBy("start", "end", *by).agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def keyed_change_log(stream: DataFrame, key: str, order: Sequence[str], audited: Sequence[str]) -> DataFrame:
    """Change log of a stream with the newest row of every key in Spark's state store.

    One row per key whose newest row of a micro-batch is newer than the stored one, and per audited column that differs: key, changed_column,
    old_value, new_value. An older row that arrives late changes nothing; of equal orders the stored row stays. A batch
    writes state in proportion to the keys it brings. `order` are whole numbers (unix_micros of a time, an id), none of them null; audited values are compared as text.
    A key with very many rows in a batch is read in pieces, of which one row is kept.
    """
    rows = stream.select(F.col(key), *[F.col(c).cast("bigint").alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c).cast("string").alias(f"__a{i}") for i, c in enumerate(audited)])
    orders, values = [f"__o{i}" for i in range(len(order))], [f"__a{i}" for i in range(len(audited))]
    names = list(audited)
    kept = T.StructType([T.StructField(c, T.LongType()) for c in orders] + [T.StructField(c, T.StringType()) for c in values])
    log = T.StructType([rows.schema[key], *[T.StructField(c, T.StringType()) for c in ("changed_column", "old_value", "new_value")]])

    def newest(group: tuple, pieces: Iterator, state) -> Iterator:
        import pandas as pd

        best, stored = None, state.get if state.exists else None
        for piece in pieces:
            top = piece.sort_values(orders, kind="stable").iloc[-1]
            place = tuple(int(top[c]) for c in orders)
            if best is None or place > best[0]:
                best = place, tuple(None if pd.isna(top[c]) else str(top[c]) for c in values)
        if stored is not None and best[0] <= tuple(stored[: len(orders)]):
            return
        state.update((*best[0], *best[1]))
        if stored is not None:
            old = tuple(stored[len(orders) :])
            changed = [(group[0], name, a, b) for name, a, b in zip(names, old, best[1]) if a != b]
            if changed:
                yield pd.DataFrame(changed, columns=log.names)

    return rows.groupBy(key).applyInPandasWithState(newest, log, kept, "append", "NoTimeout")


def apply_changes(root: str, key: str, order: Sequence[str], audited: Sequence[str], log_path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: newest row per key, change log against the stored state, new state version.

    The log is written before the state. A batch replayed after a failure in between rewrites
    its own log folder against the same old state; one replayed after its state was published
    is recognised by the version's tag and skipped. The root belongs to one stream.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if storing.current_tag(spark, root) == str(batch_id):
            return
        newest = latest_per_key(batch, [key], order)
        if storing.current_version(spark, root) == 0:
            storing.publish(newest, root, str(batch_id))
            return
        state = storing.read_current(spark, root).select(*newest.columns)
        # An older row that arrives late changes nothing: the larger order per key wins.
        newest = latest_per_key(newest.unionByName(state.join(newest.select(key), key, "left_semi")), [key], order)
        log = changes.change_log(state, newest, key, audited)
        log.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        merged = changes.upsert(state, newest, key, newest.columns, newest.columns).drop("action")
        storing.publish(merged, root, str(batch_id))

    return handle


def stream_changes(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
