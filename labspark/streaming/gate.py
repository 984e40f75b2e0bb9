"""Counting new samples and refreshing model scores.

The counter resets to zero when it reaches the threshold (a surplus is dropped), so the result
depends on the order of batches, never on rows: batches are counted first, and only their
counts are folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from labspark.catalog import CONFIG_KEY_OF_MODEL, SCORE_BOUNDS, local_table

DEFAULT_THRESHOLD = 50
_STATE = "batch_id long, counter long, fires long, fired boolean, announced boolean"


def fold_counts(counts: Column, threshold: int = DEFAULT_THRESHOLD) -> Column:
    """Fold an array of batch counts to struct(counter, fires)."""
    start = F.struct(F.lit(0).cast("long").alias("counter"), F.lit(0).cast("long").alias("fires"))

    def step(state: Column, n: Column) -> Column:
        total = state["counter"] + n
        full = total >= threshold
        return F.struct(
            F.when(full, F.lit(0)).otherwise(total).cast("long").alias("counter"),
            (state["fires"] + full.cast("long")).cast("long").alias("fires"))

    return F.aggregate(counts, start, step)


def gate_batches(rows: DataFrame, source: str, batch: str,
                 threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Counter and number of firings per source after all its batches, in batch order.

    Rows are reduced to one count per (source, batch) before the fold, so what meets in one
    task is the list of batches of a source, not its rows.
    """
    counts = rows.groupBy(source, batch).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(batch).alias("b"), "n"))), lambda s: s["n"])
    return (
        counts.groupBy(source)
        .agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_rows"),
             fold_counts(ordered, threshold).alias("s"))
        .select(source, "n_batches", "n_rows", F.col("s.counter").alias("counter"),
                F.col("s.fires").alias("fires"))
    )


class SampleGate:
    """The gate over a stream: state is one row in one of two small folders, used in turn.

    A batch is recorded before its firing is announced, and the announcement is recorded after it,
    so a replayed batch counts once, and a firing that a crash cut off is announced again
    (``on_fire`` is called at least once for every firing).
    """

    def __init__(self, spark: SparkSession, state_path: str,
                 on_fire: Callable[[int], None], threshold: int = DEFAULT_THRESHOLD):
        self.spark, self.state_path = spark, state_path
        self.on_fire, self.threshold = on_fire, threshold

    def state(self) -> DataFrame:
        """The rows of the last two batches."""
        return self.spark.read.schema(_STATE).parquet(f"{self.state_path}/slot=*")

    def _last(self):
        try:
            return self.state().orderBy(F.desc("batch_id")).first()
        except AnalysisException as error:  # no state written yet
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _record(self, row: tuple) -> None:
        # the older of the two rows is replaced; the newer one stays if this write is cut off
        local_table(self.spark, [row], _STATE).coalesce(1).write.mode("overwrite").parquet(
            f"{self.state_path}/slot={row[0] % 2}")

    def _announce(self, row: tuple) -> None:
        self.on_fire(row[0])
        self._record((*row[:4], True))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Handler for ``foreachBatch``."""
        last = self._last()
        if last is not None and last["fired"] and not last["announced"]:
            self._announce(tuple(last))
        if last is not None and batch_id <= last["batch_id"]:
            return
        total = (last["counter"] if last else 0) + batch.count()
        fired = total >= self.threshold
        row = (batch_id, 0 if fired else total, (last["fires"] if last else 0) + int(fired), fired, False)
        self._record(row)
        if fired:
            self._announce(row)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )


class _SourceCounter(StatefulProcessor):
    """The gate of one source: its counter and firings, and the batch that may still grow."""

    def __init__(self, batch_type: str, threshold: int):
        self.batch_type, self.threshold = batch_type, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "gate", f"counter long, fires long, n_batches long, n_rows long, batch {self.batch_type}, held long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for part in rows:
            for batch, n in part.groupby("batch", dropna=False)["n"].sum().items():
                counts[batch] = counts.get(batch, 0) + int(n)
        counter, fires, n_batches, n_rows, open_batch, held = self.state.get() or (0, 0, 0, 0, None, 0)
        for batch in sorted(counts):
            if n_batches and batch > open_batch:  # the open batch is complete
                counter, fires = self._folded(counter, fires, held)
                held = 0
            if not n_batches or batch > open_batch:
                open_batch, n_batches = batch, n_batches + 1
            held, n_rows = held + counts[batch], n_rows + counts[batch]
        self.state.update((counter, fires, n_batches, n_rows, open_batch, held))
        counter, fires = self._folded(counter, fires, held)
        yield pd.DataFrame({"source": [key[0]], "n_batches": [n_batches], "n_rows": [n_rows],
                            "counter": [counter], "fires": [fires]})

    def _folded(self, counter: int, fires: int, n: int) -> tuple[int, int]:
        total = counter + n
        return (0, fires + 1) if total >= self.threshold else (total, fires)

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame, source: str, batch: str, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """The gate of every source over a stream, as keyed state: a row per source that has new samples.

    ``batch`` names the batch that a sample belongs to (a day, a number); batches of a source arrive in order, and rows
    of its last one may still come in later micro-batches. Rows of an older batch count with the open one. The state of a
    source is six values in the state store, so a restarted query goes on where it stopped. The session needs the RocksDB
    state store (:data:`STATE_STORE`). Null sources are a source of their own; rows without a batch are left out.
    """
    kind, key = stream.schema[batch].dataType.simpleString(), stream.schema[source].dataType.simpleString()
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sums = pa.Table.from_batches([part]).group_by(["source", "batch"]).aggregate([([], "count_all")])
            yield from sums.rename_columns(["source", "batch", "n"]).to_batches()

    # counted before the shuffle, so a source's task sees a row per batch and input chunk, not one per sample
    rows = stream.select(F.col(source).alias("source"), F.col(batch).alias("batch")).where("batch is not null").mapInArrow(
        counted, f"source {key}, batch {kind}, n long")
    return rows.groupBy("source").transformWithStateInPandas(
        _SourceCounter(kind, threshold), f"source {key}, n_batches long, n_rows long, counter long, fires long",
        "Update", "None")


#: The setting that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_gate(stream: DataFrame, source: str, batch: str, folder: str,
             threshold: int = DEFAULT_THRESHOLD) -> StreamingQuery:
    """Process what has arrived, from where the last run stopped; :func:`gate_states` reads the result.

    ``folder`` holds the stream's checkpoint and one small table per micro-batch, replaced if the batch is replayed.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/states/number={number}")

    return (gate_stream(stream, source, batch, threshold).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())


def gate_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every source: source, n_batches, n_rows, counter, fires."""
    rows = spark.read.parquet(f"{folder}/states")
    last = F.max_by(F.struct("n_batches", "n_rows", "counter", "fires"), "number")
    return rows.groupBy("source").agg(last.alias("s")).select("source", "s.*")


def refreshed_scores(predictions: DataFrame, model: str = "model_id", label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Accuracy x 100 of every model within the score bounds."""
    low, high = SCORE_BOUNDS
    accuracy = F.avg((F.col(label) == F.col(prediction)).cast("double")) * 100
    return predictions.groupBy(model).agg(
        F.least(F.lit(high), F.greatest(F.lit(low), accuracy)).alias("score"))


def upsert_config(config: DataFrame, updates: DataFrame, updated_at: str) -> DataFrame:
    """Configuration with new values by key: changed, added and untouched rows."""
    time = F.lit(updated_at).cast("timestamp")
    old_time = (F.col("o.updated_at") if "updated_at" in config.columns
                else F.lit(None).cast("timestamp"))
    return config.alias("o").join(
        updates.select("key", F.col("value").alias("new_value")).alias("n"), "key", "full"
    ).select(
        "key", F.coalesce("n.new_value", "o.value").alias("value"),
        F.col("o.description").alias("description"),
        F.when(F.col("n.new_value").isNotNull(), time).otherwise(old_time).alias("updated_at"))


def refresh_config(config: DataFrame, predictions: DataFrame, updated_at: str,
                   key_of_model: dict[str, str] | None = None) -> DataFrame:
    """Write every model's refreshed score into the configuration and zero the counter."""
    keys = key_of_model or CONFIG_KEY_OF_MODEL
    key = F.lit(None).cast("string")
    for model, name in keys.items():
        key = F.when(F.col("model_id") == model, name).otherwise(key)
    scores = refreshed_scores(predictions).select(key.alias("key"), F.col("score").alias("value"))
    zero = local_table(
        config.sparkSession, [("new_samples_since_last_ct", 0.0)],
        "key string, value double")
    return upsert_config(
        config, scores.filter(F.col("key").isNotNull()).unionByName(zero), updated_at)
