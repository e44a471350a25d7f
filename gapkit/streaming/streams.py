"""The same updates as Structured Streaming queries over landed files.

Each micro-batch writes its new rows to a folder of its own, ``<target>/run=<run>/batch=<id>``, in overwrite mode. A
batch repeated after a failure replaces its own output, so results stay exact.

A *run* is what one checkpoint has stored, however often it is started; by default it is named by the checkpoint's path. A name
that another checkpoint has used is refused, as batch numbers of the two would clash. Several runs may feed one target one
after the other; each takes what all others stored as known.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gapkit.session import STREAM_CONF
from gapkit.sources.tables import path_exists
from gapkit.streaming.incremental import new_rows_merged, past_mark


def read_landed(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Files landing in a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def stored(
    spark: SparkSession, target: str, schema, before: int | None = None, other_than: str | None = None
) -> DataFrame:
    """What was stored; with ``other_than``, by all other runs and, with ``before``, by that run's batches before one."""
    if not path_exists(spark, target):
        return spark.createDataFrame([], schema)
    # an explicit schema, as a folder may hold nothing but empty batches
    fields = f"{_ddl(schema)}, run string, batch bigint"
    table = spark.read.schema(fields).option("basePath", target).parquet(target)
    own = F.lit(False) if before is None else F.col("batch") < before
    if other_than is not None:
        table = table.where((F.col("run") != other_than) | own)
    elif before is not None:
        table = table.where(own)
    return table.drop("run", "batch")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


_STARTS = "checkpoint string, first_batch bigint, finished boolean"


class LandedRun:
    """A started run. ``awaitTermination`` waits for it and notes that it came to its end; all else is the query's."""

    def __init__(self, query: StreamingQuery, note: Callable[[], None]):
        self.query, self._note = query, note

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802 - as Spark names it
        done = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        if self.query.exception() is None and (timeout is None or done):
            self._note()
        return done

    def __getattr__(self, name: str):
        return getattr(self.query, name)


class _Log:
    """Where the starts of a run are noted: files beside its rows, each written once. Spark does not read them as rows."""

    def __init__(self, spark: SparkSession, target: str, run: str, checkpoint: str):
        self.spark, self.checkpoint, self.path = spark, checkpoint, f"{target}/_starts/{run}"
        notes = []
        if path_exists(spark, self.path):
            notes = spark.read.schema(_STARTS).json(self.path).collect()  # one row or two a start
        if any(n["checkpoint"] != checkpoint for n in notes):
            raise ValueError(f"run {run!r} of {target} was written with another checkpoint")
        ended = {n["first_batch"] for n in notes if n["finished"]}
        # a start that did not come to its end goes on
        self.first = max((n["first_batch"] for n in notes if n["first_batch"] not in ended), default=None)

    def begin(self, batch_id: int) -> int:
        """The first batch of this start."""
        if self.first is None:
            self.first = batch_id
            self._write(False)
        return self.first

    def end(self) -> None:
        if self.first is not None:
            self._write(True)

    def _write(self, finished: bool) -> None:
        row = [(self.checkpoint, self.first, finished)]
        self.spark.createDataFrame(row, _STARTS).coalesce(1).write.mode("append").json(self.path)


def run_name(checkpoint: str) -> str:
    """The name of a checkpoint's run."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


_STARTING = threading.Lock()


@contextmanager
def _settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session while a query starts; the query keeps a copy of them."""
    with _STARTING:
        said = spark.conf.getAll
        try:
            for key, value in conf.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key in conf:
                if key in said:
                    spark.conf.set(key, said[key])
                else:
                    spark.conf.unset(key)


def _run(
    stream: DataFrame, target: str, checkpoint: str, run: str | None, select: Callable[[DataFrame, int, int, str], DataFrame],
    conf: Mapping[str, str] | None = None,
) -> LandedRun:
    run = run_name(checkpoint) if run is None else run
    log = _Log(stream.sparkSession, target, run, checkpoint.rstrip("/"))

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = select(batch, batch_id, log.begin(batch_id), run)
        rows.write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _settings(stream.sparkSession, conf or {}):
        query = writer.start()
    return LandedRun(query, log.end)


def stream_append(
    stream: DataFrame, target: str, checkpoint: str, as_of, base: DataFrame | None = None,
    date_col: str = "occ_date", run: str | None = None,
) -> LandedRun:
    """Append rows past the high-water mark of an optional base table and of all that was stored before this start.

    The mark is the same for all batches of a start, so it does not matter how its files fall into batches or in which order
    they come: the start stores what one batch update with all its files would. One that failed keeps its mark when it is started
    again with its checkpoint; one that came to its end, as ``awaitTermination`` notes, is followed by a start with a new mark.
    """

    def select(batch: DataFrame, batch_id: int, first: int, run: str) -> DataFrame:
        known = stored(batch.sparkSession, target, stream.schema, before=first, other_than=run)
        known = known if base is None else known.unionByName(base, allowMissingColumns=True)
        return past_mark(known, batch, as_of, date_col)

    return _run(stream, target, checkpoint, run, select)


def stream_upsert(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    base: DataFrame | None = None, run: str | None = None,
) -> LandedRun:
    """Store rows with keys not seen before, by any run; rows stored first win. Each batch reads the stored keys; see
    ``stream_upsert_state`` for a form that reads them once."""

    def select(batch: DataFrame, batch_id: int, first: int, run: str) -> DataFrame:
        known = stored(batch.sparkSession, target, stream.schema, before=batch_id, other_than=run)
        known = known if base is None else known.unionByName(base, allowMissingColumns=True)
        return new_rows_merged(known, batch, keys, order)

    return _run(stream, target, checkpoint, run, select)


_AGE = "__age"
# Spark refuses any sort of a stream, as if it were one of the whole stream; here each batch is sorted in its partitions.
_SORTED = {"spark.sql.streaming.unsupportedOperationCheck": "false"}
_PARTITIONS = "spark.sql.shuffle.partitions"


def _state_partitions(spark: SparkSession, checkpoint: str) -> int | None:
    """The number of partitions that a checkpoint was begun with and keeps its state in."""
    if not path_exists(spark, f"{checkpoint}/offsets"):
        return None
    said = F.regexp_extract("value", rf'"{_PARTITIONS}":"(\d+)"', 1)
    return spark.read.text(f"{checkpoint}/offsets").agg(F.max(said.try_cast("int"))).first()[0]


def _one_zero(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fractions among the keys with one zero and one NaN, as groups have them; a state tells keys apart by their bytes."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        k: F.when(F.isnan(k), float("nan")).when(F.col(k) == 0, 0.0).otherwise(F.col(k)).cast(kinds[k])
        for k in keys if kinds[k] in ("float", "double")})


def stream_upsert_state(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (),
    base: DataFrame | None = None, run: str | None = None,
) -> LandedRun:
    """As ``stream_upsert``, with the keys in Spark's state store: a batch costs its own rows, not the stored table.

    The state holds the keys and nothing else, on disk, in a bounded memory. The rows of a batch are dealt out by key and sorted by
    age (stored rows before landed ones), by ``order`` and by the other columns; the first row of each key that the state lacks
    goes on. ``base`` is a stream over a stored table, read whole by the first batch. What other runs of the target store is
    streamed in the same way, so runs with checkpoints of their own do not store a key twice.

    The state lives in the checkpoint, so it survives lost executors and restarts. It is set up as ``gapkit.session.STREAM_CONF``
    says (RocksDB), as far as the session does not say otherwise. A checkpoint of the earlier form, an aggregate, is refused by Spark;
    go on with a new one.
    """
    spark, keys = stream.sparkSession, list(keys)
    own = run_name(checkpoint) if run is None else run
    if not path_exists(spark, target):  # a folder that can be streamed
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{target}/run=none/batch=-1")
    others = spark.readStream.schema(f"{_ddl(stream.schema)}, run string, batch bigint").option("basePath", target).parquet(target)
    sources = [(others.where(F.col("run") != own).drop("run", "batch"), 0), (stream, 1)]
    if base is not None:
        sources.append((base, 0))
    first = [*order, *[c for c in stream.columns if c not in keys and c not in order]]
    aged = [df.select(*stream.columns, F.lit(age).alias(_AGE)) for df, age in sources]
    rows = aged[0]
    for more in aged[1:]:
        rows = rows.unionByName(more)
    # dealt out as the state is, so that the sort holds for it
    new = _one_zero(rows, keys).repartition(*keys).sortWithinPartitions(*keys, _AGE, *first).dropDuplicates(keys)

    def select(batch: DataFrame, batch_id: int, first_batch: int, run: str) -> DataFrame:
        return batch.where(F.col(_AGE) == 1).select(*stream.columns)

    said, partitions = spark.conf.getAll, _state_partitions(spark, checkpoint)
    conf = {key: value for key, value in STREAM_CONF.items() if key not in said} | _SORTED
    if partitions is not None:
        conf[_PARTITIONS] = str(partitions)
    return _run(new, target, checkpoint, own, select, conf)
