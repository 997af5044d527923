"""Live event streams: decoding, incremental tables, bursts, graph state, resync.

The order of events inside a repository comes from the source (an offset, or a file and
line) as ``seq``. Results of a micro-batch go to a folder named by the batch id and are
overwritten when the batch is retried, so a restart never counts anything twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.diff import graph_delta
from ..operators.impact import Filters, blast_radius
from ..operators.temporal import (
    adapter_aggregates, changed_file_aggregates, state_at,
)
from ..plans.blocks import running
from ..plans.durable import drop, stored
from ..schemas import DEAD_LETTER_LIMIT, EDGES, NODES
from ..sources.events import decode_events


#: Batches after which a kept table is written whole.
COMPACT_EVERY = 8


class KeyedLog:
    """A table with one row per key, as a full copy and the changes of the batches after it.

    Batch ``n`` writes only rows that it changed, or removed (``gone``); a reader takes the newest of
    each key. Every ``COMPACT_EVERY`` batches the table is written whole, and what the copy before
    that covers is dropped. All places follow from the batch's number, so a retried batch overwrites
    its own. ``first`` is the table before batch 0, empty if not given.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], first: DataFrame | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.first = spark.createDataFrame([], schema) if first is None else first
        self.marked = StructType([*schema.fields, StructField("gone", BooleanType())])

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, name: str) -> bool:
        place, fs = self._place(f"{name}/_SUCCESS")
        return fs.exists(place)

    def last(self) -> int:
        """The newest batch whose changes are completely written, -1 if there is none."""
        place, fs = self._place("")
        if not fs.exists(place):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max((int(n.partition("=")[2]) for n in names if n.startswith("delta=") and self._complete(n)), default=-1)

    def at(self, batch: int, below: int | None = None) -> DataFrame:
        """The table after a batch, from the newest full copy (older than ``below``)."""
        base = (batch + 1) // COMPACT_EVERY * COMPACT_EVERY - 1
        while base >= 0 and (base == below or not self._complete(f"base={base}")):
            base -= COMPACT_EVERY
        names, rest = self.schema.names, [c for c in self.schema.names if c not in self.keys]
        rows = (self.first if base < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/base={base}")).select(*names)
        if batch <= max(base, -1):
            return rows
        moved = reduce(DataFrame.unionByName, [
            self.spark.read.schema(self.marked).parquet(f"{self.path}/delta={n}").withColumn("delta", F.lit(n))
            for n in range(max(base, -1) + 1, batch + 1)])
        newest = moved.groupBy(*self.keys).agg(F.max_by(F.struct("gone", *rest), "delta").alias("now"))
        kept = newest.where("not now.gone").select(*self.keys, *[F.col(f"now.{c}") for c in rest]).select(*names)
        return rows.join(newest.select(*self.keys), self.keys, "left_anti").select(*names).unionByName(kept)

    def write(self, changes: DataFrame, batch: int) -> None:
        """Keep the changes (the schema's columns and ``gone``) of a batch."""
        changes.select(*self.marked.names).write.mode("overwrite").parquet(f"{self.path}/delta={batch}")
        if (batch + 1) % COMPACT_EVERY:
            return
        # from the copy before, never from the one that a retry overwrites
        self.at(batch, below=batch).write.mode("overwrite").parquet(f"{self.path}/base={batch}")
        covered = batch - COMPACT_EVERY
        if covered >= 0:
            drop(self.spark, f"{self.path}/base={covered - COMPACT_EVERY}")
            for n in range(max(covered - COMPACT_EVERY, -1) + 1, covered + 1):
                drop(self.spark, f"{self.path}/delta={n}")


def stream_events(spark: SparkSession, path: str, repo_id: Column, seq: Column) -> DataFrame:
    """Decoded events of NDJSON files arriving under ``path``.

    ``repo_id`` and ``seq`` are expressions over ``value`` and the source's metadata.
    Windows line ends are tolerated, blank lines ignored, bad lines keep their ``problem``.
    """
    raw = spark.readStream.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("value"), repo_id.alias("repo_id"), seq.alias("seq"))
    lines = raw.where(F.trim("value") != "")
    return decode_events(lines.withColumn("line", F.col("value")))


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
          trigger: dict | None = None) -> StreamingQuery:
    """Start a query. Without a trigger it works off what is there and ends; with one, such as
    ``{"processingTime": "1 second"}``, it stays live until its handle is stopped."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start())


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    start(stream, each, checkpoint, mode).awaitTermination()


def _versions(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its id; a retried batch overwrites its own."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    return each


def upserts(rows: DataFrame, keys: list[str], aggregates: list[Column], path: str, checkpoint: str,
            trigger: dict | None = None) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Keep one aggregated row per key up to date: the query's handle, and how to read the table now.

    The streaming aggregate is partial before its shuffle. Each batch stores the rows it
    changed in a ``KeyedLog``.
    """
    updates = rows.groupBy(*keys).agg(*aggregates)
    log = KeyedLog(rows.sparkSession, path, updates.schema, keys)

    def each(batch: DataFrame, batch_id: int) -> None:
        log.write(batch.withColumn("gone", F.lit(False)), batch_id)

    return start(updates, each, checkpoint, "update", trigger), lambda: log.at(log.last())


def upsert_stream(rows: DataFrame, keys: list[str], aggregates: list[Column], path: str,
                  checkpoint: str) -> DataFrame:
    """``upserts`` over what is there now: the table once the backlog is worked off."""
    query, current = upserts(rows, keys, aggregates, path, checkpoint)
    query.awaitTermination()
    return current()


def changed_files_stream(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    return upsert_stream(events.where("type = 'file.changed'"), ["repo_id", "node_id"],
                         changed_file_aggregates(), path, checkpoint)


def adapter_status_stream(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    return upsert_stream(events.where("type = 'adapter.status'"), ["repo_id", "adapter"],
                         adapter_aggregates(), path, checkpoint)


def latest_impact_stream(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    fields = ["generation", "baseline_generation", "seed_nodes", "filters", "impacted_nodes"]
    return upsert_stream(events.where("type = 'impact.updated'"), ["repo_id", "level"],
                         [F.max("seq").alias("seq"), F.max_by(F.struct(*fields), "seq").alias("result")],
                         path, checkpoint)


def _sessions(changes: DataFrame, gap: str) -> DataFrame:
    """Bursts by session windows. A window reaches to just before the gap is over, so that a
    change exactly one gap later opens the next burst."""
    window = F.session_window("ts", f"{gap} -1 microseconds")
    structural = F.max(F.col("change") != "modified")
    files = F.size(F.collect_set(F.when(F.col("change") == "modified", F.col("path"))))
    return (changes.groupBy("repo_id", window.alias("burst"))
            .agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change") == "modified").alias("modified"),
                 structural.alias("structural"), (files + structural.cast("int")).cast("long").alias("generations"))
            .select("repo_id", F.col("burst.start").alias("burst_start"),
                    (F.col("burst.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("burst_end"),
                    "changes", "modified", "structural", "generations"))


def burst_stream(changes: DataFrame, gap: str, path: str, checkpoint: str,
                 delay: str = "0 seconds") -> DataFrame:
    """Bursts of changes separated by at least ``gap`` of silence.

    changes: repo_id, ts TIMESTAMP, path, change. A burst is closed and stored once the
    watermark has passed its end; at the end of the backlog the bursts still open are added
    from the stored changes. Result: repo_id, burst_start, burst_end, changes, modified,
    structural, generations (one per modified file, one for the rest). Changes that came
    after their burst was closed are in ``late_changes``.
    """
    spark = changes.sparkSession
    bursts = _sessions(changes.withWatermark("ts", delay), gap)

    _run(changes, _versions(f"{path}/changes"), f"{checkpoint}/changes", "append")
    _run(bursts, _versions(f"{path}/closed"), f"{checkpoint}/closed", "append")
    seen, closed = _burst_tables(spark, path, changes.schema, bursts.schema)
    upto = closed.groupBy("repo_id").agg(F.max("burst_end").alias("upto"))
    rest = seen.join(upto, "repo_id", "left").where("upto is null or ts >= upto").drop("upto")
    return closed.unionByName(_sessions(rest, gap))


def _burst_tables(spark: SparkSession, path: str, changes, bursts) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(changes).parquet(f"{path}/changes/version=*"),
            spark.read.schema(bursts).parquet(f"{path}/closed/version=*"))


def late_changes(seen: DataFrame, bursts: DataFrame) -> DataFrame:
    """Changes that no burst holds: they arrived behind the watermark.

    seen: repo_id, ts, ...; bursts: repo_id, burst_start, burst_end. The last burst that began
    before a change is carried along in order, however many changes a repository has.
    """
    rest = [c for c in seen.columns if c not in ("repo_id", "ts")]
    marks = bursts.select("repo_id", F.col("burst_start").alias("ts"), F.lit(0).alias("tie"),
                          F.col("burst_end").alias("ends"), F.lit(None).cast(seen.select(F.struct(*rest)).schema[0].dataType).alias("c"))
    rows = seen.select("repo_id", "ts", F.lit(1).alias("tie"), F.lit(None).cast("timestamp").alias("ends"), F.struct(*rest).alias("c"))
    both = marks.unionByName(rows).withColumn("uid", F.monotonically_increasing_id())
    carried = running(stored(both, "marks"), ["repo_id"], ["ts", "tie", "uid"], {"upto": ("last", F.col("ends"))})
    return carried.where("tie = 1 and (upto is null or ts >= upto)").select("repo_id", "ts", "c.*")


def coalesce_bursts(changes: DataFrame, gap_ms: int = 120) -> DataFrame:
    """Bursts of a stored change log, with the generations each one opens.

    changes: repo_id, seq, t_ms, path, change. A burst opens one structural generation if
    anything was created, deleted or renamed, plus one per modified file. A hot repository
    is spread over many blocks (see ``running``).
    """
    gaps = running(changes, ["repo_id"], ["t_ms", "seq"], {"before": ("last", F.col("t_ms"))}, exclusive=True)
    opens = F.col("before").isNull() | (F.col("t_ms") - F.col("before") >= gap_ms)
    numbered = running(gaps.withColumn("opens", opens.cast("long")).drop("before"), ["repo_id"],
                       ["t_ms", "seq"], {"burst": ("sum", F.col("opens"))})
    per_path = numbered.groupBy("repo_id", "burst", "path").agg(
        F.min("t_ms").alias("first"), F.max("t_ms").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("change") == "modified").alias("modified"),
        F.max(F.col("change") != "modified").alias("structural"))
    return per_path.groupBy("repo_id", "burst").agg(
        F.min("first").alias("start_ms"), F.max("last").alias("end_ms"), F.sum("n").alias("changes"),
        F.count(F.lit(1)).alias("paths"),
        (F.count_if("modified") + F.max("structural").cast("long")).alias("generations"))


def generation_violations(events: DataFrame) -> DataFrame:
    """Events whose generation went backwards: their repository needs a resync.

    A snapshot restarts the count, so it is compared with nothing.
    """
    epochs = running(events.select("repo_id", "seq", "type", "generation"), ["repo_id"], ["seq"],
                     {"epoch": ("sum", (F.col("type") == "snapshot").cast("long"))})
    seen = running(epochs, ["repo_id", "epoch"], ["seq"], {"highest": ("max", F.col("generation"))},
                   exclusive=True)
    return seen.where("generation < highest").select("repo_id", "seq", "generation", "highest")


def violations(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
               ) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """``generation_violations`` as events arrive: the query's handle, and how to read what was found.

    The highest generation since a repository's last snapshot is kept by key; a batch reads
    that of its repositories and writes theirs. Events must arrive in order of ``seq``, as they do
    from one file or partition of a repository.
    """
    spark = events.sparkSession
    kept = KeyedLog(spark, f"{path}/highest", StructType.fromDDL("repo_id string, highest long"), ["repo_id"])
    found = StructType.fromDDL("repo_id string, seq long, generation long, highest long")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch.select("repo_id", "seq", "type", "generation"), "batch")
        before = kept.at(batch_id - 1).withColumnRenamed("highest", "carried")
        epochs = running(rows, ["repo_id"], ["seq"], {"epoch": ("sum", (F.col("type") == "snapshot").cast("long"))})
        seen = running(epochs, ["repo_id", "epoch"], ["seq"], {"highest": ("max", F.col("generation"))}, exclusive=True)
        carried = F.when(F.col("epoch") == 0, F.col("carried"))
        judged = stored(seen.join(before, "repo_id", "left").withColumn("highest", F.greatest("highest", carried)), "judged")
        bad = judged.where("generation < highest").select(*found.names)
        bad.write.mode("overwrite").parquet(f"{path}/bad/batch={batch_id}")
        ends = judged.groupBy("repo_id", "epoch").agg(F.max(F.greatest("highest", "generation")).alias("highest"))
        now = ends.groupBy("repo_id").agg(F.max_by("highest", "epoch").alias("highest"))
        kept.write(now.withColumn("gone", F.lit(False)), batch_id)

    return (start(events, each, checkpoint, "append", trigger),
            lambda: spark.read.schema(found).parquet(f"{path}/bad").select(*found.names))


def fold(events: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str,
         on_state: Callable[[DataFrame, DataFrame, DataFrame, int], None] | None = None, trigger: dict | None = None
         ) -> tuple[StreamingQuery, Callable[[], tuple[DataFrame, DataFrame]]]:
    """Graph state kept by a stream of events: the query's handle, and how to read (nodes, edges) now.

    A batch writes as many rows as it changes, however large the graph; the tables are written
    whole every ``COMPACT_EVERY`` batches. ``on_state(batch, nodes, edges, id)`` may derive more from
    each state.
    """
    spark = events.sparkSession
    kept = [KeyedLog(spark, f"{path}/{name}", schema, ["repo_id", "id"], first)
            for name, schema, first in (("nodes", NODES, nodes), ("edges", EDGES, edges))]

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = stored(batch, "batch")
        touched = batch.where(F.col("type").isin("graph.updated", "snapshot")).select("repo_id").distinct()
        was = [log.at(batch_id - 1).join(touched, "repo_id", "left_semi") for log in kept]
        for log, old, new in zip(kept, was, state_at(*was, batch), strict=True):
            names = log.schema.names
            new = stored(new.select(*names), "now")
            change = graph_delta(old.select(*names), new)
            none = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in names if c not in log.keys]
            gone = change.where("change = 'removed'").select(*log.keys, *none, F.lit(True).alias("gone"))
            came = new.join(change.where("change <> 'removed'"), log.keys, "left_semi").withColumn("gone", F.lit(False))
            log.write(came.select(*names, "gone").unionByName(gone), batch_id)
        if on_state is not None:
            on_state(batch, *[log.at(batch_id) for log in kept], batch_id)

    query = start(events, each, checkpoint, "append", trigger)

    def current() -> tuple[DataFrame, DataFrame]:
        newest = kept[1].last()
        return kept[0].at(newest), kept[1].at(newest)

    return query, current


def fold_stream(events: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str,
                on_state: Callable[[DataFrame, DataFrame, DataFrame, int], None] | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """``fold`` over what is there now, snapshots and cascades included.

    A restart without new events returns the last state that was written.
    """
    query, current = fold(events, nodes, edges, path, checkpoint, on_state)
    query.awaitTermination()
    return current()


def impact_on_change(batch: DataFrame, nodes: DataFrame, edges: DataFrame, changed: DataFrame,
                     level: str, filters: Filters = Filters()) -> DataFrame:
    """Impact of the changed files, only for repositories the batch touched.

    batch: events with repo_id and type; changed: repo_id, node.
    """
    touched = (batch.where(F.col("type").isin("file.changed", "graph.updated", "snapshot"))
               .select("repo_id").distinct())
    keep = lambda df: df.join(touched, "repo_id", "left_semi")
    return blast_radius(keep(nodes), keep(edges), keep(changed), level, filters)


def dead_letters(events: DataFrame, limit: int = DEAD_LETTER_LIMIT) -> DataFrame:
    """The newest bad lines per repository, for diagnosis."""
    newest = Window.partitionBy("repo_id").orderBy(F.col("seq").desc())
    return (events.where("problem is not null").select("repo_id", "seq", "line", "problem")
            .withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit).drop("age"))


def write_dead_letters(events: DataFrame, path: str, checkpoint: str) -> None:
    """Side sink of a live stream: every bad line with its reason."""
    bad = events.where("problem is not null").select("repo_id", "seq", "line", "problem")
    _run(bad, _versions(path), checkpoint, "append")
