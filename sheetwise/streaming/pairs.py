"""Page documents of two sides as a stream: pages meet across sides, pairs are compared batch by batch, and the state of a job follows from its pairs.

A pair that can't be compared becomes an ``error`` and the others go on, whatever the exception was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

BLOCKS = "array<struct<number:bigint,type:int,lines:array<struct<number:int,spans:array<struct<at:int,chars:array<struct<c:string>>,bbox:array<double>>>>>>>"
DOCUMENTS = f"pair_id string, page int, side string, at timestamp, width double, height double, blocks {BLOCKS}"
#: Final states of a pair.
ENDED = ("clean", "defect", "error")


def arriving(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Page documents (DOCUMENTS) from Parquet files as they arrive."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def paired_pages(pages: DataFrame, late: str = "10 minutes", wait: str = "30 minutes") -> DataFrame:
    """(pair_id, page, state, ref, cand): the documents of both sides of a page, that arrive at most ``wait`` apart in event time; ``ref_only`` or ``cand_only`` once the watermark says that the other side won't come. A row that is later than
    the watermark is lost. Stream-stream full outer join on (pair_id, page): state is kept for ``wait`` only."""
    document = F.struct("at", "width", "height", "blocks")

    def side(name: str) -> DataFrame:
        rows = pages.where(F.col("side") == name).select(F.col("pair_id").alias(f"{name}_pair"), F.col("page").alias(f"{name}_page"), F.col("at").alias(f"{name}_at"), document.alias(name))
        return rows.withWatermark(f"{name}_at", late)

    near = F.expr(f"ref_pair = cand_pair AND ref_page = cand_page AND ref_at >= cand_at - INTERVAL {wait} AND ref_at <= cand_at + INTERVAL {wait}")
    both = side("ref").join(side("cand"), near, "full_outer")
    state = F.when(F.col("cand").isNull(), "ref_only").when(F.col("ref").isNull(), "cand_only").otherwise("paired")
    return both.select(F.coalesce("ref_pair", "cand_pair").alias("pair_id"), F.coalesce("ref_page", "cand_page").alias("page"), state.alias("state"), "ref", "cand")


def compared(batch: DataFrame, config=None) -> DataFrame:
    """(pair_id, status, total_defects, defect, quality_score, error) of the pairs of a batch of paired_pages(), by the whole comparison. Pages that came alone aren't compared."""
    from ..operators import jobs
    from ..plans.compare import Inputs, compare
    from ..sources import records

    both = batch.where("state = 'paired'")
    document = lambda side: both.select("pair_id", "page", F.col(f"{side}.width").alias("width"), F.col(f"{side}.height").alias("height"), F.col(f"{side}.blocks").alias("blocks"))
    ref, cand = document("ref"), document("cand")
    sizes = lambda df: df.select("pair_id", "page", "width", "height")
    result = compare(Inputs(records.runs(ref), records.runs(cand), sizes(cand), ref_pages=sizes(ref)), config)
    out = jobs.pair_summary(result.records, both.select("pair_id").distinct(), result.pair_scores, result.errors)
    return out.select("pair_id", "status", "total_defects", "defect", "quality_score", "error")


SUMMARY = "pair_id string, status string, total_defects long, defect long, quality_score long, error string"


def each_pair(batch: DataFrame, compare: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None]) -> None:
    """save(compare(batch)); if that fails, pair by pair, and an ``error`` row for each pair that fails. A batch holds as many pairs as its files do, so their names are few."""
    typed = lambda df: df.select(*(F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in SUMMARY.split(", ")))
    try:
        save(typed(compare(batch)))
        return
    except Exception:  # noqa: BLE001 - any failure of one pair must not take the others with it
        names = [r["pair_id"] for r in batch.select("pair_id").distinct().collect()]
    rows: list[tuple] = []
    for name in sorted(names, key=str):
        try:
            rows += [tuple(r) for r in typed(compare(batch.where(F.col("pair_id").eqNullSafe(name)))).collect()]
        except Exception as failure:  # noqa: BLE001
            rows.append((name, "error", 0, 0, None, str(failure).splitlines()[0][:500]))
    save(batch.sparkSession.createDataFrame(rows, SUMMARY))


def run_compared(paired: DataFrame, out: str, checkpoint: str, compare: Callable[[DataFrame], DataFrame] = compared) -> StreamingQuery:
    """Compare pairs as their pages meet; a row for each pair of each batch under out, by batch number, so that a repeated batch replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # several readers; a lost executor's part is computed again
        try:
            ready = batch.where("state = 'paired'")
            if not ready.isEmpty():
                each_pair(ready, compare, lambda df: df.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        finally:
            batch.unpersist()

    return paired.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATES = "job_id long, pair_id string, pairs int, status string, error string, at timestamp"
_JOB = StructType([StructField("job_id", LongType()), StructField("status", StringType()), StructField("pairs", IntegerType()), StructField("done", IntegerType()), StructField("errors", IntegerType()), StructField("us", LongType()), StructField("gone", BooleanType())])


class JobStates(StatefulProcessor):
    """The state of a job from the states of its pairs: a map from pair to status, and the job's announced number of pairs. A timer deletes an ended job after its time."""

    def __init__(self, ttl_seconds: int):
        self.ttl = 1000 * ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getMapState("pairs", "pair_id string", "status string")
        self.told = handle.getValueState("told", "pairs int, us long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        told = self.told.get()
        n, at, before = (told[0], told[1], told[2]) if told else (None, None, None)
        seen = False
        for r in rows:
            seen = True
            n = r["pairs"] if r["pairs"] is not None else n
            at = max(v for v in (at, r["us"]) if v is not None)
            if r["pair_id"] is None:
                continue
            old = self.pairs.getValue((r["pair_id"],))
            if not (old and old[0] in ENDED):  # a pair ends once
                self.pairs.updateValue((r["pair_id"],), (r["status"],))
        if not seen:
            return
        states = [v[0] for v in self.pairs.values()]
        done, errors = sum(s in ENDED for s in states), states.count("error")
        status = "completed" if n is not None and done >= n else "running" if done or states else "queued"
        self.told.update((n, at, status))
        if status == "completed" and before != "completed":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(at // 1000 + self.ttl, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(job_id=key[0], status=status, pairs=n, done=done, errors=errors, us=at, gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        told = self.told.get()
        states = [v[0] for v in self.pairs.values()]
        self.pairs.clear()
        self.told.clear()
        yield Row(job_id=key[0], status=told[2], pairs=told[0], done=sum(s in ENDED for s in states), errors=states.count("error"), us=told[1], gone=True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, pairs, done, errors, updated_at, gone): a row for each batch in which a job changed, and a last one (gone) when it has been completed for the time that it is kept. events (STATES): a job's number of pairs, or a pair's status. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    keyed = events.where("at is not null").withWatermark("at", late).withColumn("us", F.unix_micros("at")).groupBy("job_id")
    out = keyed.transformWithState(JobStates(ttl_seconds), _JOB, "Append", "EventTime")
    return out.select("job_id", "status", "pairs", "done", "errors", F.timestamp_micros("us").alias("updated_at"), "gone")
