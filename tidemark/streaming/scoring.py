"""Record scoring on a stream: validate, quarantine, drop repeats of valid records, score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.monitoring import reference_percentile
from tidemark.operators.records import Rule, quarantine, split_valid, with_errors

RAW = "_raw"
UNTIL_CAUGHT_UP = {"availableNow": True}


@dataclass(frozen=True)
class Scoring:
    """The two running queries: scores of valid records and the quarantine of the others."""

    scores: StreamingQuery
    rejected: StreamingQuery

    def wait(self) -> None:
        self.scores.awaitTermination()
        self.rejected.awaitTermination()

    def late_rows(self) -> int:
        """Valid records that came later than the watermark allows and were not scored."""
        return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in self.scores.recentProgress
                   for s in p["stateOperators"])


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_trigger: int = 100) -> DataFrame:
    """JSON records with a declared schema; a line that cannot be read is kept as text in ``_raw``."""
    whole = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
    return (spark.readStream.schema(whole).option("maxFilesPerTrigger", files_per_trigger)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).json(path))


def checked_records(records: DataFrame, rules: Sequence[Rule], entity: str,
                    event_time: str) -> DataFrame:
    """Records with their errors: unreadable line, no id, no time, and every broken rule."""
    own = [("record: no id", F.col(entity).isNotNull()),
           ("record: no event time", F.col(event_time).isNotNull())]
    if RAW in records.columns:
        own.insert(0, ("record: unreadable line", F.col(RAW).isNull()))
    else:
        records = records.withColumn(RAW, F.lit(None).cast("string"))
    return with_errors(records, [*own, *rules])


def score_stream(records: DataFrame, rules: Sequence[Rule], entity: str, event_time: str,
                 predict: Callable[[DataFrame], DataFrame], quantiles: Sequence[float],
                 model: str, version: str, scores_path: str, rejected_path: str,
                 checkpoint: str, repeat_window: str = "1 hour",
                 trigger: Mapping = UNTIL_CAUGHT_UP) -> Scoring:
    """Start both queries.

    Rules run first, so an invalid record can neither hide a later valid one of the same id nor
    vanish as its repeat; every invalid record is quarantined, with its line where it could not be
    read. Repeats of valid ids are dropped within the watermark, which bounds the kept state. Each
    micro-batch overwrites its own batch folder, so a batch replayed after a failure leaves no
    duplicates.
    """
    checked = checked_records(records, rules, entity, event_time)
    valid, broken = split_valid(checked)
    unique = (valid.drop(RAW).withWatermark(event_time, repeat_window)
              .dropDuplicatesWithinWatermark([entity]))

    def put_scores(batch: DataFrame, batch_id: int) -> None:
        scored = reference_percentile(predict(batch).select(entity, event_time, "score"), "score",
                                      quantiles)
        (scored.withColumn("model_name", F.lit(model)).withColumn("model_version", F.lit(version))
         .write.mode("overwrite").parquet(f"{scores_path}/batch={batch_id}"))

    def put_rejected(batch: DataFrame, batch_id: int) -> None:
        quarantine(batch, entity, RAW).write.mode("overwrite").json(
            f"{rejected_path}/batch={batch_id}")

    def start(stream: DataFrame, put, name: str) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(put)
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start())

    return Scoring(start(unique, put_scores, "scores"), start(broken, put_rejected, "rejected"))
