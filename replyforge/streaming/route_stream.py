"""Message routing over a stream.

Routing is stateless, so the stream runs the batch transformation on each
micro-batch and writes the same rows as the batch job would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from replyforge.operators.model import IntentModel, load_model, score as score_texts
from replyforge.operators.routing import respond, split_blank


def message_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None):
    """Parquet files of a folder as a stream, or the tables in it that ``glob`` names:
    files, or folders of files."""
    # As a pattern, since a stream takes a plain path for a folder and refuses a file.
    path = f"{folder}/{{{glob}}}" if glob else folder
    return spark.readStream.schema(schema).parquet(path)


def route_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    routed_path: str,
    rejects_path: str,
    checkpoint: str,
    text: str = "customer_text",
    keep=(),
    every: str | None = None,
) -> StreamingQuery:
    """Route everything that is available, blanks to ``rejects_path``.

    ``score`` adds ``model_intent`` and ``confidence``.  Each micro-batch
    writes to its own sub-folder, so a batch that is retried after a failure
    replaces its output instead of adding to it.  With ``every`` (such as
    "30 seconds") the query goes on with what arrives later, in that rhythm.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # two outputs, one evaluation of the source
        try:
            usable, blank = split_blank(held, text)
            routed = respond(score(usable), text, keep)
            routed.write.mode("overwrite").parquet(f"{routed_path}/batch={batch_id}")
            blank.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        finally:
            held.unpersist()

    rhythm = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**rhythm)
        .start()
    )


def route_stream_model(
    stream: DataFrame,
    model: IntentModel | str,
    routed_path: str,
    rejects_path: str,
    checkpoint: str,
    text: str = "customer_text",
    keep=(),
    digits: int | None = None,
    every: str | None = None,
    refresh: bool = False,
) -> StreamingQuery:
    """``route_stream`` with a trained model: each micro-batch is joined to its terms.

    ``model`` is a model or the folder it was saved to.  A folder is loaded once,
    so all batches of a run use one version; with ``refresh`` every batch takes
    the latest finished one.  Scoring writes nothing, and equal texts of a batch
    are scored once.
    """
    spark, folder = stream.sparkSession, model
    if isinstance(folder, str):
        model = load_model(folder, spark)

    def score(batch: DataFrame) -> DataFrame:
        now = load_model(folder, spark) if refresh and isinstance(folder, str) else model
        return score_texts(batch, now, text, digits)

    return route_stream(stream, score, routed_path, rejects_path, checkpoint, text, keep, every)
