"""A watched folder: each content is analysed once, and outputs are idempotent by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.sources import mbox, outlook, parse

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Endings that are taken; names without a dot are too.
ENDINGS = ("eml", "msg", "mbox", "mbx", "txt")


def watched(spark: SparkSession, folder: str, all_files: bool = False, per_batch: int = 1000) -> DataFrame:
    """A stream of new files (path, content, sha256), each content once for as long as the checkpoint lives.

    Hidden files are skipped; unless ``all_files``, so are other endings. Writers should rename files
    into the folder when these are whole.
    """
    return new_contents(spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder), all_files)


def new_contents(files: DataFrame, all_files: bool = False) -> DataFrame:
    """(path, content, sha256) of a stream of ``files(path, content)``: each content once, without what :func:`watched` skips."""
    name = F.substring_index("path", "/", -1)
    kept = files.filter(~name.startswith("."))
    if not all_files:
        kept = kept.filter(~F.contains(name, F.lit(".")) | F.lower(F.substring_index(name, ".", -1)).isin(*ENDINGS))
    return kept.select("path", "content", F.sha2("content", 256).alias("sha256")).dropDuplicates(["sha256"])


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True, interval: str = "5 seconds"):
    """Start the stream into ``sink(batch, batch_id)``; with ``once``, what is there is taken and the query ends.

    A batch is retried with its number after a crash: a sink that writes to a place named by the
    number replaces what a broken try left.
    """
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def evidence_of(batch: DataFrame) -> DataFrame:
    """Evidence of a batch of files of any kind: internet messages, Outlook files and mailboxes message by message; what can't be read has a row that says so."""
    spark, none = batch.sparkSession, F.lit(None).cast("string")
    absent = {"container": none, "container_sha256": none, "modified_by": none, "unread": none}
    files = parse.sniffed(batch)
    eml = files.filter("msg_format = 'eml'").select("path", "content", "msg_format").withColumns(absent)
    msg = outlook.converted(files.filter("msg_format = 'msg'")).withColumns(absent | {"modified_by": F.col("modified_by"), "unread": F.col("error")})
    boxes = [r.path for r in files.filter("msg_format = 'mbox'").select("path").collect()]
    out = eml.unionByName(msg.select(*eml.columns))
    return out.unionByName(mbox.messages(spark, boxes).withColumns({"modified_by": none, "unread": none}).select(*eml.columns)) if boxes else out


def to_folder(analyse: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch's analysis as JSON lines to a folder of its own; a batch that fails leaves its files and the error beside it, and the next goes on."""

    def sink(batch: DataFrame, number: int) -> None:
        try:
            analyse(batch).write.mode("overwrite").json(f"{folder}/batch={number}")
        except Exception as e:
            failed = batch.select("path", F.lit(f"{type(e).__name__}: {e}"[:2000]).alias("error"))
            failed.write.mode("overwrite").json(f"{folder}-errors/batch={number}")

    return sink


def campaign_windows(indicators: DataFrame, at: str, delay: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(start, type, value, reports): how many reports had an indicator in a window, late ones up to ``delay`` included.

    Exact: a report's repetitions are dropped before it is counted, so that streams hold one row for each.
    """
    in_window = indicators.withWatermark(at, delay).select(F.window(F.col(at), width).alias("window"), "type", "value", "report_id")
    once = in_window.dropDuplicates(["window", "type", "value", "report_id"])
    return once.groupBy("window", "type", "value").agg(F.count("*").alias("reports")).select(F.col("window.start").alias("start"), "type", "value", "reports")


def campaign_sessions(indicators: DataFrame, at: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(type, value, start, end, seen): runs of an indicator's appearances with no pause as long as ``gap``; ``end`` is the last one's time."""
    kept = indicators.withWatermark(at, delay).withColumn("_at", F.col(at))
    runs = kept.groupBy("type", "value", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("seen"), F.min("_at").alias("start"), F.max("_at").alias("end"))
    return runs.select("type", "value", "start", "end", "seen")
