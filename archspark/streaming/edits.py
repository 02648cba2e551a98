"""Annotations under additions, new texts, deletions and clearings, kept up to date from a stream of these events.

What holds is what it is after all events in the order of ``seq``, in whatever order they come: of the additions for a
target the newest is held, of the new texts and of the deletions of an id the newest each, and the last clearing. An annotation
holds where neither a deletion of its id nor a clearing follows it, with the newest text that follows it. An addition or a new
text that is blank is no event, nor is a new text or a deletion without an id. Events of one seq count as additions first, then
new texts, deletions and clearings. A batch reads what the logs hold for the targets and ids that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.views import ANNOTATION, target_key
from .changes import Log, changes

#: ``action`` is add (or null), update (id and text), delete (id) or clear.
EVENT = ANNOTATION + ", action string, seq long"
_COLUMNS = tuple(c.split()[0] for c in ANNOTATION.split(", "))


def additions_log(path: str) -> Log:
    return Log(f"{path}/additions", ("target", *_COLUMNS, "seq", "live"), ("sign",), f"target string, {ANNOTATION}, seq long, live boolean, sign long")


def edits_log(path: str) -> Log:
    return Log(f"{path}/edits", ("id", "action", "text", "seq", "live"), ("sign",), "id string, action string, text string, seq long, live boolean, sign long")


def keep(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the query on a stream of EVENT rows; path: a folder that only this checkpoint writes to."""

    def add(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("text", T.stripped(F.col("text"))).withColumn("action", F.coalesce("action", F.lit("add"))).withColumn("deleted", F.lit(False))
        new = rows.where("action = 'add' and text <> ''").withColumn("targetId", F.coalesce("targetId", "componentId")).withColumn("target", target_key())
        clear = F.col("action") == "clear"
        edits = rows.where("action = 'clear' or id is not null and (action = 'delete' or action = 'update' and text <> '')")
        edits = edits.withColumn("id", F.when(clear, F.lit("")).otherwise(F.col("id"))).withColumn("text", F.when(F.col("action") == "update", F.col("text")))
        for log, part, keys in ((additions_log(path), new, ["targetType", "target"]), (edits_log(path), edits, ["id", "action"])):
            log.write(changes(part, log, keys, n), n)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str, n: int) -> DataFrame:
    """ANNOTATION rows that hold after batch n, the last or the one before it."""
    edits = edits_log(path).read(spark, n)
    cleared = edits.where("action = 'clear'").agg(F.max("seq").alias("cleared"))  # one row
    of = lambda action, value: F.max(F.when(F.col("action") == action, value))
    per = edits.where("action <> 'clear'").groupBy(F.col("id").alias("__id")).agg(of("delete", F.col("seq")).alias("gone"), of("update", F.struct("seq", F.col("text").alias("said"))).alias("new"))
    rows = additions_log(path).read(spark, n).join(per, F.col("id") == F.col("__id"), "left").join(F.broadcast(cleared))
    rows = rows.where("coalesce(gone < seq, true) and coalesce(cleared < seq, true)")
    return rows.withColumn("text", F.when(F.col("new.seq") >= F.col("seq"), F.col("new.said")).otherwise(F.col("text"))).select(*_COLUMNS)
