"""The audit log: commands without their secrets, appended and read as JSON lines, and counts of decisions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

# Words that name a credential on a command line.
SECRET_WORDS = "password passwd secret token key apikey api-key auth credential bearer pass pwd".split()
HIDDEN = "[hidden]"
LONGEST_WORD = 40
LOG_SCHEMA = "time timestamp, event string, caller string, reason string, command array<string>, refs array<string>, detail string, exit_code int"
NAMED = "(" + "|".join(SECRET_WORDS) + ")"


def is_secret_flag(a: Column) -> Column:
    """A flag whose name, before any equals sign, holds a word that names a credential."""
    return a.rlike(r"(?is)\A-+[^-].*") & F.regexp_extract(F.lower(a), r"(?s)\A-+(=?[^=]*)", 1).rlike(NAMED)


def without_secret_words(a: Column) -> Column:
    """An argument whose long words, and those after a word or header that names a credential, are hidden."""
    words = F.regexp_extract_all(a, F.lit(r"[ \t]+|[^ \t]+"), F.lit(0))

    def arms(w: Column) -> Column:
        low = F.lower(F.regexp_replace(w, r"\A[:,;\"']+|[:,;\"']+\z", ""))
        return low.isin(SECRET_WORDS) | (F.endswith(w, F.lit(":")) & low.rlike(NAMED))

    first = F.array_position(F.transform(words, arms), True)
    hide = lambda w, i: ((first > 0) & (i + 1 > first)) | (F.octet_length(w) > LONGEST_WORD)
    return F.array_join(F.transform(words, lambda w, i: F.when(w.rlike(r"\A[ \t]") | arms(w) | ~hide(w, i), w).otherwise(HIDDEN)), "")


def redact_command(argv: Column) -> Column:
    """A command line that is safe to log: what follows a credential flag is hidden, joined by `=` or as the next argument."""

    def step(state: Column, a: Column) -> Column:
        flag = is_secret_flag(a)
        out = F.when(state["hide"], F.lit(HIDDEN)).when(flag, a).otherwise(without_secret_words(a))
        joined = ~state["hide"] & flag & F.contains(a, F.lit("="))
        shown = F.when(joined, F.concat(F.substring_index(a, "=", 1), F.lit("=" + HIDDEN))).otherwise(out)
        return F.struct(F.concat(state["out"], F.array(shown)).alias("out"), (~state["hide"] & flag & ~joined).alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(argv, start, step, lambda s: s["out"])


def _safe(events: DataFrame) -> DataFrame:
    return events.withColumns({"command": redact_command(F.col("command")), "time": F.coalesce("time", F.current_timestamp())})


def append_log(events: DataFrame, path: str) -> None:
    """Append events to the log as JSON lines; their commands are redacted and a missing time is now."""
    _safe(events).write.mode("append").json(path)


def write_batch(events: DataFrame, path: str, stream: str, number: int) -> None:
    """Write batch `number` of a stream to the log; the same batch once more replaces it, so its events count once."""
    name = hashlib.sha256(stream.encode()).hexdigest()[:16]
    _safe(events).write.mode("overwrite").json(f"{path.rstrip('/')}/stream-{name}/batch-{number}")


def log_stream(events: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Append a stream of events (event_id, time, ...) to the log; an event that comes again within `delay` is written once.

    A batch has a folder of its own, named by its number and the stream's checkpoint, so that one that is run again after a
    failure writes over what it wrote before."""
    once = events.withWatermark("time", delay).dropDuplicatesWithinWatermark(["event_id"])
    write = lambda batch, number: write_batch(batch.drop("event_id"), path, checkpoint, number)
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log without damaged lines."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def histogram(decisions: DataFrame) -> DataFrame:
    """Rows of each class and rule, and of each class as a whole (a null rule)."""
    return decisions.rollup("class", "rule").agg(F.count("*").alias("n")).where("class is not null")
