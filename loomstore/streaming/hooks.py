"""Hook events as streams: archive, file touches, telemetry windows, cadence and the extraction queue.

Each payload row is (session_id, event_id, ts, payload JSON). Transformations are the same on batches and
streams; ``foreachBatch`` sinks write versions of the store, with checkpointed offsets for retries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstore.functions.text import is_tool_command, session_of_payload, tail_bytes, tool_file_path, tool_output

ARCHIVE_BYTES, QUEUE_BYTES, NOTE_BYTES = 32 * 1024, 8192, 200
PAYLOAD = "event_id long, ts timestamp, payload string"


def parsed(events: DataFrame) -> DataFrame:
    """(event_id, ts, session_id, tool, output, file_path, command) of payloads."""
    p = F.col("payload")
    return events.select("event_id", "ts", session_of_payload(p).alias("session_id"), F.get_json_object(p, "$.tool_name").alias("tool"), tool_output(p).alias("output"), tool_file_path(p).alias("file_path"), F.get_json_object(p, "$.tool_input.command").alias("command"))


def foreign(rows: DataFrame, own_tool: str) -> DataFrame:
    """Without calls of the engine's own command."""
    return rows.filter(F.col("command").isNull() | ~is_tool_command(F.col("command"), own_tool))


def archive(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(event_id, session_id, ts, content): each event once; an event id that comes again within the watermark is dropped."""
    marked = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])
    return marked.filter("output is not null").select("event_id", "session_id", "ts", tail_bytes(F.col("output"), ARCHIVE_BYTES).alias("content"))


def touches(rows: DataFrame) -> DataFrame:
    return rows.filter("file_path is not null").select("session_id", "file_path", "ts", F.col("tool").alias("tool_name"), F.col("event_id").alias("seq"))


def telemetry(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, event, n, errors, avg_ms) by event time. Needs ts, event, duration_ms, exit_code."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors"), F.avg("duration_ms").alias("avg_ms"))


def every_nth(rows: DataFrame, n: int) -> DataFrame:
    """Every nth event of a session over the whole stream, counted in state: (session_id, event_id, output)."""

    def pick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("event_id")
            at = count + 1 + pd.Series(range(len(pdf)), index=pdf.index)
            count += len(pdf)
            yield pdf.loc[at % n == 0, ["session_id", "event_id", "output"]]
        state.update((count,))

    return rows.select("session_id", "event_id", "output").groupBy("session_id").applyInPandasWithState(pick, "session_id string, event_id long, output string", "count long", "append", GroupStateTimeout.NoTimeout)


def queue_rows(rows: DataFrame, project: str) -> DataFrame:
    """Pending extractions: the tail of each output, trimmed."""
    text = tail_bytes(F.trim("output"), QUEUE_BYTES)
    return rows.filter(F.coalesce(F.trim("output"), F.lit("")) != "").select(F.col("event_id").cast("string").alias("id"), F.lit(project).alias("project"), text.alias("raw_output"))


def drain(queue: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(facts of the oldest rows, the rows left): the caller drops the rows only after the facts are written."""
    from loomstore.operators.extract import extract_facts

    oldest = queue.orderBy("captured_at", "id").limit(limit)
    facts = extract_facts(oldest.select("id", F.col("raw_output").alias("summary")))
    return facts, queue.join(oldest.select("id"), "id", "left_anti")


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """Runs what has arrived through ``sink`` by micro-batches and stops; offsets make a failed batch run again."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()
