"""The streaming forms of the batch operators. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dates, fields
from ..functions import text as t
from ..operators import posts, reports


def classified_posts(posts: DataFrame) -> DataFrame:
    """Kind, status, first date, age, codes and links of each arriving post; keeps no state."""
    text = t.normal_text(F.col("text"))
    kind, date = fields.message_kind(text), dates.date_range(text, F.col("published"))
    return posts.select("post_id", kind["kind"].alias("kind"), kind["confidence"].alias("confidence"), fields.status(text).alias("status"), date["start"].alias("start_date"), fields.age_limit(text).alias("age_limit"), F.array_join(fields.promo_codes(text), ",").alias("promo_codes"), F.array_join(fields.urls(text), ",").alias("links"))


def once_each(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each message id of a key once, within the watermark."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "id"])


def burst_answers(messages: DataFrame, gap: str = "800 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Messages of one key that keep arriving within the gap as one answer, by id, joined by an empty line."""
    held = messages.withWatermark("ts", delay)
    parts = F.array_sort(F.collect_set(F.struct("id", "text")))
    grouped = held.groupBy("key", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), parts.alias("parts"))
    return grouped.select("key", "start", F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def minute_rollup(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    return reports.event_rollup(events.withWatermark("ts", delay))


def released(messages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Arriving messages joined to a static table of cut-off ids."""
    return reports.released(messages, cutoffs)


class _History(StatefulProcessor):
    """The last n messages of a conversation by turn, as list state that never holds more."""

    def __init__(self, keep: int) -> None:
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turns = handle.getListState("turns", "turn bigint, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plain = lambda v: None if pd.isna(v) else v
        held = list(self._turns.get()) if self._turns.exists() else []
        for pdf in rows:
            held += [(None if pd.isna(turn) else int(turn), plain(role), plain(text)) for turn, role, text in zip(pdf["turn"], pdf["role"], pdf["text"], strict=True)]
            held = sorted(held, key=lambda m: (m[0] is not None, m[0] or 0))[-self._keep :]
        self._turns.put(held)
        out = pd.DataFrame(held, columns=["turn", "role", "text"])
        out.insert(0, "conv_id", key[0])
        yield out.astype({"turn": "Int64"})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bounded_history(messages: DataFrame, keep: int = 40) -> DataFrame:
    """After each batch, the last `keep` messages (conv_id, turn, role, text) of each conversation that got some.

    Older messages leave the state as newer ones come, whatever the order they arrive in; a
    message without a turn counts as the oldest. Needs the RocksDB state store, as keep_history() sets it.
    """
    held = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return held.groupBy("conv_id").transformWithStateInPandas(_History(keep), "conv_id bigint, turn bigint, role string, text string", "Update", "None")


def keep_history(messages: DataFrame, folder: str, keep: int = 40) -> None:
    """Takes in what has arrived since the last call and stores each conversation's last messages.

    State and results are in the folder, which driver and executors share, so that a later call, in another
    session too, goes on where this one ended. A batch that runs again replaces its own rows.
    """
    spark, name = messages.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    spark.conf.set(name, ROCKS)
    try:
        running = bounded_history(messages, keep).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start()
    finally:
        spark.conf.set(name, before)
    running.awaitTermination()


def stored_history(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, role, text: what keep_history() kept last of each conversation."""
    every = spark.read.schema("conv_id bigint, turn bigint, role string, text string, batch bigint").parquet(f"{folder}/rows")
    newest = every.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["conv_id", "batch"], "left_semi").drop("batch")


def keep_drafts(arriving: DataFrame, folder: str, profiles: DataFrame | None = None) -> None:
    """The whole draft of each post that has arrived since the last call, stored in the folder.

    No state: a draft needs its own post only. A batch that runs again replaces its own rows.
    """

    def store(batch_posts: DataFrame, batch: int) -> None:
        posts.drafts(batch_posts, profiles).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    arriving.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()


def stored_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("batch")
