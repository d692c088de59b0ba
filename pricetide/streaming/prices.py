"""Streaming price merges and member state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricetide.operators import chain
from pricetide.params import Methodology
from pricetide.plans.daily import merge_price_partitions
from pricetide.session import cut_lineage

def start_price_merge(
    spark: SparkSession, prices: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Merge arriving price rows into the stored months, then stop.

    Each micro-batch replaces the (product, variant, day) rows it carries; a late day
    lands in its own month. A replayed batch gives the same table, so the merge is
    safe to retry.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        merge_price_partitions(spark, path, batch)

    return (
        prices.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _earlier(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
            raise
        return None


class MemberFlags:
    """Streaming form of `chain.flag_members` over arriving panel rows.

    Days up to `delay_days` before the newest one seen are closed: their rows are judged by the
    batch form's windows, with each member's carried state (last price, missing run) in front.
    Later days wait, so that rows which come late but within the delay are judged in their place.
    Rows of a closed day that arrive again change nothing; rows that come later than the delay
    are kept apart under `late`. Of rows that repeat a member's day one is judged.

    Under `root`, each batch stores flags, carry, waiting rows and late rows in folders of its
    number, which a repeated batch overwrites: it reads only what its predecessor stored.
    """

    def __init__(self, spark: SparkSession, method: Methodology, root: str, delay_days: int = 0) -> None:
        self.spark, self.method, self.root, self.delay_days = spark, method, root.rstrip("/"), delay_days

    def _stored(self, name: str, batch: int) -> DataFrame | None:
        return _earlier(self.spark, f"{self.root}/{name}/batch={batch}")

    def judge(self, batch: DataFrame, number: int, close: bool = False) -> None:
        """Judge one batch; with `close`, all that waits is judged too."""
        member_day = ["index_code", *chain.VARIANT, "value_date"]
        carry, waiting = self._stored("carry", number - 1), self._stored("waiting", number - 1)
        closed = self._stored("closed", number - 1)
        # One row: the last closed day.
        before = closed.first()["day"] if closed is not None else None
        rows = batch if waiting is None else waiting.unionByName(batch)
        rest = [c for c in batch.columns if c not in member_day]
        rows = rows.groupBy(*member_day).agg(F.max(F.struct(*rest)).alias("_r")).select(*member_day, "_r.*").select(*batch.columns)
        rows = cut_lineage(rows)
        newest = rows.agg(F.max("value_date")).first()[0]
        horizon = before
        if newest is not None:
            reached = newest if close else newest - timedelta(days=self.delay_days)
            horizon = reached if before is None else max(before, reached)
        past = F.lit(False) if before is None else F.col("value_date") <= F.lit(before)
        upto = F.lit(False) if horizon is None else F.col("value_date") <= F.lit(horizon)
        due, open_ = rows.filter(~past & upto), rows.filter(~past & ~upto)
        due = cut_lineage(due)
        self._write("flags", number, chain.flag_members(due, self.method, carry))
        self._write("carry", number, chain.member_carry(due, self.method, carry))
        self._write("waiting", number, open_)
        self._write("late", number, rows.filter(past))
        self._write("closed", number, self.spark.createDataFrame([(horizon,)], "day date"))

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")

    def start(self, panel: DataFrame) -> StreamingQuery:
        """Judge everything that the stream holds now, batch by batch, and stop."""
        return (
            panel.writeStream.foreachBatch(self.judge)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )

    def close(self, schema: StructType) -> None:
        """Judge all days that still wait, at the end of the data."""
        last = self.spark.read.parquet(f"{self.root}/closed").agg(F.max("batch")).first()[0]
        self.judge(self.spark.createDataFrame([], schema), last + 1, close=True)

    def flags(self) -> DataFrame:
        """The flags of all closed days."""
        return self.spark.read.parquet(f"{self.root}/flags").drop("batch")


def price_rows(df: DataFrame) -> DataFrame:
    """Cast and order columns as the stored price table expects them."""
    from pricetide.schemas import PRICES

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PRICES.fields
        ]
    )
