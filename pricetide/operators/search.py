"""Contains search over members through stored trigram postings, verified on candidates."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.membership import active_on
from pricetide.schemas import struct
from pricetide.sinks.versions import VersionedTable

#: What a search looks at; rows that agree in all of it are one entry of the index.
FIELDS = ["name", "set_name", "variant_key", "cm_product_id"]
#: Fixed value: bits of one bitmap.
BITS = 32_768

ENTRIES = struct("name string, set_name string, variant_key string, cm_product_id bigint, bucket bigint, bit bigint")
POSTINGS = struct("gram string, bucket bigint, entries binary, part bigint")


def _texts() -> Column:
    """The lower-case texts that a search looks at."""
    return F.transform(F.array(*(F.col(c).cast("string") for c in FIELDS)), F.lower)


def _grams(text: Column) -> Column:
    """All trigrams of a text, none of a null or shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))).otherwise(
        F.array().cast("array<string>")
    )


@dataclass(frozen=True)
class MemberIndex:
    """Stored entries, by bucket of their slot, and postings: a bitmap of slots per trigram and bucket.

    An entry's slot is a hash, so entries that share one only make each other candidates.
    `buckets` and `parts` must be the same for building and searching.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    parts: int = 16

    @property
    def entries(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/entries", ENTRIES, ["bucket"], ["cm_product_id", "variant_key"])

    @property
    def postings(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/postings", POSTINGS, ["part"], ["gram", "bucket"])

    def build(self, intervals: DataFrame) -> None:
        """Index the members of `intervals`; unchanged parts keep their files.

        Entries are written before the postings that lead to them: postings of an older build
        find fewer of the new entries until the second switch, never wrong ones.
        """
        slot = F.pmod(F.xxhash64(*FIELDS), F.lit(self.buckets * BITS)) + 1
        placed = intervals.select(*FIELDS).distinct().withColumn("_slot", slot)
        placed = placed.withColumn("bucket", F.bitmap_bucket_number("_slot")).withColumn("bit", F.bitmap_bit_position("_slot"))
        self.entries.replace(placed)
        held = self.entries.read()
        grams = held.select("bucket", "bit", F.explode(F.array_distinct(F.flatten(F.transform(_texts(), _grams)))).alias("gram"))
        listed = grams.groupBy("gram", "bucket").agg(F.bitmap_construct_agg("bit").alias("entries"))
        self.postings.replace(listed.withColumn("part", F.pmod(F.crc32("gram"), F.lit(self.parts))))

    def candidates(self, text: str) -> DataFrame:
        """Entries that hold all trigrams of `text`; only the postings' parts of those are read.

        A text of fewer than three characters has no trigram: all entries are candidates.
        """
        entries = self.entries.read()
        grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        if not grams:
            return entries
        parts = {str(zlib.crc32(g.encode()) % self.parts) for g in grams}
        lists = self.postings.read(keep=lambda values: values["part"] in parts).where(F.col("gram").isin(grams))
        # A row a bucket at most.
        met = lists.groupBy("bucket").agg(F.count(F.lit(1)).alias("_met"), F.bitmap_and_agg("entries").alias("_both"))
        met = met.where((F.col("_met") == len(grams)) & (F.bitmap_count("_both") > 0)).drop("_met")
        byte = F.conv(F.hex(F.substring("_both", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        among = F.expr("shiftright(_byte, int(bit % 8))").bitwiseAND(1) == 1
        return entries.join(met, "bucket").withColumn("_byte", byte).where(among).select(*entries.columns)

    def search(self, intervals: DataFrame, day: Column, text: str = "", include_inactive: bool = False) -> DataFrame:
        """The rows of `membership.search`, found through the index, which must hold their members."""
        rows = intervals.filter(F.col("member_since") <= day) if include_inactive else intervals.filter(active_on(day))
        query = text.strip().lower()
        if not query:
            return rows
        verified = F.exists(_texts(), lambda f: F.contains(f, F.lit(query)))
        found = self.candidates(query).where(verified).select(*[F.col(c).alias(f"_{c}") for c in FIELDS])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIELDS]
        return rows.join(found, same, "left_semi")
