"""A ledger of links that earlier runs have seen, in buckets by link, with a sketch of each bucket that a batch passes first.

The ledger is a folder of two append-only tables, both partitioned by bucket: ``links`` (link, at) and ``sketch`` (place, bits), a Bloom filter of
``BITS`` bits a bucket, kept as the words of 32 bits that aren't zero. Of a batch only hashes meet the sketches, and only those of the buckets that it falls into are read. A link of which any bit is
missing is new for certain. The others, seen ones and a few by chance, are looked up exactly, in the links of their buckets alone. So a run over mostly new links reads sketches, not the ledger; a sketch that is
too small only costs look-ups.

A run appends its links and their bits, so readers never see a half-written bucket; ``compact`` folds what is there into a new folder, with more bits if asked.

Defined cases: blank and null links are never seen and never kept; repeated links of a batch all stay (removing them is another rule's work); a ledger that doesn't exist is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.rounds import materialise

#: Bits of a bucket's sketch, and bits of a link.
BITS, HASHES = 1 << 20, 4
LINKS, SKETCH = "link string, at timestamp, bucket int", "place int, bits long, bucket int"


def _rows(spark: SparkSession, folder: str, kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{folder}/{kind}")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, bits: int = BITS) -> None:
        self.spark, self.folder, self.buckets, self.bits = spark, folder.rstrip("/"), buckets, bits

    def _bucketed(self, df: DataFrame, link: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), link), F.lit(self.buckets)).cast("int"))

    def _bits_of(self, df: DataFrame, link: str) -> DataFrame:
        """A row for each bit of each link: place (of its word) and bit."""
        bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), link), F.lit(self.bits)) for k in range(HASHES)])).alias("__bit")
        return df.select("*", bit).withColumns({"place": F.floor(F.col("__bit") / 32).cast("int"), "bit": (F.col("__bit") % 32).cast("int")}).drop("__bit")

    def append(self, links: DataFrame) -> None:
        """Keeps ``links`` (link, at). The links come before their bits, so that a run that breaks off in between loses nothing: what has no bits yet counts as new again."""
        rows = materialise(self._bucketed(links.where(X.text("link") != "").groupBy("link").agg(F.max("at").alias("at")), "link"), "seen")
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/links")
        self._sketch(rows)

    def _sketch(self, links: DataFrame) -> None:
        one = F.pow(F.lit(2.0), F.col("bit").cast("double")).cast("long")
        words = self._bits_of(self._bucketed(links.select("link"), "link"), "link").groupBy("bucket", "place").agg(F.bit_or(one).alias("bits"))
        words.select("place", "bits", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/sketch")

    def _touched(self, keyed: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())  # buckets are a fixed number

    def maybe_seen(self, keyed: DataFrame) -> DataFrame:
        """link, bucket of ``keyed`` that the sketches can't tell to be new, each once."""
        own = keyed.select("link", "bucket").distinct()
        sketch = _rows(self.spark, self.folder, "sketch", SKETCH, self._touched(keyed)).groupBy("bucket", "place").agg(F.bit_or("bits").alias("bits"))
        met = self._bits_of(own, "link").join(sketch, ["bucket", "place"]).where(F.expr("(shiftright(bits, bit) & 1) = 1"))
        return met.groupBy("link", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == HASHES).drop("n")

    def unseen(self, batch: DataFrame, link: str = "link") -> DataFrame:
        """The rows of ``batch`` whose canonical link the ledger doesn't hold; those without a link stay."""
        rows = batch.withColumn("__link", X.canonical_url(link))
        keyed = materialise(self._bucketed(rows.where("__link <> ''").select(F.col("__link").alias("link")).distinct(), "link"), "keyed")
        maybe = materialise(self.maybe_seen(keyed), "maybe")
        stored = _rows(self.spark, self.folder, "links", LINKS, self._touched(maybe)).select("bucket", "link").distinct()
        seen = materialise(maybe.join(stored, ["bucket", "link"], "left_semi").select(F.col("link").alias("__link")), "old")
        return rows.join(seen, "__link", "left_anti").select(*batch.columns)

    def links(self) -> DataFrame:
        """link, first_seen, last_seen."""
        return _rows(self.spark, self.folder, "links", LINKS).groupBy("link").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))

    def compact(self, folder: str, bits: int | None = None, since=None) -> Ledger:
        """The same links, once each, in a new folder; without those last seen before ``since``."""
        out = Ledger(self.spark, folder, self.buckets, bits or self.bits)
        kept = self.links()
        kept = kept if since is None else kept.where(F.col("last_seen") >= since)
        both = kept.select("link", F.explode(F.array("first_seen", "last_seen")).alias("at")).distinct()
        rows = self._bucketed(both, "link")
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{out.folder}/links")
        out._sketch(kept)
        return out
