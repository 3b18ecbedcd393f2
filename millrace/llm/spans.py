"""Spans of patterns in texts, with DataFrame functions only.

The matches of a pattern and the gaps between them are taken from the text together; a match starts after all the gaps
and matches before it, which a window sums up within the row. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _match(kind: str, context: int):
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), F.length(x["g"]).alias("gap"), x["m"].alias("match"),
        F.right(x["g"], F.lit(context)).alias("left"), F.left(x["h"], F.lit(context)).alias("right"),
    )


def located(rows: DataFrame, patterns: list[tuple[str, Column, str]], context: int = 40) -> DataFrame:
    """rid, doc_id, kind, start, end, match, left, right: a row for each match of ``rows`` (doc_id, text), and a row with
    null kind for each text that has none.

    patterns: (kind, a cheap condition on the column ``text`` without which there can't be a match, regular expression).
    rid numbers the input rows, so repeated doc_ids stay apart. left and right are up to ``context`` characters around.
    """
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    for k, (_, guard, pattern) in enumerate(patterns):
        rows = rows.withColumn(f"m{k}", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        rows = rows.withColumn(f"g{k}", F.when(F.size(f"m{k}") > 0, F.split("text", pattern, -1)).otherwise(none))
    found = []
    for k, (kind, _, _) in enumerate(patterns):
        zipped = F.arrays_zip(F.col(f"m{k}").alias("m"), F.col(f"g{k}").alias("g"), F.slice(f"g{k}", 2, F.greatest(F.size(f"m{k}"), F.lit(1))).alias("h"))
        found.append(F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), _match(kind, context)))
    rows = rows.select("rid", "doc_id", F.explode_outer(F.concat(*found)).alias("x")).select("rid", "doc_id", "x.*")
    upto = Window.partitionBy("rid", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    return rows.select("rid", "doc_id", "kind", (end - F.length("match")).alias("start"), end.alias("end"), "match", "left", "right")


def free_of_base(found: DataFrame) -> DataFrame:
    """``found`` (rid, start, end, base) without the rows that aren't base and overlap one that is."""
    before = Window.partitionBy("rid").orderBy("start", F.desc("base"), "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, since a frame that runs to the end is made anew for every row.
    after = Window.partitionBy("rid").orderBy(F.desc("start"), "base", F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before), F.lit(0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    found = found.withColumn("reach", reach).withColumn("ahead", ahead)
    clear = (F.col("reach") <= F.col("start")) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    return found.where(F.col("kind").isNull() | F.col("base") | clear).drop("reach", "ahead")


def free_of_wider(found: DataFrame, open_to: Column, overlaps: bool = False) -> DataFrame:
    """``found`` without the rows of ``open_to`` that lie within another row of ``open_to`` which starts before, or at the same place and is longer or else of the earlier kind by
    ``rank``; with overlaps: that overlap such a row, whether or not that one stays itself."""
    before = Window.partitionBy("rid").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(open_to, F.col("end"))).over(before), F.lit(0))
    found = found.withColumn("reach", reach).withColumn("open", open_to)
    clear = F.col("reach") <= F.col("start") if overlaps else F.col("reach") < F.col("end")
    return found.where(~F.coalesce("open", F.lit(False)) | clear).drop("reach", "open")


def joined(kept: Column, order: list[str], kinds: list[str]) -> Column:
    """kind:start:end of the spans that are ``kept``, comma-joined, in the order of ``order``, of which rank is the kind's place."""
    names = F.array(*[F.lit(k) for k in kinds])
    spans = F.array_sort(F.collect_list(F.when(kept, F.struct(*order, "end", F.col("rank").alias("kind_rank"), F.col("start").alias("at")))))
    text = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind_rank"] + 1), x["at"], x["end"]))
    return F.array_join(text, ",")


def ranked(kinds: list[str], kind: Column) -> Column:
    """The place of ``kind`` in ``kinds``."""
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind).cast("int") - 1


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` (19 at most) pass the Luhn test."""
    back = F.reverse(text)
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0
