"""Deduplication in which the first row of the order wins, and elimination of what earlier runs have seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions.rounds import materialise, settle
from millrace.operators import pairs

#: Rows of a token of a block that one cell of the join holds of either side.
CELL_ROWS = 2000
#: Similarity up to which all pairs of a block may be compared, and pairs that are compared in the time in which two rows of a token meet.
LOW, CHEAP = 0.5, 64


def first_wins(df: DataFrame, keys: list[Column], order: str | Column = "ord", exempt: Column | None = None) -> DataFrame:
    """The first row of each key. Rows that are ``exempt`` all stay.

    An aggregation keeps the first order value per key in the tasks before the shuffle, so a key that many rows share isn't a hot
    task; order values must be unique.
    """
    order = X.col(order)
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    least = df.where(~exempt) if exempt is not None else df
    least = least.select(*named, order.alias("__first")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__first").alias("__first")).select("__first")
    out = df.withColumn("__ord", order).join(least, F.col("__ord") == F.col("__first"), "left_semi")
    if exempt is not None:
        out = out.unionByName(df.withColumn("__ord", order).where(exempt))
    return out.drop("__ord")


def unseen(batch: DataFrame, seen: DataFrame, link: str = "link") -> DataFrame:
    """Postings whose canonical link isn't among ``seen`` (link); those without a link stay."""
    keyed = batch.withColumn("__link", X.canonical_url(link))
    old = seen.select(F.col("link").alias("__link")).where("__link <> ''").distinct()
    return keyed.join(old, "__link", "left_anti").drop("__link")


def exact(df: DataFrame, title: str = "title", company: str = "company", order: str = "ord") -> DataFrame:
    return first_wins(df, [X.dedup_key(title, company)], order)


def boards(df: DataFrame, title: str = "title", company: str = "company", order: str = "ord") -> DataFrame:
    """By lower-cased title and company; rows that lack either go."""
    full = df.where((X.text(title) != "") & (X.text(company) != ""))
    return first_wins(full, [F.lower(title), F.lower(company)], order)


def by_name(df: DataFrame, title: str = "title", company: str = "company", order: str = "ord") -> DataFrame:
    """By title and company as they are written; null counts as empty."""
    return first_wins(df, [X.text(title), X.text(company)], order)


def by_link(df: DataFrame, link: str = "link", order: str = "ord") -> DataFrame:
    """By link; rows without one all stay."""
    return first_wins(df, [F.col(link)], order, exempt=X.text(link) == "")


def by_link_or_name(df: DataFrame, order: str = "ord") -> DataFrame:
    """By link, or by title and company where there is none."""
    name = F.concat(X.text("title"), F.lit("|"), X.text("company"))
    return first_wins(df, [F.coalesce(F.nullif(X.text("link"), F.lit("")), name)], order)


def newest(store: DataFrame, key: str = "dedup_key", id_col: str = "id") -> DataFrame:
    """The row with the largest id of each key."""
    return first_wins(store, [F.col(key)], -F.col(id_col))


def unprocessed(mails: DataFrame, processed: DataFrame) -> DataFrame:
    """One row for each message id that isn't processed yet."""
    return mails.dropDuplicates(["message_id"]).join(processed.select("message_id").distinct(), "message_id", "left_anti")


def near_titles(
    df: DataFrame, threshold: float = 0.85, title: str = "title", company: str = "company", order: str = "ord",
    block: Column | None = None,
) -> DataFrame:
    """``df`` without rows whose title is as similar as ``threshold`` to that of an earlier row that is kept, of the same company.

    Equal titles, the usual hot case, collapse first. The similar pairs of the others come from a join on their rarest tokens, and rounds over these
    links decide in order: a row stays once all earlier ones like it are dropped, and goes once one of them stays.
    """
    block = X.normal_company(company) if block is None else block
    rows = df.select(F.col(order).alias("ord"), block.cast("string").alias("block"), F.array_sort(X.token_set(title)).alias("tokens"))
    rows = rows.withColumn("block", F.concat(F.when(F.col("block").isNull(), "0").otherwise("1"), X.text("block")))  # rows without one are a block
    blank = rows.where(F.size("tokens") == 0).select("ord")
    distinct = materialise(rows.where(F.size("tokens") > 0).groupBy("block", "tokens").agg(F.min("ord").alias("ord")), "titles")
    gone = settle(_similar(distinct, threshold)).withColumnRenamed("b", "ord")
    keep = distinct.select("ord").join(gone, "ord", "left_anti").union(blank).withColumnRenamed("ord", "__kept")
    keep = materialise(keep, "kept")  # its size is known then: few enough ids are broadcast, and the rows stay where they are
    return df.join(keep, F.col(order) == F.col("__kept"), "left_semi")


def title_classes(df: DataFrame, title: str = "title", block: str = "company", order: str = "ord") -> DataFrame:
    """ord, block, tokens, representative (the first row of the block with the same title words): a row for each title with words."""
    rows = df.select(
        F.col(order).alias("ord"), F.col(block).alias("block"), F.array_sort(X.token_set(title)).alias("tokens"),
    ).where(F.size("tokens") > 0)
    first = rows.groupBy("block", "tokens").agg(F.min("ord").alias("representative"))
    return rows.join(first, ["block", "tokens"]).select("ord", "block", "tokens", "representative")


def similar_pairs(df: DataFrame, least: float, title: str = "title", block: str = "company", order: str = "ord") -> DataFrame:
    """a, b, similarity: pairs of a block's classes of equal titles, by their representatives, with at least the similarity.

    Copies aren't multiplied into pairs: ``title_classes`` has the members. Pairs meet on a shared token (the rarest ones of each
    title suffice), so a block's pairs aren't all compared; for a low similarity that most tokens let meet, comparing all of them is cheaper (``pairs``).
    """
    rows = df.select(
        F.col(order).alias("ord"), F.col(block).alias("block"), F.array_sort(X.token_set(title)).alias("tokens"),
    ).where(F.size("tokens") > 0)
    rows = materialise(rows.groupBy("block", "tokens").agg(F.min("ord").alias("ord")), "titles")
    return pairs.compared(rows, least) if least <= LOW and _dense(rows) else _similar(rows, least)


def _dense(rows: DataFrame) -> bool:
    """Whether the pairs of all blocks take less time than those that share a token, each as often as it does."""
    met = lambda groups: groups.count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    return met(rows.groupBy("block")) <= CHEAP * met(rows.select("block", F.explode("tokens").alias("token")).groupBy("block", "token"))


def _similar(rows: DataFrame, least: float) -> DataFrame:
    """a, b, similarity: pairs of ``rows`` (block, tokens, ord) of a block with at least the similarity, each once.

    Two sets with similarity s share one of the first n - ceil(s n) + 1 tokens of any common order; a pair meets at the first one only. The rows
    of a token that more than ``CELL_ROWS`` of a block have are dealt to rows and columns of cells, so a cell holds about ``CELL_ROWS`` rows of either side however many there are.
    """
    counts = rows.select("block", F.explode("tokens").alias("token")).groupBy("block", "token").count()
    ranked = rows.select("block", "ord", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(counts, ["block", "token"])
    lead = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("count", "token"))), lambda x: x["token"]), F.lit(1), F.any_value("n") - F.ceil(F.any_value("n") * F.lit(least) - 1e-9).cast("int") + 1)
    led = rows.join(ranked.groupBy("ord").agg(lead.alias("lead")), "ord").withColumn("token", F.explode("lead"))
    cells = led.groupBy("block", "token").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells"), F.count("*").alias("of")).where("of > 1")
    led = led.join(cells.drop("of"), ["block", "token"])
    own = F.pmod(F.xxhash64("ord"), F.col("cells")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    a = led.select("block", "token", F.col("ord").alias("a"), F.col("tokens").alias("ta"), F.col("lead").alias("la"), own.alias("row"), each.alias("column"))
    b = led.select("block", "token", F.col("ord").alias("b"), F.col("tokens").alias("tb"), F.col("lead").alias("lb"), own.alias("column"), each.alias("row"))
    sizes = F.least(F.size("ta"), F.size("tb")) >= F.greatest(F.size("ta"), F.size("tb")) * F.lit(least) - 1e-9
    once = F.get(F.array_intersect("la", "lb"), F.lit(0)) == F.col("token")
    met = a.join(b, ["block", "token", "row", "column"]).where(F.col("a") < F.col("b")).where(sizes & once)
    return met.select("a", "b", X.set_similarity(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least)
