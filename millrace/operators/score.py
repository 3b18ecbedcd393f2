"""Scores of postings against skill profiles.

A profile is a small list of variants, each with skills and their synonyms; it becomes array literals in the expression, so
no row is multiplied and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vocab as V
from millrace.operators import filters as R


@dataclass(frozen=True)
class Variant:
    name: str
    skills: dict[str, float]


def expanded(skill: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    """The skill and its synonyms, in lower case."""
    low = skill.lower().strip()
    return [low, *[s.lower().strip() for s in (synonyms or {}).get(low, [])]]


def matches(low: Column | X.Searched, skills: list[str], synonyms: dict[str, list[str]] | None = None) -> Column:
    """How many skills occur in the lower-cased text, by themselves or by a synonym."""
    named = [expanded(s, synonyms) for s in skills if s]
    if not named:
        return F.lit(0)
    if isinstance(low, X.Searched):
        return reduce(lambda a, b: a + b, [low.any_of(terms).cast("int") for terms in named])

    def count(t: Column) -> Column:
        hits = [reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in terms]).cast("int") for terms in named]
        return reduce(lambda a, b: a + b, hits)

    return F.transform(F.array(low), count)[0]


def _share(n: Column, skills: list[str]) -> Column:
    return F.bround(F.least(F.lit(100.0), n / F.lit(float(min(len(skills), V.SKILLS_COUNTED))) * 100), 1)


def best_variant(variants: list[Variant], merged: list[str] | None = None, synonyms: dict[str, list[str]] | None = None, low: R.Low = R.lowered) -> Column:
    """struct<score, variant>: the best share of skills, the first variant on ties, raised for wanted titles and sectors; without any
    match the share of the merged skills."""
    fields = {"low": low("description", "title", "company"), "title": low("title"), "sector": low("description", "company")}

    def judge(x) -> Column:
        scored = [F.struct(_share(matches(x["low"], list(v.skills), synonyms), list(v.skills)).alias("score"), F.lit(-k).alias("place"), F.lit(v.name).alias("variant")) for k, v in enumerate(variants) if v.skills]
        none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("variant"))
        fallback = _share(matches(x["low"], merged, synonyms), merged) if merged else F.lit(0.0)
        raised = lambda s, on, by: F.when((s > 0) & on, F.bround(F.least(F.lit(100.0), s * by), 1)).otherwise(s)
        boosted = lambda s: raised(s, X.any_of(x["title"], V.TITLE_BOOST), V.TITLE_FACTOR)
        in_sector = lambda s: raised(s, X.any_of(x["sector"], V.SECTOR_BOOST), V.SECTOR_FACTOR)
        best = F.transform(
            F.array(F.array_max(F.array(*scored)) if scored else none),
            lambda t: F.struct(F.transform(F.array(boosted(t["score"])), in_sector)[0].alias("score"), F.when(t["score"] > 0, t["variant"]).alias("variant")),
        )[0]
        return F.transform(
            F.array(best),
            lambda t: F.struct(F.when(t["score"] > 0, t["score"]).otherwise(fallback).alias("score"), t["variant"].alias("variant")),
        )[0]

    empty = (X.text("description") == "") & (X.text("title") == "")
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("variant"))
    looked_up = all(isinstance(x, X.Searched) for x in fields.values())
    once = judge(fields) if looked_up else F.transform(F.array(F.struct(*[X.col(x).alias(n) for n, x in fields.items()])), judge)[0]
    return F.when(empty, nothing).otherwise(once)


#: The groups of columns that scores look at.
SCORE_FIELDS = [("description", "title", "company"), ("title",), ("description", "company")]


def _all_terms(variants: list[Variant], merged: list[str] | None, synonyms: dict[str, list[str]] | None) -> list[str]:
    return [t for s in [*(s for v in variants for s in v.skills), *(merged or [])] if s for t in expanded(s, synonyms)]


def scored(postings: DataFrame, variants: list[Variant], merged: list[str] | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """``postings`` with base_score and best_cv, see ``best_variant``."""
    out, low = R.lowered_once(postings, *SCORE_FIELDS, more=_all_terms(variants, merged, synonyms))
    out = X.bound(out, __best=best_variant(variants, merged, synonyms, low))
    return out.select(*postings.columns, F.col("__best.score").alias("base_score"), F.col("__best.variant").alias("best_cv"))


def letter_variant(description: Column | str, variants: list[Variant], default: str = "Primary") -> Column:
    """The variant with the most skills in the text, without synonyms; the default if none has any."""
    low = F.lower(X.text(description))
    scored = [F.struct(matches(low, list(v.skills)).alias("n"), F.lit(-k).alias("place"), F.lit(v.name).alias("variant")) for k, v in enumerate(variants) if v.skills]
    top = F.array_max(F.array(*scored)) if scored else F.struct(F.lit(0).alias("n"), F.lit(default).alias("variant"))
    return F.when(top["n"] > 0, top["variant"]).otherwise(default)


def final_score(score: Column, fields: list[str], low: R.Low = R.lowered, scam: Column | None = None) -> Column:
    """The rounded score after the downranks for US locations, on-site work and scam signs; saved sources have none."""
    scam = R.scam_risk(low) if scam is None else scam
    factor = R.us_factor(low) * F.when(R.remote(*fields, low=low), 1.0).otherwise(V.ON_SITE_FACTOR) * F.when(scam, V.SCAM_FACTOR).otherwise(1.0)
    factor = F.when(X.text("source").isin(V.SAVED_SOURCES), 1.0).otherwise(factor)
    return F.rint(score * factor).cast("int")


def judged(
    postings: DataFrame, variants: list[Variant], merged: list[str] | None = None, synonyms: dict[str, list[str]] | None = None,
    min_score: float = 10, remote_only: bool = False,
) -> DataFrame:
    """All postings with base_score, best_cv, reject_reason, relevance_score and scam_risk, which are null for rejected ones."""
    out, fields, low = _judged(postings, variants, merged, synonyms, min_score, remote_only)
    kept = F.col("reject_reason").isNull()
    saved = X.text("source").isin(V.SAVED_SOURCES)
    out = X.bound(out, __scam=F.when(kept, R.scam_risk(low)))
    out = out.withColumn("relevance_score", F.when(kept, final_score(F.col("base_score"), fields, low, F.col("__scam"))))
    return out.withColumn("scam_risk", F.when(kept, ~saved & F.col("__scam"))).select(*postings.columns, "base_score", "best_cv", "reject_reason", "relevance_score", "scam_risk")


def rejected(
    postings: DataFrame, variants: list[Variant], merged: list[str] | None = None, synonyms: dict[str, list[str]] | None = None,
    min_score: float = 10, remote_only: bool = False,
) -> DataFrame:
    """Only the reject_reason of each posting, for counts: nothing else is computed."""
    return _judged(postings, variants, merged, synonyms, min_score, remote_only)[0].select("reject_reason")


def _judged(postings: DataFrame, variants, merged, synonyms, min_score, remote_only) -> tuple[DataFrame, list[str], R.Low]:
    fields = [c for c, t in postings.dtypes if t == "string"]
    out, low = R.lowered_once(postings, *R.RULE_FIELDS, tuple(fields), *SCORE_FIELDS, more=_all_terms(variants, merged, synonyms))
    out = X.bound(out, __best=best_variant(variants, merged, synonyms, low))
    out = out.withColumns({"base_score": F.col("__best.score"), "best_cv": F.col("__best.variant")}).drop("__best")
    return X.bound(out, reject_reason=R.reject_reason(F.col("base_score"), fields, min_score, remote_only, low)), fields, low


def kept(judged_: DataFrame, order: str = "ord") -> DataFrame:
    """The postings kept, best first."""
    return judged_.where("reject_reason is null").drop("reject_reason").orderBy(F.desc("relevance_score"), order)


# --- profiles and searches ---


def merged_skills(variants: list[Variant]) -> list[str]:
    """All skills once, in the order in which they come first."""
    return list(dict.fromkeys(s for v in variants for s in v.skills))


def top_skills(skills: DataFrame, limit: int) -> DataFrame:
    """skill, weight: the first weight of each skill (variant_ord, ord, skill, weight), heaviest first, stable."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("skill").orderBy("variant_ord", "ord"))
    rows = skills.withColumn("__n", first).where("__n = 1").drop("__n")
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    return rows.orderBy(weight.desc(), "variant_ord", "ord").limit(limit).select("skill", weight.alias("weight"))


def search_queries(skills: DataFrame, stop: list[str], limit: int = 20, packs: list[str] | None = None) -> DataFrame:
    """query, n_words, tier: 'remote ' and each of the leading skills, and the packs' queries, longest first."""
    rows = skills.where(~F.lower("skill").isin(stop) & (F.length("skill") > 3)).orderBy("ord").limit(limit)
    query = rows.select(F.concat(F.lit("remote "), F.lower("skill")).alias("query"))
    for q in packs or []:
        query = query.union(rows.sparkSession.range(1).select(F.lit(q).alias("query")))
    n = F.size(X.words(F.col("query")))
    return query.distinct().select(
        "query", n.alias("n_words"), F.when(n >= 3, "specific").otherwise("broad").alias("tier"),
    ).orderBy(F.desc(F.length("query")), "query")


def planned(queries: DataFrame, plan: list[tuple[str, str | None, int | None]] | None = None) -> DataFrame:
    """source, query, place: what each source is asked, in order, of ``queries`` (query, tier): those of its tier, the longest first, as many as its quota."""
    from pyspark.sql.window import Window

    plan = V.SOURCE_QUERIES if plan is None else plan
    sources = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).cast("string").alias("want"), F.lit(n).cast("int").alias("most")) for s, t, n in plan])).alias("x")
    rows = queries.select("query", "tier", sources).select("query", "tier", "x.*").where("want is null or want = tier")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("query")), "query"))
    return rows.withColumn("place", place).where("most is null or place <= most").select("source", "query", "place")
