"""The registered queries of the corpus operators: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, decontaminate, langid, lattice, mixing, ordinal, phrases, pii, resample, secrets, simhash, substrings, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.summarise(pii.find(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", _digest("base").alias("base_sha256"), "spans")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.summarise(secrets.find(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", _digest("base").alias("base_sha256"), "spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _digest("kept").alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ordinal.grades_of(_table(spark, sf_dir, "labels"))
    return ordinal.grade(_table(spark, sf_dir, "documents"), labels).drop("tails")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_language_id": op2_language_id,
    "op3_source_mixing": op3_source_mixing,
    "op4_pii": op4_pii,
    "op8_secret_scan": op8_secret_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_grades": op7_quality_grades,
    "op9_decontamination": op9_decontamination,
    "op10_lattice_scores": op10_lattice_scores,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""
        with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        g as (select r, doc_id, i, w[i : i + 12] g from (select r, doc_id, w, unnest(range(1, len(w) - 11)) i from d where doc_id is not null and len(w) >= 13)),
        f as (select *, min(doc_id) over (partition by g) least from g),
        gone as (select r, list_distinct(flatten(list(range(i, i + 13)))) p from f where least < doc_id group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(p), 0) as bigint) as n_removed,
            sha256(coalesce(array_to_string(case when p is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(p, k)), lambda k: w[k]) end, ' '), '')) as kept_sha256
        from d left join gone using (r)""",
    "op9_decontamination": rf"""
        with n as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        v as (select distinct item, least(10, len(w)) k, w[i : i + least(10, len(w)) - 1] g from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
        p as (select r, k, i, w[i : i + k - 1] g from (select r, k, w, unnest(range(1, len(w) - k + 2)) i from n, (select distinct k from v) where len(w) >= k)),
        m as (select r, p.k, i, item from p join v using (k, g)),
        h as (select r, count(distinct q) n_hit from (select r, unnest(range(i, i + k)) q from (select distinct r, k, i from m)) group by r),
        t as (select r, list_sort(list(distinct item)) items from m group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
            sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from n left join h using (r) left join t using (r)""",
    "op13_collocations": rf"""
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) p from documents),
        w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
        n as (select lang, cast(sum(len(w)) as bigint) n from w group by lang),
        g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest(range(1, 6)) k) where len(w) >= k)),
        f as (select lang, k, phrase, count(*) a from g group by all having count(*) >= 100),
        c as (select lang, k, phrase, a, string_split(phrase, ' ') s from f where k > 1),
        j as (select *, array_to_string(s[: cut], ' ') x, array_to_string(s[cut + 1 :], ' ') y from (select *, unnest(range(1, k)) cut from c)),
        e as (select j.lang, j.phrase, j.k, j.a, cut, u.a l, v.a r, n, cast(1000::hugeint * j.a * n // (u.a::hugeint * v.a) as bigint) score
            from j join f u on u.lang = j.lang and u.phrase = x join f v on v.lang = j.lang and v.phrase = y join n on n.lang = j.lang),
        b as (select * from e qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        o as (select distinct lang, array_to_string(s[i : i + z - 1], ' ') phrase, a from (select *, unnest(range(1, k - z + 2)) i from (select *, unnest(range(2, k)) z from c where k > 2))),
        m as (select lang, phrase, max(a) most from o group by all),
        d as (select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as "rank" from b left join m using (lang, phrase) where most is null or 100 * most < 100 * b.a)
        select lang, "rank", phrase, a, l, r, n, score from d where "rank" <= 2000""",
}
