"""Secrets, with linking of credentials that come in parts; DataFrame functions only.

Base patterns give spans on their own. Four weak patterns propose parts: identifiers (user names, client ids), weak secrets
(short pass words, auth values), opaque tokens, and endpoints. A weak part alone means nothing, so each opens a scope of
``scope`` characters around its span, whatever the span's length, and the scopes of a text are joined with the parts that end or begin in them: for every part
and kind, the nearest end at or before its start and the nearest start at or after its end tell what is in reach. A part is never its own complement: what overlaps it doesn't count, and
a weak part within a longer one (a token within its own address or assignment) is part of that. An identifier or a weak secret is reported only with its
complement (identifier and secret), an opaque token only with an identifier or an endpoint, an endpoint only with both an identifier and a
secret. Base access keys count as identifiers, base assignments and hex values as secrets.

How it scales: the texts are read once, and only matches are shuffled, by text. The interval join makes no pairs: every match becomes two events, its start and its end,
and the frames only run on, once forwards and once backwards over a text's events.

Defined cases: null and empty texts have no spans; repeated rows each give a row; weak parts that overlap a base span are part of
it; of weak parts with equal spans the first kind as listed counts; equal starts go by kind as listed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import spans as S
from millrace.llm.common import pick

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "identifier", "weak_secret", "opaque", "endpoint"]

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
IDENTIFIER = r"""(?i)(?<![a-z0-9])(?:user(?:_?name)?|login|client_?id|account_?id|access_?id|key_?id|tenant)["']?\x20{0,3}[:=]\x20{0,3}["']?[a-z0-9@._-]{3,}+"""
WEAK_SECRET = r"""(?i)(?<![a-z0-9])(?:pass|pwd|pw|passphrase|auth|credentials?|signature|private_?key)["']?\x20{0,3}[:=]\x20{0,3}["']?[^\s"',;]{4,}+"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?<![A-Za-z0-9+.-])(?:[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>]{3,}+|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9]))"""


def _patterns(text: Column) -> list[tuple[str, Column, str]]:
    like = lambda p: F.regexp_like(text, F.lit(p))
    return [
        ("assign", like("(?i)(?:passw|secret|token|api_?key)"), ASSIGN),
        ("access", F.contains(text, F.lit("AKIA")), ACCESS),
        ("hex", like("[0-9a-f]{24}"), HEX),
        ("identifier", like(r"""(?i)(?:user|name|login|id|tenant)["']?\x20{0,3}[:=]"""), IDENTIFIER),
        ("weak_secret", like(r"""(?i)(?:pass|pwd|pw|passphrase|auth|credentials?|signature|key)["']?\x20{0,3}[:=]"""), WEAK_SECRET),
        ("opaque", like("[A-Za-z0-9+/_-]{32}"), OPAQUE),
        ("endpoint", F.contains(text, F.lit("://")) | like(r"[A-Za-z0-9]:[0-9]{2}"), ENDPOINT),
    ]


def _valid() -> Column:
    kind, match = F.col("kind"), F.col("match")
    return (
        F.when(kind == "assign", F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6)
        .when(kind == "access", F.length(match) >= 20)
        .otherwise(True)
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 160) -> DataFrame:
    """rid, doc_id, kind, start, end, match, base: base spans and linked weak parts; a row with null kind for each text
    without matches."""
    found = S.located(pick(docs, doc_id=id_col, text=text_col), _patterns(F.col("text")), context=0).drop("left", "right")
    found = found.withColumn("kind", F.when(_valid(), F.col("kind")))
    found = S.free_of_base(found.withColumn("base", F.coalesce(F.col("kind").isin(BASE), F.lit(False))))
    found = S.free_of_wider(found.withColumn("rank", S.ranked(KINDS, F.col("kind"))), F.col("kind").isNotNull() & ~F.col("base")).drop("rank")
    kind, ends, so_far = F.col("kind"), F.col("event") == "end", (Window.unboundedPreceding, Window.currentRow)
    events = F.explode(F.array(F.struct(F.lit("start").alias("event"), F.col("start").alias("at")), F.struct(F.lit("end").alias("event"), F.col("end").alias("at"))))
    behind = Window.partitionBy("rid").orderBy("at").rangeBetween(*so_far)
    ahead = Window.partitionBy("rid").orderBy(F.desc("at")).rangeBetween(*so_far)
    of = {"ids": ["identifier", "access"], "secrets": ["weak_secret", "assign", "hex"], "opaques": ["opaque"], "ends": ["endpoint"]}
    found = found.withColumn("x", events).select("*", "x.*").drop("x")
    found = found.withColumns({f"{x}_end": F.max(F.when(kind.isin(kinds) & ends, F.col("at"))).over(behind) for x, kinds in of.items()})
    found = found.withColumns({f"{x}_start": F.min(F.when(kind.isin(kinds) & ~ends, F.col("at"))).over(ahead) for x, kinds in of.items()})
    # A start tells what ends before it, an end what starts after it.
    near = lambda x: F.when(ends, F.col(f"{x}_start") <= F.col("end") + scope).otherwise(F.col(f"{x}_end") >= F.col("start") - scope)
    found = found.groupBy("rid", "doc_id", "kind", "start", "end", "match", "base").agg(*[F.coalesce(F.bool_or(near(x)), F.lit(False)).alias(x) for x in of])
    linked = (
        F.when(kind == "identifier", F.col("secrets") | F.col("opaques"))
        .when(kind == "weak_secret", F.col("ids"))
        .when(kind == "opaque", F.col("ids") | F.col("ends"))
        .when(kind == "endpoint", F.col("ids") & (F.col("secrets") | F.col("opaques")))
    )
    return found.select("rid", "doc_id", F.when(F.col("base") | linked, kind).alias("kind"), "start", "end", "match", "base")


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base (their spans) and spans (all) as kind:start:end by start, then kind."""
    found = found.withColumn("rank", S.ranked(KINDS, F.col("kind")))
    base = F.col("kind").isNotNull() & F.col("base")
    counts = [F.count_if(base & (F.col("kind") == k)).cast("long").alias(f"n_{k}") for k in BASE]
    spans = [S.joined(base, ["start", "rank"], KINDS).alias("base"), S.joined(F.col("kind").isNotNull(), ["start", "rank"], KINDS).alias("spans")]
    return found.groupBy("rid", "doc_id").agg(*counts, *spans).drop("rid")
