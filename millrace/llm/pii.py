"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Five labelers vote on each (yes, no, or nothing): its form, a gazetteer of names, domains and country codes, cue words
around it, a gazetteer of placeholders, and its neighbours. Expectation-maximisation estimates how often each labeler votes each way on true and on
false spans; the resulting probabilities are the soft labels of the final span classifier, a logistic regression over the
votes and features of form. A proposed span is kept if the classifier finds it likely; the base spans (valid matches
of the base patterns) always stay.

How it scales: the texts are read once; only proposals are shuffled. Both models are fitted on counts of vote and feature
patterns, of which there are at most as many as combinations of their values (3^5 votes, and 3^5 x 1,536 with the
features), whatever the corpus' size. The fitted weights become a column expression.

Added spans never overlap: one that overlaps a base span goes, and of those that the classifier keeps, one that overlaps a kept one which starts before it (or at the same place and is
longer, or of the earlier kind as listed) goes. ``mask`` replaces just the spans that ``find`` gives; base spans that overlap one another are replaced together, under the name of the first.

Defined cases: null and empty texts have no spans; repeated rows each give a row; equal starts go by kind as listed; an
empty table gives no rows; a corpus without proposals trains nothing and keeps the base; extra columns are ignored by
``find`` and kept by ``mask``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import spans as S
from millrace.llm.common import free_name, materialise, pick

#: Gives the column of a name: one of a frame, or a field of what is at hand.
Named = Callable[[str], Column]
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "local_phone", "national_id", "spelt_email", "person"]

# The base patterns. Possessive forms match the same spans as the plain ones, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
NATIONAL_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SPELT_EMAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,40} ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,10}"
PERSON = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? \p{Lu}[\p{L}'-]{1,30}(?: \p{Lu}[\p{L}'-]{1,30})?"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Gazetteers of frequent top-level domains, given names and country calling codes.
TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|co|me|tv|app|dev|eu|uk|us|ca|au|nz|ie|in|za|de|at|ch|li|fr|be|nl|lu|es|pt|it|gr|pl|cz|sk|hu|ro|bg|si|hr|rs|ua|ru|"
    "se|no|dk|fi|is|ee|lv|lt|tr|il|ae|jp|cn|kr|tw|hk|sg|my|th|vn|id|ph|br|mx|ar|cl|pe"
)
GIVEN_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Mark|Donald|Steven|Paul|Andrew|Joshua|Kenneth|Kevin|Brian|George|Edward|"
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Lisa|Nancy|Betty|Margaret|Sandra|Ashley|Kimberly|Emily|Donna|Michelle|Carol|Amanda|Dorothy|Melissa|Laura|"
    "Hans|Klaus|Peter|Wolfgang|Jürgen|Stefan|Andreas|Uwe|Ralf|Dieter|Anna|Ursula|Monika|Petra|Sabine|Renate|Helga|Karin|Brigitte|Heike|"
    "Jean|Pierre|Michel|Philippe|Alain|Jacques|Marie|Sophie|Nathalie|Isabelle|Sylvie|Catherine|Françoise|Camille|Claire|"
    "José|Juan|Carlos|Luis|Manuel|Antonio|Francisco|Javier|Miguel|Pedro|María|Carmen|Ana|Isabel|Elena|Lucía|Pilar|Dolores|Rosa|Maria"
)
CALLING_CODES = (
    "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|98|212|213|216|234|254|351|352|353|354|358|370|371|372|"
    "380|385|386|420|421|852|886|966|971|972"
)
PLACEHOLDERS = r"(?i)^(?:0\.0\.0\.0|127\.0\.0\.1|255\.255\.255\.255|1\.2\.3\.4|123-45-6789|000-.*|no-?reply@.*|user(?:name)?@.*)$"
CUES = r"(?i)(?:e-?mail|mailto|contact|reach|write|phone|tel|call|fax|mobile|card|visa|credit|address|host|client|ssn|social|born|name|signed)[^\n]*$"
COUNTER_CUES = r"(?i)(?:version|release|isbn|invoice|order|serial|sku|part no|ticket|section|figure)[^\n]{0,12}$"


def _proposals(text: Column) -> list[tuple[str, Column, str]]:
    digits = F.regexp_like(text, F.lit("[0-9][^0-9]{0,2}[0-9]"))
    return [
        ("email", F.contains(text, F.lit("@")), EMAIL),
        ("ip", digits & F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), IP),
        ("card", digits & F.regexp_like(text, F.lit(r"(?:[0-9][\x20-]?){12}[0-9]")), CARD),
        ("phone", F.contains(text, F.lit("+")), PHONE),
        ("local_phone", digits & F.regexp_like(text, F.lit(r"[0-9]{3}[ .-][0-9]{4}")), LOCAL_PHONE),
        ("national_id", digits & F.regexp_like(text, F.lit("[0-9]-[0-9]{2}-[0-9]")), NATIONAL_ID),
        ("spelt_email", F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("AT")), SPELT_EMAIL),
        ("person", F.regexp_like(text, F.lit(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? \p{Lu}")), PERSON),
    ]


def base_valid(c: Named) -> Column:
    """Whether a match of a base pattern passes its kind's test."""
    kind, match = c("kind"), c("match")
    n = F.length(S.digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.regexp_like(match, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
        .when((kind == "card") & n.between(13, 19), S.luhn(S.digits(match)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _like(column: str | Column, pattern: str) -> Column:
    return F.regexp_like(column, F.lit(pattern))


def votes(c: Named) -> list[Column]:
    """Each labeler's vote on a proposal: 1, -1 or 0."""
    kind, match, left, right = (c(x) for x in ("kind", "match", "left", "right"))
    form = F.when(kind.isin(BASE), F.when(c("base"), 1).otherwise(-1)).when(
        kind == "national_id", F.when(_like(match, "^(?:000|666|9..)|-00-|-0000$"), -1).otherwise(1)
    ).when(kind == "local_phone", F.when(_like(match, r"^\(?[01]"), -1).otherwise(1)).otherwise(0)
    listed = (
        F.when(kind.isin("email", "spelt_email") & _like(match, rf"\b(?:{TOP_DOMAINS})$"), 1)
        .when((kind == "person") & _like(match, rf"\b(?:{GIVEN_NAMES})\b"), 1)
        .when((kind == "phone") & _like(match, rf"^\+(?:{CALLING_CODES})(?![0-9])"), 1)
        .otherwise(0)
    )
    cue = F.when(_like(left, COUNTER_CUES), -1).when(_like(left, CUES), 1).otherwise(0)
    placeholder = F.when(_like(match, PLACEHOLDERS) | _like(S.digits(match), r"^([0-9])\1{6,}$"), -1).otherwise(0)
    inside = _like(left, r"[\p{L}\p{N}_/=.-]$") | _like(right, r"^[\p{L}\p{N}_/=]")
    return [form, listed, cue, placeholder, F.when(inside, -1).otherwise(1)]


def features(c: Named) -> list[Column]:
    """Features of form: the kind's place, length in four steps, what stands on either side, and the number of words."""
    n = F.length(c("match"))
    size = F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3)
    side = lambda x, blank, mark: F.when(F.length(x) == 0, 0).when(_like(x, blank), 1).when(_like(x, mark), 2).otherwise(3)
    words = F.least(F.size(F.split(c("match"), " ")), F.lit(3)) - 1
    return [S.ranked(KINDS, c("kind")), size, side(c("left"), r"\s$", r"[\p{P}]$"), side(c("right"), r"^\s", r"^[\p{P}]"), words]


FEATURE_SIZES = [len(KINDS), 4, 4, 4, 3]


def estimate(votes_given: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 2.0) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (a row each, of -1, 0 and 1) and their counts: the share of true spans, and [labeler, class, vote + 1] how
    often each vote is given. It starts from labelers that are right more often than not."""
    start = np.array([[0.5, 0.3, 0.2], [0.15, 0.35, 0.5]])
    given = votes_given[:, :, None] == np.array([-1, 0, 1])
    share, rates = 0.5, np.tile(start, (votes_given.shape[1], 1, 1))
    for _ in range(rounds):
        p = posterior(votes_given, share, rates)
        held = prior * start + np.stack([np.einsum("n,nlv->lv", counts * q, given) for q in (1 - p, p)], axis=1)
        share = min(0.99, max(0.01, ((counts * p).sum() + prior) / (counts.sum() + 2 * prior)))
        rates = held / held.sum(axis=2, keepdims=True)
    return float(share), rates


def posterior(votes_given: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """The probability of each pattern that a span with these votes is true."""
    each = rates[np.arange(votes_given.shape[1])[None], :, votes_given + 1].prod(axis=1)
    yes, no = share * each[:, 1], (1 - share) * each[:, 0]
    return yes / (yes + no)


def _inputs(given: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The places of the classifier's active inputs, a row for each pattern."""
    return np.hstack([given + 1 + 3 * np.arange(given.shape[1]), form + 3 * given.shape[1] + np.concatenate([[0], np.cumsum(FEATURE_SIZES)[:-1]])])


def train_classifier(given: np.ndarray, form: np.ndarray, counts: np.ndarray, true: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on patterns of votes and features, their counts and probabilities of being true."""
    places, size = _inputs(given, form), 3 * given.shape[1] + sum(FEATURE_SIZES)
    weights, part = np.zeros(size), counts / counts.sum()
    for _ in range(rounds):
        wrong = part * (1 / (1 + np.exp(-weights[places].sum(axis=1))) - true)
        weights = weights - rate * (decay * weights + np.bincount(places.ravel(), np.repeat(wrong, places.shape[1]), size))
    return weights


def _probability(weights: np.ndarray, c: Named) -> Column:
    table, at, terms = F.array(*[F.lit(float(w)) for w in weights]), 1, []
    for k in range(5):
        terms.append(F.element_at(table, c(f"v{k}") + 1 + at))
        at += 3
    for k, size in enumerate(FEATURE_SIZES):
        terms.append(F.element_at(table, c(f"f{k}") + at))
        at += size
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def _judged(found: DataFrame) -> DataFrame:
    found = found.withColumn("base", F.coalesce(base_valid(F.col), F.lit(False)))
    found = found.withColumns({f"v{k}": v.cast("int") for k, v in enumerate(votes(F.col))})
    return found.withColumns({f"f{k}": f.cast("int") for k, f in enumerate(features(F.col))})


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All proposals with their votes and features; a row with null kind for each text without any."""
    return _judged(S.located(pick(docs, doc_id=id_col, text=text_col), _proposals(F.col("text"))))


def fit(proposals: DataFrame) -> np.ndarray | None:
    """The classifier's weights, from counts of patterns; None without proposals."""
    names = [f"v{k}" for k in range(5)] + [f"f{k}" for k in range(5)]
    counted = proposals.where("kind is not null").groupBy(*names).agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    table = np.array(sorted(tuple(r) for r in counted))
    given, form, n = table[:, :5], table[:, 5:10], table[:, 10].astype(float)
    by_votes, back = np.unique(given, axis=0, return_inverse=True)
    share, rates = estimate(by_votes, np.bincount(back.ravel(), n))
    return train_classifier(given, form, n, posterior(given, share, rates))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """rid, doc_id, kind, start, end, match, base, probability: the spans kept, and a row with null kind for each text without any."""
    proposals = materialise(propose(docs, id_col, text_col), "proposals")
    weights = fit(proposals)
    likely = _probability(weights, F.col) if weights is not None else F.lit(0.0)
    kept = S.free_of_base(proposals.withColumn("probability", likely))
    keep = F.col("base") | (~F.col("kind").isin(BASE) & (F.col("probability") >= threshold))
    kept = kept.withColumn("kind", F.when(keep, F.col("kind"))).withColumn("rank", S.ranked(KINDS, F.col("kind")))
    added = F.col("kind").isNotNull() & ~F.col("base")
    wider = S.free_of_wider(kept, added, overlaps=True)
    return wider.select("rid", "doc_id", "kind", "start", "end", "match", "base", "probability")


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base (their spans) and spans (all) as kind:start:end: a row for each text."""
    found = found.withColumn("rank", S.ranked(KINDS, F.col("kind")))
    base = F.col("kind").isNotNull() & F.col("base")
    counts = [F.count_if(base & (F.col("kind") == k)).cast("long").alias(f"n_{k}") for k in BASE]
    spans = [S.joined(base, ["rank", "start"], KINDS).alias("base"), S.joined(F.col("kind").isNotNull(), ["rank", "start"], KINDS).alias("spans")]
    return found.groupBy("rid", "doc_id").agg(*counts, *spans).drop("rid")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the spans that ``find`` gives replaced by their kinds in angle brackets.

    The spans come back to the texts by the texts' SHA-256, so equal texts are masked alike and nothing depends on the order of rows.
    """
    key, spans = free_name(docs, "__key"), free_name(docs, "__spans")
    keyed = docs.withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256))
    found = find(keyed, key, text_col, threshold).where("kind is not null").select("doc_id", "kind", "start", "end").distinct()
    found = found.withColumn("rank", S.ranked(KINDS, F.col("kind")))
    # Base spans that overlap are replaced as one.
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("part", (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")).cast("int"))
    found = found.withColumn("part", F.sum("part").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "part").agg(F.min(F.struct("start", -F.col("end"), "rank", "kind")).alias("first"), F.max("end").alias("end"))
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind")))).alias(spans))
    met, text, x = keyed.join(found, key, "left"), F.col(text_col), F.col(spans)
    ends = F.concat(F.array(F.lit(0).cast(found.schema[spans].dataType.elementType["end"].dataType)), F.transform(x, lambda s: s["end"]))
    told = F.zip_with(x, F.slice(ends, 1, F.size(x)), lambda s, at: F.concat(F.substr(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    masked = F.when(x.isNull(), text).otherwise(F.concat(F.array_join(told, ""), F.substr(text, (F.element_at(ends, -1) + 1).cast("int"))))
    return met.select(*[masked.alias(c) if c == text_col else met[c] for c in docs.columns])
