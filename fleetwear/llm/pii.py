"""Personal data by weak supervision.

Patterns propose spans. Labelers vote on each (+1 personal, -1 not, 0 no
opinion): a strict pattern, a checksum or range test, a gazetteer, cue words
before the span, and the characters around it. Votes are counted by vote
pattern over all rows; expectation-maximisation estimates from these counts how
reliable each labeler is, and gives every pattern a probability. A logistic
span classifier is trained on them (votes, kind and length as features) and
decides on the proposals that are not of the four base kinds. Base spans that
pass their own rule always stay.

The number of vote patterns is bounded by the labelers and kinds (at most
``len(KINDS) * 3**5 * 8``), so what reaches the driver does not grow with the
input.

Nulls: a null text counts as empty and has no spans. Repeated rows stay
repeated; an empty table, or one without proposals, gives empty spans; texts
are scanned whole; other columns are kept, and those that clash with the added
names are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm import spans
from fleetwear.llm.common import whole_text
from fleetwear.session import stage

# The runs before "@" and before a dot can only match from their first
# character or from the end of the last match: \G and the look-behind say so
# and keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MASKED = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}"
LOCAL_PHONE = r"(?<![A-Za-z0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])"
SOCIAL = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

BASE = ("email", "ip", "card", "phone")
EXTRA = (("masked_email", MASKED), ("local_phone", LOCAL_PHONE), ("social", SOCIAL), ("iban", IBAN))
KINDS = (*BASE, *(k for k, _ in EXTRA))
LABELERS = ("strict", "checked", "gazetteer", "cue", "around")

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$",
    "card": r"^[2-6][0-9]{12,18}$|^[2-6][0-9]{3}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}$",
    "masked_email": r"(?:\[at\]|\(at\)).*(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,24}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "social": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11,}$",
}
#: Gazetteers: endings of mail hosts, country calling codes, countries of account numbers.
TLD = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|us|ca|eu|nl|ch|at|be|mx|ar|br"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|42[01]"
GAZETTEER = {
    "email": rf"(?i)\.(?:{TLD})$",
    "masked_email": rf"(?i)(?:dot\)|dot\]|\.)\x20?(?:{TLD})$",
    "phone": rf"^\+(?:{CALLING})(?:[^0-9]|[0-9]{{6,}})",
    "iban": r"^(?:DE|FR|ES|IT|NL|BE|CH|AT|GB|PT|LU|IE)",
}
#: Words before a span that speak for its kind, and such that speak against any.
CUES = {
    "email": r"(?i)mail|contact|write|correo|schreib|courriel",
    "ip": r"(?i)\bip\b|host|server|address|login|client",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|call|tel\b|tel\.|mobile|fax|telefon|appel",
    "masked_email": r"(?i)mail|contact|write|correo|schreib|courriel",
    "local_phone": r"(?i)phone|call|tel\b|tel\.|mobile|fax|telefon|appel",
    "social": r"(?i)ssn|social|security|tax",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
}
AGAINST = r"(?i)version|release|build|isbn|order|section|part no|serial|figure"
REACH = 32  # code points before a span that are searched for cues


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds that pass their rules, sorted."""
    digits = lambda w: F.regexp_replace(w, "[^0-9]", "")
    return F.array_sort(
        F.concat(
            spans.find(text, EMAIL, "email", 0),
            spans.keep(
                spans.find(text, IP, "ip", 1), lambda w: F.rlike(w, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
            ),
            spans.keep(
                spans.find(text, CARD, "card", 2),
                lambda w: F.when(F.length(digits(w)).between(12, 19), _luhn(digits(w))),
            ),
            spans.keep(
                spans.find(text, PHONE, "phone", 3), lambda w: F.length(digits(w)).between(9, 15)
            ),
        )
    )


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(kind: Column, tests: dict[str, str], word: Column) -> Column:
    """True or false by the kind's pattern, null for kinds without one."""
    out = F.lit(None).cast("boolean")
    for k, pattern in tests.items():
        out = F.when(kind == k, F.rlike(word, F.lit(pattern))).otherwise(out)
    return out


def _with_votes(text: Column, found: Column) -> Column:
    def votes(s: Column) -> Column:
        kind, w = s["kind"], s["w"]
        before = F.substring(text, F.greatest(s["b"] - REACH, F.lit(0)) + 1, F.least(s["b"], F.lit(REACH)))
        edge = F.concat(F.substring(before, -1, 1), F.lit("|"), F.substring(text, s["e"] + 1, F.lit(1)))
        digits = F.regexp_replace(w, "[^0-9]", "")
        checked = (
            F.when(kind == "card", _luhn(digits))
            .when(kind == "social", F.rlike(w, F.lit(STRICT["social"])))
            .when(kind == "iban", F.length(F.replace(w, F.lit(" "), F.lit(""))).between(15, 34))
        )
        strict, listed = _by_kind(kind, STRICT, w), _by_kind(kind, GAZETTEER, w)
        return F.struct(
            s.alias("span"),
            _vote(strict, ~strict).alias("strict"),
            _vote(checked, ~checked).alias("checked"),
            _vote(listed, ~listed).alias("gazetteer"),
            _vote(_by_kind(kind, CUES, before), F.rlike(before, F.lit(AGAINST))).alias("cue"),
            _vote(F.lit(False), F.rlike(edge, F.lit(r"[A-Za-z0-9]"))).alias("around"),
            F.least(F.length(digits) / 3, F.lit(7)).cast("int").alias("digits"),
        )

    return F.transform(found, votes)


def propose(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``proposals``: all proposed spans with their votes."""
    whole = whole_text(text)
    extra = [spans.find(whole, p, k, len(BASE) + i) for i, (k, p) in enumerate(EXTRA)]
    marked = whole.contains("[at]") | whole.contains("(at)")  # cheap test before the pattern
    extra[0] = F.when(marked, extra[0]).otherwise(spans.no_spans())
    found = df.drop("base_spans", "proposals").withColumn("base_spans", base_spans(whole))
    found = found.withColumn("_extra", spans.apart_from(F.concat(*extra), F.col("base_spans")))
    return found.withColumn(
        "proposals", _with_votes(whole, F.concat("base_spans", "_extra"))
    ).drop("_extra")


def vote_patterns(proposed: DataFrame) -> DataFrame:
    """Rows (kind, votes, digits, n): how often each combination occurs, over all rows."""
    p = proposed.select(F.explode("proposals").alias("p"))
    keys = [F.col("p.span.kind").alias("kind"), *[F.col(f"p.{v}").alias(v) for v in LABELERS]]
    return p.groupBy(*keys, F.col("p.digits").alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def estimate(patterns: list, rounds: int = 50) -> list[float]:
    """Probability of each vote pattern, by expectation-maximisation.

    Labelers are independent given the truth; each has a rate of right votes
    when it votes, in each class, and each kind has its own prior. The start
    is the share of +1 among the votes cast.
    """
    def start(r) -> float:
        cast = [r[v] for v in LABELERS if r[v]]
        return (sum(v > 0 for v in cast) + 1) / (len(cast) + 2)

    q = [start(r) for r in patterns]
    for _ in range(rounds):
        prior, right = {}, {}
        for k in {r["kind"] for r in patterns}:
            own = [(r["n"], p) for r, p in zip(patterns, q, strict=True) if r["kind"] == k]
            prior[k] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
        for v in LABELERS:
            for y in (0, 1):
                cast = [(r["n"] * (p if y else 1 - p), r[v] > 0) for r, p in zip(patterns, q, strict=True) if r[v]]
                # One added vote on the right side keeps the classes from changing places.
                up = sum(w for w, plus in cast if plus) + (2 if y else 1)
                right[v, y] = up / (sum(w for w, _ in cast) + 3)
        fresh = []
        for r in patterns:
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            for v in LABELERS:
                if r[v]:
                    a, b = right[v, 1], right[v, 0]
                    odds += math.log(a / b) if r[v] > 0 else math.log((1 - a) / (1 - b))
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        done = max((abs(a - b) for a, b in zip(q, fresh, strict=True)), default=0) < 1e-6
        q = fresh
        if done:
            break
    return q


def _features() -> list[Column]:
    votes = [(F.col(v) == s).cast("double").alias(f"{v}_{'up' if s > 0 else 'down'}") for v in LABELERS for s in (1, -1)]
    return [*votes, *[(F.col("kind") == k).cast("double").alias(f"is_{k}") for k in KINDS], (F.col("digits") / 7).alias("many")]


def train(patterns_df: DataFrame) -> tuple[float, list[float]]:
    """Intercept and weights of the span classifier; without proposals, one that refuses all."""
    rows = patterns_df.orderBy("kind", *LABELERS, "digits").collect()  # bounded, see above
    if not rows:
        return -30.0, [0.0] * len(_features())
    q = estimate(rows)
    spark = patterns_df.sparkSession
    soft = [
        (*[r[c] for c in ("kind", *LABELERS, "digits")], float(y), r["n"] * (p if y else 1 - p) + 1e-3)
        for r, p in zip(rows, q, strict=True)
        for y in (0, 1)
    ]
    names = ["kind", *LABELERS, "digits", "label", "weight"]
    table = spark.createDataFrame(soft, ", ".join(
        f"{c} {'string' if c == 'kind' else 'double' if c in ('label', 'weight') else 'int'}" for c in names
    )).coalesce(1)
    made = table.select("label", "weight", *_features())
    inputs = [c for c in made.columns if c not in ("label", "weight")]
    ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(made)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(ready)
    return float(model.intercept), [float(w) for w in model.coefficients]


def detect(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``keys``, ``base_spans`` and ``pii_spans`` (base and accepted, sorted).

    The proposals are written once to the shared folder (spans only, no texts):
    the counts over all rows and the decisions both read them.
    """
    found = stage(propose(df, text).select(*keys, "base_spans", "proposals"), "pii-proposals")
    intercept, weights = train(vote_patterns(found))

    def accepted(p: Column) -> Column:
        score = F.lit(intercept)
        fields = {c: p[c] for c in (*LABELERS, "digits")} | {"kind": p["span"]["kind"]}
        terms = [
            *[(fields[v] == s).cast("double") for v in LABELERS for s in (1, -1)],
            *[(fields["kind"] == k).cast("double") for k in KINDS],
            fields["digits"] / 7,
        ]
        for w, x in zip(weights, terms, strict=True):
            score = score + F.lit(w) * x
        return score >= 0

    base = set(BASE)
    extra = F.filter("proposals", lambda p: ~p["span"]["kind"].isin(*sorted(base)) & accepted(p))
    return found.select(
        *keys,
        "base_spans",
        F.array_sort(F.concat("base_spans", F.transform(extra, lambda p: p["span"]))).alias("pii_spans"),
    )
