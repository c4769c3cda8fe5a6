"""Secret scan: fixed shapes, and entropy of windows over candidate strings.

Shapes (``assign``, ``access``, ``hex``) are found as leftmost non-overlapping
matches; matches that fail their length rule are dropped. Candidates for the
entropy test are long runs of key characters. Each belongs to the narrowest
character class that holds it, and a window of ``WINDOW`` characters slides
over it: counts per character are updated by the one that enters and the one
that leaves, and with them the sum of c * log2(c), from which the entropy of
the window follows. A candidate with a window over its class's threshold is a
``entropy`` span, unless an allow-list pattern matches it or a shape overlaps it.

Nulls: a null text counts as empty and has no spans. Repeated rows stay
repeated, an empty table gives an empty result, texts are scanned whole, and
other columns are kept as they are; columns that clash with the added names
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm import spans
from fleetwear.llm.common import whole_text

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Narrowest class first: name, pattern of the class, entropy threshold in bits of a window of 20.
CLASSES = (
    ("hex", r"^[0-9A-F-]+$|^[0-9a-f-]+$", 2.9),
    ("upper", r"^[A-Z0-9_-]+$", 3.6),
    ("lower", r"^[a-z0-9_-]+$", 3.6),
    ("mixed", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Strings that look random but are not secrets.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]|dummy|xxxx",
    r"(?i)abcdefgh|12345678|qwerty",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"(?:/[a-z]+){3}",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) over the windows of ``text``; of the whole text if it is shorter.

    Only characters of ``ALPHABET`` may occur. The state holds one count per
    character of the alphabet, so a step costs the same whatever the length.
    """
    chars = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    moves = F.zip_with(
        chars,
        F.concat(F.array_repeat(F.lit(0), window), chars),
        lambda enter, leave: F.struct(F.coalesce(enter, F.lit(0)).alias("i"), leave.alias("o")),
    )
    # The shifted copy is longer by a window; those last moves only empty it.
    moves = F.slice(moves, 1, F.size(chars))
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"),
        F.lit(0.0).alias("s"),
        F.lit(0).alias("len"),
        F.lit(0.0).alias("top"),
    )

    def step(acc: Column, m: Column) -> Column:
        leaving = F.coalesce(F.get(acc["n"], m["o"] - 1), F.lit(0))
        entering = F.coalesce(F.get(acc["n"], m["i"] - 1), F.lit(0)) - F.when(m["i"] == m["o"], 1).otherwise(0)
        total = (
            acc["s"]
            + _weight(leaving - 1) - _weight(leaving)
            + _weight(entering + 1) - _weight(entering)
        )
        size = acc["len"] + F.when(m["o"] > 0, 0).otherwise(1)
        counts = F.transform(
            acc["n"],
            lambda c, k: c + F.when(k == m["i"] - 1, 1).otherwise(0) - F.when(k == m["o"] - 1, 1).otherwise(0),
        )
        entropy = F.log2(size) - total / size
        return F.struct(
            counts.alias("n"), total.alias("s"), size.alias("len"), F.greatest(acc["top"], entropy).alias("top")
        )

    return F.aggregate(moves, state, step, lambda acc: acc["top"])


def is_random(text: Column) -> Column:
    """Whether a candidate passes the threshold of its class and no allow-list pattern matches."""
    limit = F.lit(None).cast("double")
    for _, pattern, threshold in reversed(CLASSES):
        limit = F.when(F.rlike(text, F.lit(pattern)), threshold).otherwise(limit)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.rlike(text, F.lit(pattern))
    return F.when(allowed, False).otherwise(window_entropy(text) >= limit)


def base_spans(text: Column) -> Column:
    """Spans of the fixed shapes, sorted."""
    assign = spans.keep(
        spans.find(text, ASSIGN, "assign", 0),
        lambda w: F.length(F.regexp_extract(w, ASSIGN_VALUE, 1)) >= 6,
    )
    access = spans.keep(spans.find(text, ACCESS, "access", 1), lambda w: F.length(w) >= 20)
    return F.array_sort(F.concat(assign, access, spans.find(text, HEX, "hex", 2)))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (all, sorted), arrays of spans."""
    whole = whole_text(text)
    found = df.drop("base_spans", "secret_spans").withColumn("base_spans", base_spans(whole))
    return found.withColumn("_candidates", spans.find(whole, CANDIDATE, "entropy", 3)).select(
        *[c for c in found.columns],
        F.array_sort(
            F.concat(
                "base_spans",
                spans.keep(spans.apart_from(F.col("_candidates"), F.col("base_spans")), is_random),
            )
        ).alias("secret_spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace every secret span of ``text`` by ``mark``; overlapping spans become one mark."""
    s = F.col("secret_spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, x["b"] - acc["at"])
        fresh = x["b"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        s, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1))
    )
    columns = [c for c in df.columns if c not in ("base_spans", "secret_spans")]
    found = scan(df, text)
    return found.select(
        *[F.when(F.size(s) > 0, clean).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in columns]
    )
