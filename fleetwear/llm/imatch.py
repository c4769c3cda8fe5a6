"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band:
frequent terms say little, rare ones are often typing errors. A document keeps
its distinct lexicon terms, sorted; the fingerprint hashes the whole list and
its parts in 32 random subsets of the lexicon: eight draws at four rates
each. Documents that differ in few terms still agree in most subsets.

A fingerprint is 33 fields joined by ``:``. The first is of the whole list, or
of the text itself if no term is in the lexicon; an empty subset is ``-``.
Likeness is 1 if the first fields agree; otherwise the share of equal subsets
among those that are not empty on both sides, at the rate where it is
largest (at least three such subsets, otherwise over all rates), 0.99 at most.

Size of the lexicon: at most (mean distinct terms of a document) / ``LEAST``
terms, whatever the number of documents, since each is in at least that share
of them. It is broadcast only up to ``BROADCAST_TERMS``.

Nulls and ties: a null text is empty; equal texts have equal fingerprints;
repeated rows stay repeated; an empty table gives an empty result; texts are
taken whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.common import whole_text
from fleetwear.llm.order import ring, with_next
from fleetwear.session import stage

LEAST, MOST = 0.001, 0.1  # share of documents that hold a lexicon term: the idf band
DRAWS, BITS = 8, (2, 4, 6, 8)  # subsets: draws, and halvings of the lexicon per rate
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """Distinct terms as hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(df: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """Rows (h): hashes of the terms in the band, from counts over all documents."""
    n = df.count()
    counts = df.select(F.explode(terms(whole_text(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 1.0))).select("h")


def _members(hits: Column, draw: int, bits: int) -> Column:
    """Hits in one random subset: those whose own bits of the hash are all zero."""
    mask = (1 << bits) - 1
    return F.filter(hits, lambda h: F.shiftrightunsigned(h, 8 * draw).bitwiseAND(F.lit(mask)) == 0)


def _field(hits: Column) -> Column:
    return F.when(F.size(hits) == 0, "-").otherwise(F.substring(F.lpad(F.hex(F.xxhash64(hits)), 16, "0"), 1, 8))


def fingerprint(hits: Column, digest: Column) -> Column:
    """``hits``: sorted distinct lexicon terms; ``digest``: of the text, for texts without any."""
    whole = F.when(F.size(hits) == 0, F.concat(F.lit("t"), F.substring(digest, 1, 32))).otherwise(
        F.lpad(F.hex(F.xxhash64(hits)), 16, "0")
    )
    return F.concat_ws(":", whole, *[_field(_members(hits, d, b)) for b in BITS for d in range(DRAWS)])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints."""
    x, y = F.split(a, ":"), F.split(b, ":")

    def share(first: int, n: int) -> tuple[Column, Column]:
        pairs = F.zip_with(F.slice(x, first, n), F.slice(y, first, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        seen = F.filter(pairs, lambda z: (z["p"] != "-") | (z["q"] != "-"))
        return F.size(F.filter(seen, lambda z: z["p"] == z["q"])), F.size(seen)

    rates = [share(2 + i * DRAWS, DRAWS) for i in range(len(BITS))]
    same, seen = share(2, DRAWS * len(BITS))
    overall = F.when(seen > 0, same / seen).otherwise(0.0)
    best = F.greatest(overall, *[F.when(n >= 3, s / n) for s, n in rates])
    return F.when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), 1.0).otherwise(F.least(best, F.lit(0.99)))


def fingerprints(
    df: DataFrame, lex: DataFrame, texts: dict[str, str], keep: list[str], by: list[str]
) -> DataFrame:
    """Fingerprint text columns of the same rows.

    ``texts`` names the result column of each text column, ``by`` identifies a
    row, ``keep`` are other columns to keep.
    """
    lex = stage(lex, "lexicon")
    small = lex.count() <= BROADCAST_TERMS
    # One marker term per row carries the kept columns, so that rows without
    # any lexicon term survive the join and the others stay narrow.
    lex = lex.where("h != 0").union(df.sparkSession.range(1).select(F.lit(0).cast("long")))
    meta = F.struct(*keep, *[F.sha2(whole_text(t), 256).alias(f"_d_{t}") for t in texts])
    kind = df.select(meta.alias("m")).schema["m"].dataType

    def tagged(i: int, t: str) -> Column:
        return F.transform(
            terms(whole_text(t)),
            lambda h: F.struct(F.lit(i).alias("i"), h.alias("h"), F.lit(None).cast(kind).alias("m")),
        )

    parts = [tagged(i, t) for i, t in enumerate(texts)]
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("h"), meta.alias("m")))
    rows = df.select(*by, F.explode(F.concat(mark, *parts)).alias("x")).select(*by, "x.*")
    held = rows.join(F.broadcast(lex) if small else lex, "h")
    grouped = held.groupBy(*by).agg(
        F.max_by("m", F.col("m").isNotNull()).alias("m"),
        *[F.sort_array(F.collect_list(F.when(F.col("i") == i, F.col("h")))).alias(f"_h_{t}") for i, t in enumerate(texts)],
    )
    return grouped.select(
        *by,
        *[F.col(f"m.{c}").alias(c) for c in keep],
        *[fingerprint(F.col(f"_h_{t}"), F.col(f"m._d_{t}")).alias(name) for t, name in texts.items()],
    )


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with its fingerprint, that of an edited version, and how like both and the next row's are.

    The edited text is the row's own with its last half (rounded down, in code
    points) replaced by as much of the start of the next row's text, or all of
    it, in descending order of ``key``; the last row is followed by the first.
    """
    rows = df.select(key, whole_text(text).alias("_text"))
    lex = lexicon(rows, "_text")
    chain = with_next(rows, key, "_text")
    after = F.coalesce(F.lead("_text").over(ring()), F.lit(""))
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    paired = chain.withColumn("_after", after).select(
        key,
        "piece",
        "rank",
        "ghost",
        "_text",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_after"), F.lit(1), half)).alias("_edited"),
    )
    made = fingerprints(
        paired.withColumn("edited_sha256", F.sha2("_edited", 256)),
        lex,
        {"_text": "fingerprint", "_edited": "edited_fingerprint"},
        [key, "n_chars", "edited_sha256", "ghost"],
        ["piece", "rank"],
    )
    return (
        made.withColumn("_next", F.lead("fingerprint").over(ring()))
        .where("ghost = 0")
        .select(
            key,
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
        )
    )
