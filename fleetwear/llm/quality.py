"""Quality rules by compression bands.

Every text is compressed with zstandard as a whole, and again in fixed chunks.
Repetitive text compresses better than prose of its length, random characters
worse, so a text is judged against a band for its own length: short texts
compress badly, whatever they say. The bands come from the corpus. Texts that
pass the base rules are counted, each distinct text once, by group (language),
length (sixteenths of an octave) and ratio (thousandths); from these counts the
median and the robust spread of every half octave are taken, and lie on a line
between its neighbours. A text is out of its band below ``BELOW`` or above
``ABOVE`` spreads from the median, or beyond ``OUTER`` at any length. Chunks of
``CHUNK`` bytes are texts of that length: a document goes when more than
``SHARE`` of its whole chunks lie more than ``CHUNK_BELOW`` spreads below or
``CHUNK_ABOVE`` above.

Groups of fewer than ``OWN`` texts are judged by the bands of the whole corpus;
half octaves with fewer than ``NODE`` texts lean on their neighbours, and beyond
the outermost ones the band goes on along its slope, wider by a spread an octave;
where there are no such counts at all, ``OUTER`` alone holds.

Base rules: fewer than 50 words, or over half of the words in three-word windows
that the text has twice or more.

Nulls and ties: a null text is empty and fails the base rules, as does an empty
one; a null group is the group of the empty name; null and repeated keys keep
their rows; repeated texts count once in the bands (told by 64-bit hashes) and
get the same verdict within a group; an empty table gives an empty result;
texts are taken whole, in slices of bounded size; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.common import by_bytes, python_workers
from fleetwear.session import stage

LEVEL = 12
CHUNK = 4096
BELOW, ABOVE = 3.0, 6.0
CHUNK_BELOW, CHUNK_ABOVE, SHARE = 4.0, 8.0, 0.25
OUTER = (0.15, 1.0)
OWN, NODE = 200, 30
LEAST_SPREAD = 6.0  # thousandths
FINE = 16  # lengths an octave
BEYOND = 20 * FINE  # how far the band is carried on
SLOPE = -40 / FINE  # thousandths a length, where a corpus shows one half octave only
BROADCAST_GROUPS = 10_000
#: White space between words, and the characters counted as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, zstd_bytes long, chunk_bytes array<int>, digest long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
    _, of, times = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    again = times[of] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measured(df: DataFrame, key: str = "doc_id", by: str | None = "lang", text: str = "text") -> DataFrame:
    """Rows (key, grp, the base counts, sizes whole and by chunks, a hash of the text)."""
    python_workers(df.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch in batches:
            for rows in by_bytes(batch, 2):
                out = []
                for t in rows.column(2).to_pylist():
                    t = t or ""
                    data = t.encode()
                    words = data.split()
                    whole = len(data) // CHUNK * CHUNK
                    out.append((
                        len(words),
                        len(t) - sum(map(t.count, SPACES)),
                        sum(map(t.count, SYMBOLS)),
                        duplicate_lines(t),
                        repeated_words(words),
                        len(data),
                        len(squeeze(data)) if data else 0,
                        [len(squeeze(data[a:a + CHUNK])) for a in range(0, whole, CHUNK)],
                        xxhash.xxh3_64_intdigest(data) - (1 << 63),
                    ))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32()), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["key", "grp", *[m.split()[0] for m in MEASURES.split(", ")]],
                )

    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    kind = dict(df.dtypes)[key]
    narrow = df.select(F.col(key).alias("key"), group.alias("grp"), F.col(text).alias("text"))
    return narrow.mapInArrow(measure, f"key {kind}, grp string, {MEASURES}")


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)])


def fit_bands(fine: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Nodes of the band: length in sixteenths of an octave, median and spread of the ratio in thousandths."""
    half = fine // (FINE // 2)
    nodes = [k for k in np.unique(half) if n[half == k].sum() >= NODE]
    if not nodes:
        return [], [], []
    at = [float(np.average(fine[half == k] + 0.5, weights=n[half == k])) for k in nodes]
    middle = [weighted_median(bins[half == k], n[half == k]) for k in nodes]
    # Lengths beyond the nodes follow the slope of the outermost two.
    first, last = (_slope(at, middle, 0), _slope(at, middle, len(at) - 2)) if len(at) > 1 else (SLOPE, SLOPE)
    far_at = [at[0] - BEYOND, *at, at[-1] + BEYOND]
    far_middle = [middle[0] - first * BEYOND, *middle, middle[-1] + last * BEYOND]
    off = np.abs(bins - np.interp(fine + 0.5, far_at, far_middle))
    spread = [1.4826 * weighted_median(off[half == k], n[half == k]) for k in nodes]
    # A length where copies of one text abound has a spread of almost nothing: its neighbours speak for it.
    spread = [max(s, float(np.median(spread[max(0, i - 2):i + 3])), LEAST_SPREAD) for i, s in enumerate(spread)]
    # The less is known of a length, the wider its band: one more spread an octave.
    wide = 1 + BEYOND / FINE
    return far_at, far_middle, [spread[0] * wide, *spread, spread[-1] * wide]


def _slope(at: list[float], middle: list[float], i: int) -> float:
    return (middle[i + 1] - middle[i]) / (at[i + 1] - at[i])


def bands(measures: DataFrame) -> DataFrame:
    """Rows (grp, n, at, middle, spread): the band of every group and, under a null group, of all together.

    Lengths and ratios have a few thousand steps, so the counts of a group are
    small however many texts it has.
    """
    steps = measures.where(~base_failed()).select(
        "grp", "digest",
        F.floor(FINE * F.log2("n_bytes")).cast("int").alias("fine"),
        F.round(1000 * F.col("zstd_bytes") / F.col("n_bytes")).cast("int").alias("bin"),
    ).distinct().groupBy("grp", "fine", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = steps.union(steps.groupBy(F.lit(None).cast("string").alias("grp"), "fine", "bin").agg(F.sum("n").alias("n")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(np.int64)
        at, middle, spread = fit_bands(rows["fine"].to_numpy(np.int64), rows["bin"].to_numpy(np.int64), n)
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "n": [int(n.sum())], "at": [at], "middle": [middle], "spread": [spread]})

    return both.groupBy("grp").applyInPandas(
        fit, "grp string, n long, at array<double>, middle array<double>, spread array<double>"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def spreads_off(size: Column, length: Column) -> Column:
    """How many spreads a compressed size is above (or, negative, below) the median of its length; null without a band."""
    x = FINE * F.log2(length)
    right = F.size(F.filter("at", lambda a: a <= x))  # nodes not right of the length
    left = F.greatest(right - 1, F.lit(0))
    right = F.least(right, F.size("at") - 1)
    span = F.get("at", right) - F.get("at", left)
    part = F.least(F.greatest(F.when(span > 0, (x - F.get("at", left)) / span).otherwise(0.0), F.lit(0.0)), F.lit(1.0))

    def between(column: str) -> Column:
        return F.get(column, left) + part * (F.get(column, right) - F.get(column, left))

    return F.when(F.size("at") > 0, (1000 * size / length - between("middle")) / between("spread"))


def judge(df: DataFrame, key: str = "doc_id", by: str | None = "lang", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, base counts, ``base_failed``, ``kept`` and ``reason``.

    ``reason`` is base, repetitive, incompressible or chunks; null for those kept.
    The measures are staged, so a text is compressed once; nothing but numbers
    and the group leaves the task that read it.
    """
    measures = stage(measured(df, key, by, text), "quality-measures")
    found = stage(bands(measures), "quality-bands")
    whole = found.where("grp is null").select("at", "middle", "spread").first()
    kind = "array<double>"
    pooled = {c: F.array(*map(F.lit, whole[c] if whole else [])).cast(kind) for c in ("at", "middle", "spread")}
    own = found.where((F.col("grp").isNotNull()) & (F.col("n") >= OWN) & (F.size("at") > 0)).select(
        F.col("grp").alias("of"), *[F.col(c).alias(f"own_{c}") for c in pooled]
    )
    few = own.count() <= BROADCAST_GROUPS
    placed = measures.join(F.broadcast(own) if few else own, F.col("grp") == F.col("of"), "left").select(
        *measures.columns, *[F.coalesce(F.col(f"own_{c}"), p).alias(c) for c, p in pooled.items()]
    )
    ratio = F.col("zstd_bytes") / F.col("n_bytes")
    scored = placed.select(
        "*", base_failed().alias("base_failed"),
        F.when(F.col("n_bytes") > 0, spreads_off(F.col("zstd_bytes"), F.col("n_bytes"))).alias("off"),
        F.when(F.col("n_bytes") > 0, ratio).alias("ratio"),
        # Every chunk has the same length: its spreads are a line in its size.
        spreads_off(F.lit(0), F.lit(CHUNK)).alias("chunk_zero"),
        spreads_off(F.lit(CHUNK), F.lit(CHUNK)).alias("chunk_full"),
    )
    bad = F.filter("chunk_bytes", _chunk_outside)
    reason = (
        F.when(F.col("base_failed"), "base")
        .when((F.col("ratio") < OUTER[0]) | (F.col("off") < -BELOW), "repetitive")
        .when((F.col("ratio") > OUTER[1]) | (F.col("off") > ABOVE), "incompressible")
        .when(F.size(bad) > SHARE * F.size("chunk_bytes"), "chunks")
    )
    return scored.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", reason.isNull().alias("kept"), reason.alias("reason"), "n_bytes", "zstd_bytes", "off",
    )


def _chunk_outside(size: Column) -> Column:
    off = F.col("chunk_zero") + (F.col("chunk_full") - F.col("chunk_zero")) * size / CHUNK
    ratio = size / CHUNK
    return (ratio < OUTER[0]) | (ratio > OUTER[1]) | F.coalesce((off < -CHUNK_BELOW) | (off > CHUNK_ABOVE), F.lit(False))
