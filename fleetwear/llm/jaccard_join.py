"""Similarity self-join of documents on their word shingles, and its components.

Two documents link when the Jaccard similarity of their shingle sets reaches a
percentage. The join is exact; hashes of 64 bits stand for the shingles.

1. Equal sets are one class, known by its hash, and are never compared again.
2. A class whose set holds too many shingles found in no other class cannot
   reach the percentage with any. Counting a quarter of the hash space proves
   it for most classes; only the rest are read again.
3. Shingles of the rest are ordered by how many classes hold them. Linked sets
   share a shingle of their first ``n - ceil(t n) + 1``, and two of their first
   ``n - ceil(t n) + 2`` (for ``n`` over 1).
4. Heavy and light: for small sets all pairs of shingles of the longer prefix
   are the keys (fixed-size subsets), for large ones the single shingles of
   the shorter prefix (inverted lists). The size that parts them is the one of
   least estimated cost; sets just below it have keys of both kinds, since
   linked sets differ in size by at most the percentage.
5. Lists with the same members are kept once. A long list is cut into blocks
   and each pair of blocks is compared in a task of its own, with the sets at
   hand; a task passes on the links that connect its members, not all pairs.
6. The links' components give every document its smallest reachable id.

What reaches the driver are counts by set size, for at most ``LIGHT_MOST`` sizes.

Nulls and ties: a null or empty text, or one of white space only, has an empty
set and links with nothing; rows are documents of their own even if they share
an id; rows with a null id link like others, a null id is never the smallest,
and a component of null ids only has a null id; an empty table gives an empty
result; texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.llm.common import python_workers, working
from fleetwear.llm.components import components
from fleetwear.llm.shingles import forget, mix, shingle_sets
from fleetwear.session import release, stage

WIDTH, PERCENT = 5, 80
SLICE_BYTES = 500_000  # text hashed at once
BLOCK = 256  # members compared at once with as many others
WORD = r"[^\x20\x09-\x0D]"  # fixed value: what words are made of
LIGHT_MOST = 64  # largest size for which pairs of shingles may be keys
BROADCAST_IDS = 1_000_000
SAMPLE_BITS = 2  # a quarter of the hash space


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as bytes, in slices of bounded size (a longer text alone)."""
    texts = [t.encode() if t else b"" for t in column.to_pylist()]
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _class_of(s: np.ndarray) -> int:
    """Hash of a whole set, as a signed number."""
    return int((np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567))) ^ mix(np.full(1, len(s), np.uint64))[0]).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _row(key: str, text: str) -> Column:
    """Digest by which a row is found again, also one with a null id."""
    return F.xxhash64(key, text)


def sets_of(df: DataFrame, key: str, text: str, width: int, sample: bool) -> DataFrame:
    """Rows (key, row, n, node, tokens): digest of key and text, size, class and shingles (``sample``: those of the counted part of the hash space)."""
    python_workers(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("shingles", forget)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                sets = shingle_sets(texts, width)
                nodes = [_class_of(s) if len(s) else 0 for s in sets]
                kept = [s[: np.searchsorted(s, np.uint64(1 << 64 - SAMPLE_BITS))] for s in sets] if sample else sets
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, len(texts)) for c in (0, 2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), _lists(kept)],
                    ["key", "row", "n", "node", "tokens"],
                )

    rows = df.select(key, text, _row(key, text).alias("_row"))
    return rows.mapInArrow(hashed, f"key {kind}, row long, n long, node long, tokens array<long>")


def _least_overlap(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _prefix(n: Column, percent: int, share: int) -> Column:
    return (n - _least_overlap(n, percent) + share).cast("int")


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (node, n, row) of the classes that may link: node, size and a row's digest, of one with an id if there is any."""
    classes = rows.where("n > 0").groupBy("node").agg(
        F.max("n").alias("n"), F.min(F.struct(F.col("key").isNull().alias("u"), "row"))["row"].alias("row")
    )
    alone = (
        rows.where("n > 0").select("node", F.explode("tokens").alias("h"))
        .groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    )
    joined = classes.join(alone, "node", "left")
    return joined.where(F.coalesce("alone", F.lit(0)) < _prefix(F.col("n"), percent, 1)).select("node", "n", "row")


def _numbered(counts: DataFrame) -> DataFrame:
    """Add ``id``: numbers from 0 without gaps, half as wide as the hashes while they fit."""
    rows = stage(counts.withColumn("_i", F.monotonically_increasing_id()), "jaccard-counts")
    part = F.shiftright("_i", 33)
    sizes = rows.groupBy(part.alias("_p")).agg((F.max(F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("m"))
    sizes = stage(sizes, "jaccard-parts")  # a row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_p", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_o")))
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    number = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")
    kind = "int" if total < 1 << 31 else "long"
    return rows.withColumn("_p", part).join(offsets, "_p").select("h", "df", number.cast(kind).alias("id"))


def _boundary(ordered: DataFrame, percent: int) -> int:
    """Largest size whose sets use pairs of shingles, by estimated rows: keys made, and list entries compared."""
    wide = F.greatest(_prefix(F.col("n"), percent, 2) - F.col("alone"), F.lit(0))
    narrow = F.greatest(_prefix(F.col("n"), percent, 1) - F.col("alone"), F.lit(0)).cast("int")
    sums = (
        ordered.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(
            F.sum(wide * (wide - 1) / 2).alias("light"),
            # Each entry of an inverted list meets the others of the list.
            F.sum(F.aggregate(F.slice("common", 1, narrow), F.lit(0.0), lambda s, x: s + x["df"].cast("double"))).alias("heavy"),
        ).collect()
    )
    light = {r["n"]: r["light"] or 0.0 for r in sums}
    heavy = {r["n"]: r["heavy"] or 0.0 for r in sums}
    both = lambda b: [n for n in heavy if n > b * percent // 100]
    return min(
        range(LIGHT_MOST + 1),
        key=lambda b: (sum(v for n, v in light.items() if n <= b) + sum(heavy[n] for n in both(b)), b),
    )


def _postings(ordered: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Rows (k, node): keys of both kinds."""
    n, alone = F.col("n"), F.col("alone")

    def first(share: int) -> Column:
        size = F.greatest(_prefix(n, percent, share) - alone, F.lit(0)).cast("int")
        return F.transform(F.slice("common", 1, size), lambda x: x["h"])

    wide = F.when((n <= boundary) & (n > 1), first(2)).otherwise(F.array().cast("array<bigint>"))
    pairs = F.flatten(F.transform(
        wide, lambda x, i: F.transform(F.slice(wide, i + 2, F.size(wide)), lambda y: F.xxhash64(x, y))
    ))
    narrow = F.when(n > F.lit(boundary * percent // 100 - 1), first(1)).otherwise(F.array().cast("array<bigint>"))
    single = F.transform(narrow, lambda x: F.xxhash64(x))
    return ordered.select("node", F.explode(F.concat(pairs, single)).alias("k"))


def _compared(percent: int):
    """Links within sorted runs of one block pair; see ``links``."""

    def links_of(nodes: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        m = len(nodes)
        flat = np.concatenate(sets)
        tokens, index, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        shared = count[index] > 1
        place = (np.cumsum(count > 1) - 1)[index[shared]]
        row = row[shared]
        width = int((count > 1).sum())
        common = np.zeros((m, m), np.float32)
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[order]
        for at in range(0, width, 4096):
            a, b = np.searchsorted(place, [at, at + 4096])
            part = np.zeros((m, min(4096, width - at)), np.float32)
            part[row[a:b], place[a:b] - at] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        if sides.any() and not sides.all():
            linked &= sides[:, None] != sides[None, :]
        x, y = np.nonzero(np.triu(linked, 1))
        root = list(range(m))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard_join")
        current, nodes, sides, sizes, sets = None, [], [], [], []

        def done() -> pa.RecordBatch:
            found = links_of(np.array(nodes), np.array(sides, bool), np.array(sizes), sets) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2)], strict=True))
            tokens = batch.column(6)
            for i, (key, node, side, n) in enumerate(
                zip(keys, *[batch.column(c).to_pylist() for c in (3, 4, 5)], strict=True)
            ):
                if key != current:
                    if nodes:
                        yield done()
                    current, nodes, sides, sizes, sets = key, [], [], [], []
                nodes.append(node)
                sides.append(side)
                sizes.append(n)
                sets.append(tokens[i].values.to_numpy())
        if nodes:
            yield done()

    return compare


def links(postings: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b): links that connect the linked members of every list of ``postings``.

    Only the shingles that several sets hold travel, as short numbers, with the full size of the set.
    """
    lists = postings.groupBy("k").agg(
        F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("members > 1")
    once = lists.groupBy("members", "x", "y").agg(F.min("k").alias("k"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    placed = postings.join(once, "k").withColumn("blocks", blocks).withColumn("own", own)
    spread = placed.select(
        "k", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", (F.col("own") > F.col("other")).alias("side")
    )
    sets = ordered.select("node", "n", F.transform("common", lambda x: x["id"]).alias("tokens"))
    filled = spread.join(sets, "node").select("k", "i", "j", "node", "side", "n", "tokens")
    runs = filled.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "node")
    return runs.mapInArrow(_compared(percent), "a long, b long")


def grouped(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Rows (key, n_shingles, component_id, node, label, row), one for every row of ``df``.

    ``node`` is the class of the row's set, ``label`` names its component; both are null for empty sets.
    ``row`` is the digest of key and text.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    sampled = stage(sets_of(df, key, text, width, True), "jaccard-sample")
    rows = stage(sampled.select("key", "row", "n", "node"), "jaccard-rows")
    rest = stage(_survivors(sampled, percent), "jaccard-rest")
    release(sampled)
    ids = rest.select("row").distinct()
    if rest.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = df.select(key, text).join(ids, _row(key, text) == F.col("row")).select(key, text)
    sets = sets_of(texts, key, text, width, False).join(rest.select("node"), "node", "left_semi")
    sets = stage(sets.dropDuplicates(["node"]).select("node", "n", "tokens"), "jaccard-sets")
    held = sets.select("node", "n", F.explode("tokens").alias("h"))
    counts = _numbered(held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ordered = held.join(counts, "h").groupBy("node").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h", "id"))).alias("common")
    ).withColumn("alone", F.col("n") - F.size("common"))
    ordered = stage(ordered.where(F.col("alone") < _prefix(F.col("n"), percent, 2)), "jaccard-ordered")
    release(sets)
    postings = stage(_postings(ordered, percent, _boundary(ordered, percent)), "jaccard-postings")
    labels = components(links(postings, ordered, percent))
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(least, "label").select("node", "label", "component_id")
    linked = rows.where("n > 0").select("key", "row", "n", "node").join(of_node, "node")
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").select(
        "key", "row", "n", none.alias("node"), none.alias("label"), F.col("key").alias("component_id")
    )
    return linked.select("key", "row", "n", "node", "label", "component_id").unionByName(empty).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "node", "label", "row"
    )


def one_of_each(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id. Rows with an empty set all stay."""
    groups = grouped(df, key, text, width, percent)
    chosen = groups.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.min(F.struct(F.col(key).isNull().alias("u"), F.col(key).alias("k"), "node", "row")).alias("c")
    ).select("c.row")
    worded = F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False))
    # Equal rows have one digest: one of them stays.
    digest = "row"
    while digest in df.columns:
        digest += "_"
    same = df.where(worded).withColumn(digest, _row(key, text))
    kept = same.join(chosen.withColumnRenamed("row", digest), digest, "left_semi").dropDuplicates([digest])
    return kept.select(*df.columns).unionByName(df.where(~worded))
