"""Boosted trees for a 0/1 label, grown from histograms.

The method is that of Spark ML's boosted classifier: the first tree is fitted to
the label as -1 and 1, each later one to the negative gradient of the logistic
loss, by variance, on a random part of the rows. The result is a model of Spark
ML; only the growing is done here, because there each round costs several
microseconds a row.

1. Values become bin numbers, once, at exact quantiles of all rows (at every
   value of a column with few). Columns share keys of 16 bits, each with bits of
   its own. Rows are packed into blocks, which are dealt out evenly and kept, at
   9 bytes a row and 2 a key. They are kept as an RDD, whose bytes go to Python
   as they are and without a plan for each of the many passes.
2. A level of a tree is one pass. Each task picks the drawn rows of the smaller
   child of each split, works out the gradients of these alone, and counts rows
   and gradients per key; the other child is the difference.
3. A pass returns one histogram a task, some 10 kB a node whatever the rows. The
   best split of each node is read off their sum.
4. Blocks know their margins up to some rounds ago and add the trees since; from
   time to time the margins are written into the blocks.
5. Few rows (``ALONE``) are one task's work: it grows all trees in one job, by
   the same passes over the same blocks.

Ties: the first column, then the lowest threshold. The rows of a round are drawn
by block and round, so equal inputs in equal partitions give equal trees.
Impurities of nodes are not kept (-1, as Spark ML marks them).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetwear.session import python_workers, scratch_path

BLOCK = 1 << 15  # rows
KEY_BITS = 15  # of the columns under one key
GATHERED = 1 << 17  # rows counted at a time
ROWS_A_TASK = 1 << 22  # at most: a pass costs every task some 50 ms besides its rows
ALONE = 1 << 19  # rows up to which one task grows the trees by itself
MERGE = 10  # rounds after which margins are written into the blocks
NOISE = 1e-12  # gain, or difference of two, that is rounding

BLOCKS = "part int, seq int, n int, keys binary, y binary"
_FIELDS = ["part", "seq", "n", "keys", "y"]
_KINDS = [pa.int32()] * 3 + [pa.binary()] * 2


@dataclass(frozen=True)
class Settings:
    """What a fit is told."""

    rounds: int
    depth: int
    step: float
    leaf: int
    sample: float
    seed: int

    def weight(self, tree: int) -> float:
        return 1.0 if tree == 0 else self.step


@dataclass(frozen=True)
class Keys:
    """Which key holds a column's bin number, and from which bit on in how many."""

    sizes: tuple[int, ...]
    groups: tuple[tuple[int, ...], ...]
    at: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(sizes: Sequence[int]) -> Keys:
        """Columns are dealt to keys by falling width, each to the first with room."""
        bits = [(n - 1).bit_length() for n in sizes]
        groups: list[list[int]] = []
        at: list[tuple[int, int, int]] = [(0, 0, 0)] * len(bits)
        for c in sorted(range(len(bits)), key=lambda c: -bits[c]):
            used = [sum(bits[x] for x in g) for g in groups]
            g = next((i for i, n in enumerate(used) if n + bits[c] <= KEY_BITS), len(groups))
            if g == len(groups):
                groups.append([])
                used.append(0)
            groups[g].append(c)
            at[c] = (g, used[g], bits[c])
        return Keys(tuple(sizes), tuple(map(tuple, groups)), tuple(at))

    def packed(self, bins: Iterable[np.ndarray], n: int) -> np.ndarray:
        keys = np.zeros((len(self.groups), n), np.uint16)
        for (g, shift, _), own in zip(self.at, bins, strict=True):
            keys[g] |= own.astype(np.uint16) << np.uint16(shift)
        return keys

    def above(self, keys: np.ndarray, column: int, at: int) -> np.ndarray:
        """Rows whose bin number of a column is larger."""
        g, shift, bits = self.at[column]
        mask = np.uint16(((1 << bits) - 1) << shift)
        return (keys[g] & mask) > np.uint16(at << shift)

    def per_column(self, totals: list[np.ndarray]) -> np.ndarray:
        """Totals per key (two measures each) to totals per column and bin."""
        out = np.zeros((2, len(self.sizes), max(self.sizes)))
        for g, total in zip(self.groups, totals, strict=True):
            cube = total.reshape(2, *[1 << self.at[c][2] for c in reversed(g)])
            for i, c in enumerate(reversed(g)):
                out[:, c, : self.sizes[c]] = cube.sum(axis=tuple(1 + j for j in range(len(g)) if j != i))[:, : self.sizes[c]]
        return out


def _either(by: np.ndarray, no: np.ndarray | None, yes: np.ndarray | None) -> np.ndarray | None:
    """Per row one of two flags; None stands for False."""
    if no is None:
        return None if yes is None else yes & by
    return no & ~by if yes is None else no ^ ((no ^ yes) & by)


class Tree:
    """A tree by places: the children of place p are 2 p + 1 and 2 p + 2; ``column`` is -1 where nothing is split."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.depth = depth
        self.column = np.full(size, -1, np.int64)
        self.bin = np.zeros(size, np.int64)
        self.gain = np.zeros(size)
        self.n = np.zeros(size, np.int64)
        self.total = np.zeros(size)

    def places(self, rows: np.ndarray, keys: Keys, levels: int) -> np.ndarray:
        """Numbers of the rows' nodes on a level; below a leaf, rows go left."""
        at = np.zeros(rows.shape[1], np.uint8)
        turns: list[np.ndarray] = []
        for level in range(levels):
            first = (1 << level) - 1
            right = [
                keys.above(rows, int(self.column[p]), int(self.bin[p])) if self.column[p] >= 0 else None
                for p in range(first, 2 * first + 1)
            ]
            for by in reversed(turns):
                right = [_either(by, *right[i : i + 2]) for i in range(0, len(right), 2)]
            turn = np.zeros(len(at), bool) if right[0] is None else right[0]
            turns.append(turn)
            at = (at << 1) | turn
        return at

    def values(self) -> np.ndarray:
        """Predictions of the places on the last level; those below a leaf have its own."""
        own = self.total / np.maximum(self.n, 1)
        for p in range(len(self.column) // 2):
            if self.column[p] < 0:
                own[2 * p + 1] = own[2 * p + 2] = own[p]
        return own[len(self.column) // 2:]


def _pack(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], keys: Keys) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows (columns, then label)."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block(at: int, parts: list) -> pa.RecordBatch:
        rows, y = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        row = (part, at, len(y), rows.tobytes(), y.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], _FIELDS)

    for batch in batches:
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bins = (np.searchsorted(t, v, "left") for t, v in zip(cuts, values, strict=False))
        held.append((keys.packed(bins, batch.num_rows), np.where(values[-1] > 0, 1, -1).astype(np.int8)))
        size += batch.num_rows
        if size >= BLOCK:
            yield block(seq, held)
            seq, held, size = seq + 1, [], 0
    if size:
        yield block(seq, held)


_Added = list[tuple[np.ndarray, Tree]]  # trees that stored margins lack, with the values of their places


def _gained(rows: np.ndarray, keys: Keys, added: _Added) -> np.ndarray | float:
    """What trees add to the margins of rows; two trees are looked up at a time."""
    total: np.ndarray | float = 0.0
    for i in range(0, len(added), 2):
        (leaves, tree), *more = added[i : i + 2]
        at = tree.places(rows, keys, tree.depth)
        for other, second in more:
            if tree.depth + second.depth > 8:
                total = total + other.take(second.places(rows, keys, second.depth))
            else:
                at = (at << second.depth) | second.places(rows, keys, second.depth)
                leaves = np.add.outer(leaves, other).ravel()
        total = total + leaves.take(at)
    return total


class _Block:
    """Some rows of a task: keys, label as -1 and 1, margin."""

    def __init__(self, record: tuple):
        part, seq, rows, y, margin = record
        self.name = (part, seq)
        self.y = np.frombuffer(y, np.int8)
        self.rows = np.frombuffer(rows, np.uint16).reshape(-1, len(self.y))
        self.margin = np.frombuffer(margin)

    def add(self, keys: Keys, added: _Added) -> None:
        self.margin = self.margin + _gained(self.rows, keys, added)

    def drawn(self, number: int, told: Settings) -> np.ndarray:
        """The rows of a round."""
        if told.sample >= 1:
            return np.ones(len(self.y), bool)
        raw = np.random.SFC64([told.seed, number, *self.name]).random_raw(-(-len(self.y) // 4))
        return raw.astype("<u8").view("<u2")[: len(self.y)] < round(told.sample * (1 << 16))

    def picked(self, at: np.ndarray, number: int, keys: Keys, added: _Added) -> tuple[np.ndarray, np.ndarray]:
        """Keys and gradients of the rows at some positions."""
        rows, sign = self.rows.take(at, axis=1), self.y.take(at).astype(np.float64)
        if number == 0:
            return rows, sign
        margin = self.margin.take(at) + _gained(rows, keys, added)
        return rows, 4 * sign / (1 + np.exp(2 * sign * margin))

    def record(self) -> tuple:
        return *self.name, self.rows.tobytes(), self.y.tobytes(), self.margin.tobytes()


class _Totals:
    """Rows and gradients of one node, counted per key."""

    def __init__(self, keys: Keys):
        self.keys = keys
        self.found = [np.zeros((2, 1 << sum(keys.at[c][2] for c in g))) for g in keys.groups]
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, want: np.ndarray) -> None:
        self.held.append((rows, want))
        self.size += len(want)
        if self.size >= GATHERED:
            self.count()

    def count(self) -> None:
        if self.held:
            want = np.concatenate([w for _, w in self.held])
            for g, total in enumerate(self.found):
                key = np.concatenate([rows[g] for rows, _ in self.held]).astype(np.intp)
                total[0] += np.bincount(key, minlength=total.shape[1])
                total[1] += np.bincount(key, want, total.shape[1])
            self.held, self.size = [], 0

    def per_column(self) -> np.ndarray:
        self.count()
        return self.keys.per_column(self.found)


def _count(
    blocks: Iterable[_Block], tree: Tree, level: int, wanted: list[int], number: int, keys: Keys, told: Settings, added: _Added
) -> np.ndarray:
    """Of the wanted nodes of a level, per column and bin: the drawn rows, and the sum of their gradients."""
    totals = [_Totals(keys) for _ in wanted]
    for block in blocks:
        drawn = block.drawn(number, told)
        at = tree.places(block.rows, keys, level)
        for k, total in zip(wanted, totals, strict=True):
            total.add(*block.picked(np.flatnonzero(drawn & (at == k) if level else drawn), number, keys, added))
    return np.stack([t.per_column() for t in totals], axis=1)


def _best(counts: np.ndarray, least: int) -> tuple[int, int, float]:
    """(column, bin, gain) of the best split of one node; column -1 if none gains."""
    left = counts.cumsum(axis=-1)[:, :, :-1]
    n, total = counts.cumsum(axis=-1)[:, 0, -1]
    right_n, right = n - left[0], total - left[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[1] ** 2 / left[0] + right ** 2 / right_n - total ** 2 / n) / n
    gain[(left[0] < least) | (right_n < least)] = -1
    if not gain.size or gain.max() <= NOISE:
        return -1, 0, 0.0
    column, at = divmod(int((gain >= gain.max() - NOISE).argmax()), gain.shape[1])
    return column, at, float(gain[column, at])


def _grow(passed: Callable[[Tree, int, list[int]], np.ndarray], told: Settings) -> Tree:
    """One tree, a pass a level: ``passed`` is ``_count`` over all rows."""
    tree, counts = Tree(told.depth), {}
    wanted = [0]
    for level in range(told.depth):
        first = (1 << level) - 1
        if wanted:
            found = passed(tree, level, wanted)
            for i, k in enumerate(wanted):
                counts[first + k] = found[:, i]
                if level:
                    other = first + (k ^ 1)
                    counts[other] = counts[(other - 1) // 2] - found[:, i]
        wanted = []
        for p in range(first, 2 * first + 1):
            if p not in counts:
                continue
            here = counts[p]
            if not level:
                whole = here.cumsum(axis=-1)[:, 0, -1]
                tree.n[p], tree.total[p] = round(whole[0]), whole[1]
            column, at, gain = _best(here, told.leaf)
            if column < 0:
                continue
            tree.column[p], tree.bin[p], tree.gain[p] = column, at, gain
            left = here[:, column].cumsum(axis=-1)[:, at]
            tree.n[2 * p + 1], tree.total[2 * p + 1] = round(left[0]), left[1]
            tree.n[2 * p + 2], tree.total[2 * p + 2] = tree.n[p] - round(left[0]), tree.total[p] - left[1]
            wanted.append(2 * (p - first) + int(2 * left[0] > tree.n[p]))
    return tree


def grow(train: DataFrame, cols: Sequence[str], label: str, cuts: dict[str, list[float]], rows: int, told: Settings) -> list[Tree]:
    """The trees, on rows without nulls."""
    if not rows:
        raise ValueError("no rows to learn from")
    spark = train.sparkSession
    python_workers(spark)
    at = [np.array(cuts[c], np.float64) for c in cols]
    keys = Keys.of([len(t) + 1 for t in at])
    own = train.select(*[F.col(c).cast("double") for c in cols], F.col(label).cast("double"))
    cores = spark.sparkContext.defaultParallelism
    tasks = 1 if rows <= ALONE else min(-(-rows // BLOCK), -(-rows // (ROWS_A_TASK * cores)) * cores)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, at, keys)

    def ordered(blocks: Iterable[Row]) -> list[tuple]:
        found = [(b["part"], b["seq"], bytes(b["keys"]), bytes(b["y"]), bytes(8 * b["n"])) for b in blocks]
        return sorted(found, key=lambda r: r[:2])

    dealt = own.mapInArrow(packed, BLOCKS).repartition(tasks).rdd.mapPartitions(ordered)
    if tasks > 1:
        return _passes(dealt, keys, told)
    return dealt.mapPartitions(lambda records: _alone(records, keys, told)).collect()


def _alone(records: Iterable[tuple], keys: Keys, told: Settings) -> Iterator[Tree]:
    """The trees from rows that are all in one task."""
    blocks = [_Block(r) for r in records]
    for number in range(told.rounds):
        def passed(tree: Tree, level: int, wanted: list[int], number: int = number) -> np.ndarray:
            return _count(blocks, tree, level, wanted, number, keys, told, [])

        tree = _grow(passed, told)
        yield tree
        for block in blocks:
            block.add(keys, [(told.weight(number) * tree.values(), tree)])


def _passes(dealt: RDD, keys: Keys, told: Settings) -> list[Tree]:
    """The trees from rows in many tasks, a job a level."""
    blocks = dealt.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    trees: list[Tree] = []
    added: _Added = []
    try:
        for number in range(told.rounds):
            def passed(tree: Tree, level: int, wanted: list[int], number: int = number) -> np.ndarray:
                def counted(records: Iterable[tuple]) -> Iterator[np.ndarray]:
                    yield _count(map(_Block, records), tree, level, wanted, number, keys, told, added)

                return sum(blocks.mapPartitions(counted).collect())  # in the order of the tasks

            tree = _grow(passed, told)
            trees.append(tree)
            added = [*added, (told.weight(number) * tree.values(), tree)]
            if len(added) == MERGE and number + 1 < told.rounds:
                def settled(records: Iterable[tuple], added: _Added = added) -> Iterator[tuple]:
                    for block in map(_Block, records):
                        block.add(keys, added)
                        yield block.record()

                older, blocks = blocks, blocks.mapPartitions(settled).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                blocks.count()
                older.unpersist()
                added = []
    finally:
        blocks.unpersist()
    return trees


_NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,
  gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def _stored(number: int, tree: Tree, cuts: list[list[float]]) -> list[tuple]:
    """The nodes of a tree in the order of Spark ML: a node, its left side, its right side."""
    out: list[tuple] = []

    def add(p: int) -> int:
        at, c = len(out), int(tree.column[p])
        out.append(())
        n, total = int(tree.n[p]), float(tree.total[p])
        known = (at, total / max(n, 1), -1.0, [float(n), total, float("nan")], n)
        if c < 0:
            out[at] = (number, (*known, -1.0, -1, -1, (-1, [], -1)))
        else:
            left, right = add(2 * p + 1), add(2 * p + 2)
            out[at] = (number, (*known, float(tree.gain[p]), left, right, (c, [cuts[c][tree.bin[p]]], -1)))
        return at

    add(0)
    return out


def as_model(
    trees: list[Tree], cols: Sequence[str], label: str, cuts: dict[str, list[float]], settings: Settings, spark: SparkSession
) -> GBTClassificationModel:
    """The trees as a model of Spark ML, by way of its stored form; at most rounds x 2^(depth + 1) rows."""
    path = scratch_path(spark, "grown")
    at = [cuts[c] for c in cols]
    shared = {"labelCol": label, "maxDepth": settings.depth, "minInstancesPerNode": settings.leaf, "seed": settings.seed}
    defaults = {
        "featuresCol": "features", "predictionCol": "prediction", "leafCol": "", "impurity": "variance", "minInfoGain": 0.0,
        "minWeightFractionPerNode": 0.0, "maxBins": 32, "maxMemoryInMB": 256, "cacheNodeIds": False, "checkpointInterval": 10,
    }

    def told(name: str, params: dict, preset: dict, **more: int) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": f"grown_{uuid.uuid4().hex[:12]}", "paramMap": params, "defaultParamMap": preset, **more,
        })

    whole = told(
        "classification.GBTClassificationModel",
        {**shared, "maxIter": settings.rounds, "stepSize": settings.step, "subsamplingRate": settings.sample},
        {**defaults, "probabilityCol": "probability", "rawPredictionCol": "rawPrediction", "lossType": "logistic",
         "featureSubsetStrategy": "all", "validationTol": 0.01},
        numFeatures=len(cols), numTrees=len(trees),
    )
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    nodes = [row for i, tree in enumerate(trees) for row in _stored(i, tree, at)]
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    each = [(i, told("regression.DecisionTreeRegressionModel", shared, defaults), settings.weight(i)) for i in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return GBTClassificationModel.load(path)
