"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are the word 3-grams of the test items (shorter items: the whole
sequence). One pass over the corpus finds in every document the windows where
an item has two different seeds close together (one if it has no more), and
aligns each with its item word by word (match +1, mismatch and gap -1/2); the
best score over the number of words of the item is 1 for an exact copy and
falls with every edit. From ``THRESHOLD`` on the document is contaminated.
A window is aligned however many documents hold its seeds: an edited passage
has only part of them, and copies of it make that part frequent. Equal windows
of a slice of documents are aligned once.

Items are taken in blocks of at most ``BLOCK`` seeds, so what a worker holds
does not grow with the benchmark; every block sees every document.

Nulls and ties: null or empty texts and items without words match nothing; items
with a null id are left out;
documents that share an id are judged together and the repeated rows stay; a
null id is an id of its own; an empty table of documents gives an empty
result, one of items leaves all documents clean; whole texts are searched;
columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.common import python_workers, working

N = 3  # words of a seed
BLOCK = 500_000  # seeds of a block of items
THRESHOLD = 0.5
GAP = MISMATCH = 0.5
SLICE = 256  # documents handled at once

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Seeds:
    """Seeds of a block of items: sorted keys, and which items hold each."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items  # (item id, words)
        self.vocabulary: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        found: dict[int, list[int]] = {}
        self.of_item: list[list[int]] = []
        for i, (_, words) in enumerate(items):
            ids = np.array([self.vocabulary[w] for w in words], np.int64)
            n = min(N, len(ids))
            keys = sorted(set(self._keys(ids, n).tolist()))
            self.of_item.append(keys)
            for k in keys:
                found.setdefault(k, []).append(i)
        self.keys = np.array(sorted(found), np.int64)
        self.holders = [found[k] for k in self.keys.tolist()]
        self.lengths = sorted({min(N, len(w)) for _, w in items}, reverse=True)
        place = {k: p for p, k in enumerate(self.keys.tolist())}
        self.of_item = [[place[k] for k in keys] for keys in self.of_item]

    def _keys(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Keys of the n-grams at every position; 0 where a word is not of the items'."""
        if len(ids) < n:
            return np.zeros(0, np.int64)
        size = len(ids) - n + 1
        keys, known = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            part = ids[k:k + size]
            keys = keys * self.base + part
            known &= part > 0
        return np.where(known, keys, 0)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the words and the seeds there."""
        ids = np.fromiter(map(self.vocabulary.get, words, ZEROS), np.int64, len(words))
        at, seeds = [], []
        for n in self.lengths:
            keys = self._keys(ids, n)
            where = np.flatnonzero(keys)
            p = np.searchsorted(self.keys, keys[where])
            p[p == len(self.keys)] = 0
            right = self.keys[p] == keys[where] if len(self.keys) else np.zeros(0, bool)
            at.append(where[right])
            seeds.append(p[right])
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(seeds or [np.zeros(0, np.int64)])

    def windows(self, at: np.ndarray, seeds: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
        """(item, first word, end word) where seeds of an item stand within its length of each other.

        At least two different seeds are needed, one if the item has no more.
        """
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, s in sorted(zip(at.tolist(), seeds.tolist(), strict=True)):
            for i in self.holders[s]:
                by_item.setdefault(i, []).append((p, s))
        out = []
        for i, found in by_item.items():
            m = len(self.items[i][1])
            need = min(2, len(self.of_item[i]))
            begin = 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k][0] - found[k - 1][0] > m:
                    own = {s for _, s in found[begin:k]}
                    if len(own) >= need:
                        out.append((i, max(0, found[begin][0] - m), min(n_words, found[k - 1][0] + N + m)))
                    begin = k
        return out


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


ZEROS = _Zeros()


def align(a: np.ndarray, b: np.ndarray) -> float:
    """Best local alignment of two arrays of word numbers over the length of the first."""
    if not len(a) or not len(b):
        return 0.0
    ramp = GAP * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1), 0.0
    for x in a:
        fresh = np.zeros(len(b) + 1)
        fresh[1:] = np.maximum(row[:-1] + np.where(b == x, 1.0, -MISMATCH), row[1:] - GAP)
        np.maximum(fresh, 0, out=fresh)
        # Gaps along the row: the best start to the left, less a gap for every step.
        row = np.maximum.accumulate(fresh + ramp) - ramp
        best = max(best, float(row.max()))
    return best / len(a)


def align_words(item: list[str], window: list[str]) -> float:
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in window]))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words, in blocks of at most about ``BLOCK`` seeds."""
    rows = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    total = rows.agg(F.sum(F.size(F.split(text, r"\s+")))).first()[0] or 0
    blocks = total // BLOCK + 1
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == b)
        parsed = [(r[0], words_of(r[1])) for r in own.orderBy(key, text).toLocalIterator()]
        parsed = [x for x in parsed if x[1]]
        if parsed:
            yield parsed


def aligned(docs: DataFrame, seeds: Seeds, key: str, text: str) -> DataFrame:
    """Rows (key, item_id, score): the best score of every document and item with a window."""
    python_workers(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("decontamination")
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                rows = batch.slice(first, SLICE)
                source, item_ids, scores = [], [], []
                known: dict[tuple[int, str], float] = {}
                for i, t in enumerate(rows.column(1).to_pylist()):
                    words = words_of(t)
                    best: dict[int, float] = {}
                    for place, b, e in seeds.windows(*seeds.hits(words), len(words)):
                        item, own = seeds.items[place]
                        window = (place, " ".join(words[b:e]))
                        if window not in known:
                            known[window] = align_words(own, words[b:e])
                        best[item] = max(best.get(item, 0.0), known[window])
                    for item, s in best.items():
                        source.append(i)
                        item_ids.append(item)
                        scores.append(s)
                keys = rows.column(0).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(item_ids, pa.int64()), pa.array(scores, pa.float64())], ["key", "item_id", "score"]
                )

    return docs.select(key, text).mapInArrow(search, f"key {kind}, item_id long, score double")


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (key, item_id, score): every document and item with a window, with the best score."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    parts = [aligned(docs, Seeds(block), key, text) for block in _blocks(items, item_key, item_text)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, item_id {item_kind}, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.col("key").alias(key), "item_id").agg(F.max("score").alias("score"))


def judged(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Add to every document ``contaminated``, the best ``score`` and the ``item_ids`` at or over the threshold."""
    found = matches(docs, items, key, text)
    per_doc = found.groupBy(F.col(key).alias("_key")).agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_set(F.when(F.col("score") >= threshold, F.col("item_id")))).alias("item_ids"),
    )
    rows = docs.drop("contaminated", "score", "item_ids")
    return rows.join(per_doc, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        *rows.columns,
        (F.coalesce("score", F.lit(0.0)) >= threshold).alias("contaminated"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )
