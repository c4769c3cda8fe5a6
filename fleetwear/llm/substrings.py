"""Removal of byte strings that occur more than once, by sorting suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere
else, in the same document or another, is removed. Matches never cross documents.

1. Anchors: of all grams of 64 bytes whose starts fit in a string of ``LENGTH``
   bytes, the one with the least hash is an anchor. Equal strings have their
   anchors at equal places, so two places of one string meet in an anchor, and
   only suffixes that begin at anchors need sorting: about one in 170.
2. Counts per anchor gram leave only grams that occur twice. Where all of a
   gram's occurrences have the same surroundings, as far as a string through
   the anchor can reach, all of it repeats. That is most of what copies share,
   and it is combined before any shuffle.
3. Of grams with several surroundings one place of each is read again, and the
   suffixes that begin there are sorted the deep-shallow way: word by word
   where they still tie (multikey sorting) to a shallow depth, then each group
   with a longer common prefix by a blind trie. Neighbours' common prefixes
   give classes of equal right parts for every depth, and rolling hashes
   classes of equal left parts; places in both of a class repeat.
   Grams with over ``SPLIT`` surroundings are split: a string reaches far to the
   left or to the right of its anchor, so equal ones share the bytes of one side,
   and their hash parts the group. A part that is still over ``LARGEST`` is not
   gathered in one task: hashes of its strings are counted instead.
4. The runs go back to all documents with the same text.

Texts move between tasks only where their bytes are needed beside another table:
those with a place that is read again, and those that lose bytes. A bitmap of
``BITS`` bits (4 MB, whatever the corpus) over their ids is sent to the tasks
that read the texts; the others are finished there. Bits that fall together
move a text for nothing and change no result. What is staged on the way is
deleted as soon as the next table is written.

Nulls and ties: a null text counts as empty; equal rows have equal results and
repeat each other; texts shorter than ``LENGTH`` lose nothing; an empty table
gives an empty result; texts are taken whole, in slabs of bounded memory; other
columns are ignored. A text is known by a 64-bit hash and its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.common import python_workers, whole_text
from fleetwear.llm.shingles import BASE, INVERSE, mix, powers
from fleetwear.session import release, stage

LENGTH = 400
GRAM = 64
SLAB = 1 << 17
SHALLOW = 32  # bytes after the gram that are sorted word by word
SPLIT = 2048  # surroundings of a gram that are not split by side
LARGEST = 32_768  # of a part handled in one task: about 150 MB there
GATHER = 4096  # suffixes sorted together
BITS, PAGE = 1 << 25, 1 << 15  # of the bitmap of text ids, and of a part of it
VALUES = np.random.Generator(np.random.PCG64(977)).integers(0, 1 << 64, 256, np.uint64)


def _windowed(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over every window, from running values inside blocks of the window's width."""
    n = len(values)
    size = -(-n // width) * width
    padded = np.full(size, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1: n])


class Hashes:
    """Hashes of any part of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * powers(INVERSE, len(self.sums))[begin]
        return mix(raw + (end - begin).astype(np.uint64))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Places of the anchors of one text, gram hashes, hashes of the surroundings, and how far those reach left and right."""
    n, width = len(data), length - gram + 1
    reach = length - gram
    out = []
    for first in range(0, max(n - length, 0) + 1, SLAB) if n >= length else ():
        # Anchors whose place is in [first, first + SLAB), judged with the bytes around.
        lo, hi = max(0, first - length), min(n, first + SLAB + 2 * length)
        slab = data[lo:hi]
        hashes = Hashes(slab)
        at = np.arange(len(slab) - gram + 1)
        grams = hashes.part(at, at + gram)
        least = _windowed(grams, width, np.minimum, np.iinfo(np.uint64).max)
        # A gram is an anchor if it is the least of a window around it: the
        # largest of those windows' minima is then its own hash.
        around = np.zeros(len(grams) + width - 1, np.uint64)
        around[width - 1: width - 1 + len(least)] = least
        place = np.flatnonzero(_windowed(around, width, np.maximum, 0)[: len(grams)] == grams)
        last = first + SLAB if first + SLAB <= max(n - length, 0) else n
        place = place[(place + lo >= first) & (place + lo < last)]
        left = np.minimum(place + lo, reach)
        right = np.minimum(n - (place + lo) - gram, reach)
        whole = hashes.part(place - left, place + gram + right) ^ mix((left * 4096 + right).astype(np.uint64))
        out.append((place + lo, grams[place], whole, left, right))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """From (id, text): rows (id, gram, around, place, left, right)."""
    python_workers(texts.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = anchors(np.frombuffer(t.as_buffer(), np.uint8))
                ids.append(np.full(len(parts[0]), i, np.int64))
                held.append(parts)
                size += len(parts[0])
                if size > 50_000:
                    yield joined(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield joined(ids, held)

    def joined(ids: list, held: list) -> pa.RecordBatch:
        place, gram, around, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(ids)), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)),
             pa.array(place, pa.int64()), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
            ["id", "gram", "around", "place", "left", "right"],
        )

    return texts.mapInArrow(found, "id long, gram long, around long, place long, left int, right int")


class BlindTrie:
    """Orders byte strings of equal length that share a long prefix.

    Inner nodes hold only the depth where their strings part. A string goes down
    by those bytes alone, is compared once with a leaf it reaches, and is hung
    in at the first difference.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), {}, [i]]
            return
        node = self.root
        while node[1]:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        if s == other:
            node[2].append(i)
            return
        depth = _common(s, other)
        parent, node = None, self.root
        while node[1] and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        leaf = [len(s), {}, [i]]
        if node[1] and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        fork = [depth, {other[depth]: node, s[depth]: leaf}, []]
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[1]:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node[2])
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of equal length."""
    lo, hi = 0, len(a)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo:hi] != b[lo:hi] else hi


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of byte rows by (group, bytes)."""
    m, width = rows.shape
    order = np.argsort(group, kind="stable")
    new = np.concatenate(([True], group[order][1:] != group[order][:-1])) if m else np.zeros(0, bool)
    for at in range(0, min(shallow, width), 8):
        run = np.cumsum(new)
        tied = np.bincount(run)[run] > 1
        if not tied.any():
            return order
        words = np.zeros((m, 8), np.uint8)
        part = rows[order, at:at + 8]
        words[:, : part.shape[1]] = part
        word = words.view(">u8").ravel()
        again = np.flatnonzero(tied)
        by = again[np.lexsort((word[again], run[again]))]
        order[again], word[again] = order[by], word[by]
        new[1:] |= word[1:] != word[:-1]
    run = np.cumsum(new)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], m)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie([rows[i].tobytes() for i in order[a:b]])
            for i in range(b - a):
                trie.add(i)
            order[a:b] = order[a:b][trie.order()]
    return order


def repeated(
    group: np.ndarray, count: np.ndarray, contexts: np.ndarray, left: np.ndarray, right: np.ndarray,
    least: np.ndarray, most: np.ndarray,
) -> np.ndarray:
    """For surroundings of anchors, whether the string that starts 0, 1, ... bytes before the anchor repeats.

    Only starts of ``least`` to ``most`` bytes before the anchor are looked at.

    ``contexts``: bytes from ``reach`` before the anchor to ``reach`` after its gram, filled up with zeros.
    """
    reach = LENGTH - GRAM
    m = len(group)
    suffixes = np.ascontiguousarray(contexts[:, reach:])
    order = deep_shallow(group, suffixes[:, GRAM:])
    ordered, groups = suffixes[order], group[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common[groups[1:] != groups[:-1]] = -1
    left, right, count, least, most = (x[order] for x in (left, right, count, least, most))
    prefix = np.zeros(m, np.uint64)  # hash of the bytes to the left so far
    out = np.zeros((m, reach + 1), bool)
    for d in range(reach + 1):
        if d:
            prefix = prefix * np.uint64(BASE) + VALUES[contexts[order, reach - d]]
        fits = np.flatnonzero((left >= d) & (right >= reach - d) & (least <= d) & (most >= d))
        if not len(fits):
            continue
        same = np.concatenate(([0], np.cumsum(common < LENGTH - d)))
        key = mix(prefix + mix(same.astype(np.uint64)))[fits]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        twice = count[fits] > 1
        twice[by[1:][equal]] = True
        twice[by[:-1][equal]] = True
        out[order[fits], d] = twice
    return out


def covered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``repeated`` with any string, and the first and end byte they cover, relative to the anchor.

    All strings hold the anchor, so what they cover is one run.
    """
    rows = np.flatnonzero(found.any(axis=1))
    first = found[rows].argmax(axis=1)
    last = found.shape[1] - 1 - found[rows][:, ::-1].argmax(axis=1)
    return rows, -last, LENGTH - first


def _contexts(texts: DataFrame) -> DataFrame:
    """From (id, text, wanted: places with gram, around, n): rows with the bytes around each place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = LENGTH - GRAM
        for batch in batches:
            out: list[tuple] = []
            for t, wanted in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                for w in wanted:
                    p = w["place"]
                    context = data[max(0, p - reach): p + GRAM + reach]
                    out.append((w["gram"], w["around"], w["n"], w["m"], w["left"], w["right"], context))
                if len(out) > 5000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
            ["gram", "around", "n", "m", "left", "right", "context"],
        )

    return texts.mapInArrow(cut, "gram long, around long, n long, m long, left int, right int, context binary")


def _filled(contexts: list[bytes], left: np.ndarray) -> np.ndarray:
    reach = LENGTH - GRAM
    out = np.zeros((len(contexts), LENGTH + reach), np.uint8)
    for i, (c, k) in enumerate(zip(contexts, left.tolist(), strict=True)):
        out[i, reach - k: reach - k + len(c)] = np.frombuffer(c, np.uint8)
    return out


WIDE = "key long, gram long, around long, n long, least int, most int, left int, right int, context binary"
COVER = "gram long, around long, b int, e int"


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows once for strings that reach far to the left, once for the others; the bytes of that side are in the key."""
    reach = LENGTH - GRAM
    half = reach // 2
    for batch in batches:
        out = []
        for gram, around, n, _, left, right, context in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = np.frombuffer(context, np.uint8)
            ends = [left - half, left + GRAM] if left >= half else [0, 0]
            later = [left, left + GRAM + reach - half] if right >= reach - half else [0, 0]
            h = Hashes(data).part(np.array([ends[0], later[0]]), np.array([ends[1], later[1]])).view(np.int64).tolist()
            if left >= half:
                out.append((h[0], gram, around, n, half, reach, left, right, context))
            if right >= reach - half:
                out.append((h[1] ^ 1, gram, around, n, 0, half - 1, left, right, context))
        if out:
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["key", "gram", "around", "n", "least", "most", "left", "right", "context"],
            )


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a sorted partition at a time; equal surroundings that come twice count once."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        key, gram, around, n, least, most, left, right = (np.array([r[i] for r in rows], np.int64) for i in range(8))
        found = repeated(key, n, _filled([r[8] for r in rows], left), left, right, least, most)
        which, b, e = covered(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[which]), pa.array(around[which]), pa.array(b, pa.int32()), pa.array(e, pa.int32())],
            ["gram", "around", "b", "e"],
        )

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][0] != row[0] and len(held) >= GATHER:
                yield done(held)
                held = []
            if not held or held[-1][:3] != row[:3]:
                held.append(row)
    if held:
        yield done(held)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, gram, around, n, d, h): hashes of all strings through the anchor, for the largest parts."""
    reach = LENGTH - GRAM
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            key, gram, around, n, least, most, left, right, context = row
            d = np.arange(max(0, reach - right, least), min(left, most) + 1)
            if len(d):
                start = left - d
                h = Hashes(np.frombuffer(context, np.uint8)).part(start, start + LENGTH)
                same = [pa.array(np.full(len(d), x)) for x in (key, gram, around, n)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(d.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "gram", "around", "n", "d", "h"]
                )


def _largest(parts: DataFrame) -> DataFrame:
    """The same result as ``_sorted_groups`` by counting hashes, with no group in one task."""
    once = parts.dropDuplicates(["key", "gram", "around"])
    rows = once.mapInArrow(_string_hashes, "key long, gram long, around long, n long, d int, h long")
    twice = rows.groupBy("key", "d", "h").agg(F.sum("n").alias("t")).where("t > 1").select("key", "d", "h")
    return rows.join(twice, ["key", "d", "h"]).select(
        "gram", "around", (-F.col("d")).alias("b"), (LENGTH - F.col("d")).cast("int").alias("e")
    )


def _covers(contexts: DataFrame, split: bool) -> DataFrame:
    """Staged rows (gram, around, b, e): what repeats around the anchors, relative to them."""
    whole = contexts.where(F.col("m") <= SPLIT).select(
        F.col("gram").alias("key"), "gram", "around", "n", F.lit(0).alias("least"), F.lit(LENGTH - GRAM).alias("most"),
        "left", "right", "context",
    )
    if not split:
        return stage(_sort(whole), "substring-covers")
    parts = stage(contexts.where(F.col("m") > SPLIT).mapInArrow(_sides, WIDE), "substring-sides")
    sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGEST).select("key")
    found = _sort(whole.unionByName(parts.join(sizes, "key", "left_anti")))
    if not sizes.isEmpty():
        found = found.unionByName(_largest(parts.join(sizes, "key", "left_semi")))
    covers = stage(found.groupBy("gram", "around").agg(F.min("b").alias("b"), F.max("e").alias("e")), "substring-covers")
    release(parts)
    return covers


def _sort(rows: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in WIDE.split(", ")]
    return (
        rows.select(*names).repartition("key").sortWithinPartitions("key", "gram", "around").mapInArrow(_sorted_groups, COVER)
    )


def _merged(runs: Column) -> Column:
    """Disjoint maximal runs of sorted ones."""
    empty = F.array().cast("array<struct<b:bigint,e:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["b"].alias("b"), F.greatest(last["e"], x["e"]).alias("e"))),
        )
        fresh = F.concat(acc, F.array(F.struct(x["b"].alias("b"), x["e"].alias("e"))))
        return F.when(F.size(acc) == 0, fresh).when(x["b"] <= last["e"], grown).otherwise(fresh)

    return F.aggregate(runs, empty, step)


def among(texts: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Texts whose bit is set by one of ``ids`` (``left_anti``: the others), without moving any text."""
    bit = F.col("id").bitwiseAND(F.lit(BITS - 1))
    pages = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.col("bit") % PAGE).alias("bits")
    )
    byte = F.substring("bits", (F.floor(bit % PAGE / 8) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
    return texts.join(F.broadcast(pages), (F.floor(bit / PAGE) == F.col("page")) & is_set, how)


def repeated_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Staged rows (id, runs): for the texts that lose bytes, known by ``text_id``, the runs in bytes."""
    texts = df.select(text_id(text).alias("id"), whole_text(text).cast("binary").alias("text")).where(
        F.octet_length("text") >= LENGTH
    )
    found = stage(anchor_rows(texts), "substring-anchors")
    grams = stage(
        found.groupBy("gram").agg(
            F.count(F.lit(1)).alias("c"), F.min("around").alias("lo"), F.max("around").alias("hi")
        ).where("c > 1").select("gram", (F.col("lo") == F.col("hi")).alias("alike")),
        "substring-grams",
    )
    shared = stage(found.join(grams, "gram"), "substring-shared")
    release(found)
    release(grams)
    alike = shared.where("alike").where(F.col("left") + GRAM + F.col("right") >= LENGTH).select(
        "id", (F.col("place") - F.col("left")).alias("b"), (F.col("place") + GRAM + F.col("right")).alias("e")
    )
    classes = shared.where("not alike").groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place", "left", "right")).alias("one")
    )
    classes = stage(classes, "substring-classes")
    sizes = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    wanted = stage(
        classes.join(sizes, "gram").groupBy(F.col("one.id").alias("id")).agg(
            F.collect_list(F.struct("gram", "around", "n", "m", "one.place", "one.left", "one.right")).alias("wanted")
        ),
        "substring-wanted",
    )
    split = not sizes.where(F.col("m") > SPLIT).isEmpty()
    release(classes)
    contexts = _contexts(among(texts, wanted).join(wanted, "id").select("id", "text", "wanted"))
    if split:
        contexts = stage(contexts, "substring-contexts")
    covers = _covers(contexts, split)
    release(wanted)
    if split:
        release(contexts)
    mixed = shared.where("not alike").join(covers, ["gram", "around"]).select(
        "id", (F.col("place") + F.col("b")).alias("b"), (F.col("place") + F.col("e")).alias("e")
    )
    each = alike.unionByName(mixed).distinct()
    runs = stage(
        each.groupBy("id").agg(_merged(F.sort_array(F.collect_list(F.struct("b", "e")))).alias("runs")), "substring-removed"
    )
    release(shared)
    release(covers)
    return runs


def text_id(text: str = "text") -> Column:
    return F.xxhash64(whole_text(text), F.octet_length(whole_text(text)))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, removed: runs in bytes, kept: remaining bytes)."""
    runs = repeated_runs(df, text)
    docs = df.select(key, whole_text(text).cast("binary").alias("_text"), text_id(text).alias("id"))
    untouched = among(docs, runs, "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    joined = among(docs, runs).join(runs, "id", "left").unionByName(untouched)
    removed = F.coalesce("runs", F.array().cast("array<struct<b:bigint,e:bigint>>"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<b:bigint,e:bigint>>").alias("gaps"))

    def gap(acc: Column, x: Column) -> Column:
        piece = F.struct(acc["at"].alias("b"), x["b"].alias("e"))
        return F.struct(x["e"].alias("at"), F.concat(acc["gaps"], F.array(piece)).alias("gaps"))

    gaps = F.aggregate("removed", start, gap, lambda acc: F.concat(
        acc["gaps"], F.array(F.struct(acc["at"].alias("b"), F.octet_length("_text").cast("long").alias("e")))
    ))
    kept = F.aggregate(
        gaps, F.lit(b""),
        lambda acc, x: F.concat(acc, F.substring(F.col("_text"), (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int"))),
    )
    return joined.withColumn("removed", removed).select(
        key,
        F.octet_length("_text").cast("long").alias("n_bytes"),
        "removed",
        F.when(F.size("removed") == 0, F.col("_text")).otherwise(kept).alias("kept"),
    )
