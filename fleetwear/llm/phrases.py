"""Phrase collocation mining by HAT-trie counting.

Phrases are counted level by level: words, then pairs, then triples. In a task
the words of a text become ids, and a trie over the ids holds the counts: the
first word leads to a hash container, which bursts into one container for each
second word when it grows too large. When the trie holds too much, subtrees are
spilled whole, as runs sorted by their words: those whose phrases have recurred
least, as they gain least from staying. Runs are dealt out by prefix and added up
there. A first word is 64 prefixes, told apart by its other words, so a frequent
one is spread over partitions; a phrase that is in every run has one row a run.

A phrase can be frequent only if the phrases in it are. The frequent phrases of
a level are written into a bitmap of ``BITS`` bits (16 MB, whatever the corpus),
and the next level counts only phrases both of whose parts have their bit. Bits
that fall together let a phrase through that is then found to be rare: they
cost time, never results. Counts of words are complete.

Scores are exact: ``a * a * 1000000 / (l * r)`` in decimals of 38 digits,
enough for phrases that occur up to 10^15 times.

Nulls and ties: a null text is empty and has no phrase; a null language is
``und``, together with rows that say so; the same text twice counts twice;
words, pieces and texts of any length are handled in chunks of bounded size;
ties of a score go by count, then by phrase in byte order; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.llm.common import by_bytes, partitions, python_workers
from fleetwear.session import release, stage

LEAST, TOP, INSIDE = 10, 2000, 50
BITS = 1 << 27
BURST = 4096  # entries of a container before it bursts
HELD = 400_000  # entries of a trie before it spills
WORDS = 500_000  # words a task remembers
CHUNK = 4 << 20  # bytes of text handled at once
RUN = 50_000  # rows of a batch
#: What ends a piece, and what lies between words.
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"

#: One byte for another: lower case, one mark for all ends, one for all gaps.
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = range(97, 123)
for _c in ENDS:
    _PLAIN[ord(_c)] = ord(".")
_PLAIN[9] = 32
_PLAIN = bytes(_PLAIN)


def folded(hashes: list[np.ndarray]) -> np.ndarray:
    """Bit numbers of phrases from the hashes of their words; ``bit_of`` says the same in Spark."""
    h = hashes[0]
    for other in hashes[1:]:
        h = ((h << np.uint64(21)) | (h >> np.uint64(43))) ^ other
    return (h ^ (h >> np.uint64(29))) & np.uint64(BITS - 1)


def bit_of(lang: str, phrase: str) -> Column:
    def word(w: Column) -> Column:
        return F.xxhash64(F.col(lang), w)

    words = F.split(phrase, " ")
    h = F.aggregate(
        F.slice(words, F.lit(2), F.size(words)),
        word(F.element_at(words, 1)),
        lambda h, w: F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(word(w)),
    )
    return h.bitwiseXOR(F.shiftrightunsigned(h, 29)).bitwiseAND(F.lit(BITS - 1))


class HatTrie:
    """Counts of pairs or triples of ids: first id, then hash containers that burst by the second."""

    def __init__(self) -> None:
        self.root: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}
        self.seen: dict[int, int] = {}
        self.burst: set[int] = set()
        self.held = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """``rests``: what follows the first id, as one number of 32 bits an id."""
        node = self.root.get(first)
        if node is None:
            self.root[first] = dict(zip(rests, counts, strict=True))
            self.sizes[first], self.seen[first] = len(rests), sum(counts)
            self.held += len(rests)
            return
        new = 0
        if first in self.burst:
            for rest, n in zip(rests, counts, strict=True):
                leaf = node.get(rest >> 32)
                if leaf is None:
                    leaf = node[rest >> 32] = {}
                before = leaf.get(rest)
                new += before is None
                leaf[rest] = n + (before or 0)
        else:
            had = len(node)
            for rest, n in zip(rests, counts, strict=True):
                node[rest] = node.get(rest, 0) + n
            new = len(node) - had
            if len(node) > BURST and rests[0] >> 32:
                leaves: dict[int, dict] = {}
                for rest, n in node.items():
                    leaves.setdefault(rest >> 32, {})[rest] = n
                self.root[first] = leaves
                self.burst.add(first)
        self.sizes[first] += new
        self.seen[first] += sum(counts)
        self.held += new

    def take(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees; their entries as arrays (first, rest, count)."""
        rests: list[int] = []
        counts: list[int] = []
        sizes = [self.sizes.pop(f) for f in firsts]
        for first in firsts:
            node = self.root.pop(first)
            del self.seen[first]
            for leaf in node.values() if first in self.burst else (node,):
                rests += leaf.keys()
                counts += leaf.values()
            self.burst.discard(first)
        self.held -= len(rests)
        return np.repeat(np.array(firsts, np.int64), sizes), np.array(rests, np.int64), np.array(counts, np.int64)

    def coldest(self, share: float) -> list[int]:
        """First ids of subtrees that together hold this share: those whose entries recur least go."""
        if share >= 1:
            return list(self.root)
        out, gone = [], 0
        for first in sorted(self.sizes, key=lambda f: self.seen[f] / self.sizes[f]):
            if gone >= share * self.held:
                break
            out.append(first)
            gone += self.sizes[first]
        return out


class Language:
    """Words, their ids and counts of one language within a task."""

    def __init__(self, name: str) -> None:
        import xxhash

        self.name = name
        self.hash, self.seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(name.encode(), 42)
        self.trie = HatTrie()
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[b"."]
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.ones = np.zeros(0, np.int64)

    def ids(self, data: bytes) -> np.ndarray:
        """Ids of the words, 0 for an end of a piece."""
        tokens = data.replace(b".", b" . ").split()
        ids = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        fresh = list(self.codes)[len(self.words):] if len(self.codes) > len(self.words) else []
        if fresh:
            self.words += fresh
            new = np.fromiter((self.hash(w, self.seed) for w in fresh), np.uint64, len(fresh))
            self.hashes = np.concatenate([self.hashes, new])
        return ids

    def count(self, data: bytes, size: int, bitmap: np.ndarray | None) -> None:
        ids = self.ids(data)
        if size == 1:
            new = np.bincount(ids, minlength=len(self.words))
            new[:len(self.ones)] += self.ones
            self.ones = new
            return
        at = np.arange(max(0, len(ids) - size + 1))
        good = np.ones(len(at), bool)
        for k in range(size):
            good &= ids[k:k + len(at)] > 0
        if bitmap is not None:
            h = self.hashes[ids]
            n = max(0, len(ids) - size + 2)
            bit = folded([h[k:k + n] for k in range(size - 1)])
            known = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            good &= known[:len(at)] & known[1:len(at) + 1]
        at = at[good]
        if not len(at):
            return
        code = ids[at]
        for k in range(1, size):
            if k > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.words) + ids[at + k]
        _, one, counts = np.unique(code, return_index=True, return_counts=True)
        one = at[one]
        first = ids[one]
        rest = np.zeros(len(one), np.int64)
        for k in range(1, size):
            rest = (rest << 32) | ids[one + k]
        order = np.argsort(first, kind="stable")
        first, rest, counts = first[order], rest[order].tolist(), counts[order].tolist()
        edges = np.flatnonzero(np.diff(first, prepend=-1)).tolist() + [len(first)]
        for a, b in zip(edges, edges[1:], strict=False):
            self.trie.add(int(first[a]), rest[a:b], counts[a:b])

    def spill(self, share: float, size: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as a run, sorted by their words."""
        if size == 1:
            self.ones[:1] = 0
            ids = [np.flatnonzero(self.ones)]
            counts, self.ones = self.ones[ids[0]], np.zeros(0, np.int64)
        else:
            first, rest, counts = self.trie.take(self.trie.coldest(share))
            ids = [first, rest] if size == 2 else [first, rest >> 32, rest & 0xFFFFFFFF]
        # The first word, and which of its 64 parts the others belong to.
        prefix = self.hashes[ids[0]] << np.uint64(6)
        for other in ids[1:]:
            prefix ^= self.hashes[other] & np.uint64(63)
        prefix = prefix.astype(np.int32)
        used = np.unique(np.concatenate(ids))
        words = pa.array([self.words[i] for i in used.tolist()], pa.binary())
        order = pc.array_sort_indices(words)
        words = words.take(order)
        rank = np.zeros(len(self.words), np.int64)
        rank[used[order.to_numpy()]] = np.arange(len(used))
        ids = [rank[i] for i in ids]
        order = np.lexsort(ids[::-1])
        for at in range(0, len(order), RUN):
            part = order[at:at + RUN]
            run = [words.take(pa.array(i[part])) for i in ids]
            phrase = pc.binary_join_element_wise(*run, pa.scalar(b" ", pa.binary())) if size > 1 else run[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name] * len(part)), pa.array(prefix[part]), phrase.cast(pa.string()), pa.array(counts[part])],
                ["lang", "prefix", "phrase", "n"],
            )


def chunks(data: bytes, size: int) -> Iterator[bytes]:
    """Cut plain text between pieces, or, where one is very long, between words, with ``size - 1`` words again."""
    at, again = 0, b""
    while at < len(data):
        stop, carry = at + CHUNK, False
        if stop >= len(data):
            stop = len(data)
        elif (end := data.rfind(b".", at, stop)) >= 0:
            stop = end + 1
        else:
            carry = True
            gap = data.rfind(b" ", at, stop)
            if gap < 0:
                ahead = [p for p in (data.find(b" ", stop), data.find(b".", stop)) if p >= 0]
                gap = min(ahead, default=len(data))
            stop = max(gap, at + 1)
        chunk = again + data[at:stop]
        yield chunk
        again = b" ".join(chunk.split()[1 - size:]) + b" " if carry and size > 1 else b""
        at = stop


def runs(df: DataFrame, size: int, bitmap: bytes | None) -> DataFrame:
    """Rows (lang, prefix, phrase, n): counts of phrases of ``size`` words, in sorted runs of the tasks' tries."""
    spark = df.sparkSession
    python_workers(spark)
    sent = None if bitmap is None else spark.sparkContext.broadcast(bitmap)  # BITS / 8 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else np.frombuffer(sent.value, np.uint8)
        languages: dict[str, Language] = {}
        for batch in batches:
            for rows in by_bytes(batch, 1, CHUNK):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if text:
                        texts.setdefault(lang, []).append(text.encode().translate(_PLAIN))
                for lang, own in texts.items():
                    language = languages.setdefault(lang, Language(lang))
                    for chunk in chunks(b".".join(own), size):
                        language.count(chunk, size, bits)
                        if sum(len(x.words) for x in languages.values()) > WORDS:
                            for x in languages.values():
                                yield from x.spill(1, size)
                                x.forget()
                        elif sum(x.trie.held for x in languages.values()) > HELD:
                            for x in languages.values():
                                yield from x.spill(0.5, size)
        for language in languages.values():
            yield from language.spill(1, size)

    return df.mapInArrow(count, "lang string, prefix int, phrase string, n long")


def merged(spilled: DataFrame) -> DataFrame:
    """The runs added up, all of a prefix in one partition; a first word is 64 prefixes, so a frequent one is spread."""
    dealt = spilled.repartition("lang", "prefix")
    return dealt.groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n")


def bitmap_of(frequent: DataFrame) -> bytes:
    """A bit for every phrase; at most BITS / 8 bytes reach the driver."""
    bits = frequent.select(bit_of("lang", "phrase").alias("bit"))
    pages = bits.groupBy(F.floor(F.col("bit") / 32768).alias("page")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")
    )
    out = bytearray(BITS // 8)
    for r in pages.toLocalIterator():
        out[4096 * r["page"]:4096 * (r["page"] + 1)] = r["bits"]
    return bytes(out)


def counted(df: DataFrame, least: int = LEAST, longest: int = 3, by: str | None = "lang", text: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Staged tables (lang, phrase, n) of phrases that occur ``least`` times, one a length; and (lang, n) of all words."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("und")) if by else F.lit("und")
    rows = df.select(group.alias("lang"), F.col(text).alias("text"))
    levels: list[DataFrame] = []
    totals, bitmap = None, None
    for size in range(1, longest + 1):
        found = merged(runs(rows, size, bitmap))
        if size == 1:
            words = stage(found, "phrases-words")
            totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
            levels.append(stage(words.where(F.col("n") >= least), "phrases-1"))
            release(words)
        else:
            levels.append(stage(found.where(F.col("n") >= least), f"phrases-{size}"))
        if size < longest:
            bitmap = bitmap_of(levels[-1])
    return levels, totals


def part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(levels: list[DataFrame]) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score) of all candidates: the cut with the lowest score, the first of equal ones."""
    words = F.split("phrase", " ")
    candidates = reduce(DataFrame.unionByName, levels[1:]).withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("*", part(words, F.lit(1), F.col("k")).alias("left"), part(words, F.col("k") + 1, F.size(words)).alias("right"))
    known = reduce(DataFrame.unionByName, levels[:-1])
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = "decimal(19,0)"
    up = F.col("a").cast("decimal(16,0)")
    score = (up * up).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    both = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).select(
        "lang", "phrase", "a", "k", "l", "r", score.alias("up"), (F.col("l").cast(whole) * F.col("r").cast(whole)).alias("down")
    )
    best = F.min(F.struct(F.expr("up div down").cast("long").alias("score"), "k", "l", "r", "a"))
    return both.groupBy("lang", "phrase").agg(best.alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def outside(rows: DataFrame, levels: list[DataFrame], inside: int = INSIDE) -> DataFrame:
    """Without phrases that a longer one with ``inside`` percent of their count or more holds."""
    if len(levels) < 3:
        return rows
    words = F.split("phrase", " ")
    longer = reduce(DataFrame.unionByName, levels[2:]).select("lang", "n", words.alias("w"))
    sizes = F.sequence(F.lit(2), F.size("w") - 1)
    held = longer.select("lang", "n", "w", F.explode(sizes).alias("m")).select(
        "lang", "n", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i")
    )
    most = held.groupBy("lang", part(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("n").alias("longer"))
    joined = rows.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")


def phrases(
    df: DataFrame, least: int = LEAST, longest: int = 3, top: int = TOP, by: str | None = "lang", text: str = "text"
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    levels, totals = counted(df, least, longest, by, text)
    rows = outside(scored(levels), levels)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The first of each slot, then the first of those: no task sees all phrases of a language.
    slots = rows.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(4 * partitions(df.sparkSession))))
    for keys in (("lang", "slot"), ("lang",)):
        slots = slots.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return slots.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
