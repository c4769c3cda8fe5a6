import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from fleetwear.llm import quality, queries

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed)


def squeeze(data):
    return len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False).compress(data))


def median(pairs):
    pairs = sorted(pairs)
    half, at = sum(n for _, n in pairs) / 2, 0
    for v, n in pairs:
        at += n
        if at >= half:
            return v


def plain_bands(docs):
    """docs: (fine, bin) of distinct texts. Nodes (at, middle, spread)."""
    by = {}
    for fine, b in docs:
        by.setdefault(fine // 8, []).append((fine, b))
    by = {k: v for k, v in sorted(by.items()) if len(v) >= quality.NODE}
    if not by:
        return []
    at = [sum(f + 0.5 for f, _ in v) / len(v) for v in by.values()]
    middle = [float(median([(b, 1) for _, b in v])) for v in by.values()]
    def line(x):
        if x < at[0] or x > at[-1]:
            i, j = (0, 1) if x < at[0] else (len(at) - 1, len(at) - 2)
            slope = (middle[j] - middle[i]) / (at[j] - at[i]) if len(at) > 1 else -2.5
            return middle[i] + slope * (x - at[i])
        return np.interp(x, at, middle)

    raw = [1.4826 * median([(abs(b - line(f + 0.5)), 1) for f, b in v]) for v in by.values()]
    spread = [max(s, float(np.median(raw[max(0, i - 2):i + 3])), quality.LEAST_SPREAD) for i, s in enumerate(raw)]

    def width(x):
        return np.interp(x, at, spread) * (1 + max(at[0] - x, x - at[-1], 0) / 16)

    return [(line, width)]


def off(nodes, size, length):
    (line, width), x = nodes[0], 16 * np.log2(length)
    return (1000 * size / length - line(x)) / width(x)


def plain_kept(rows):
    """rows: (key, lang, text); the verdict of every row."""
    groups = {}
    for lang, text in {(r[1] or "", r[2] or "") for r in rows if not base(r[2])[-1]}:
        data = text.encode()
        point = (int(np.floor(16 * np.log2(len(data)))), int(1000 * squeeze(data) / len(data) + 0.5))
        groups.setdefault(lang, []).append(point)
    pooled = plain_bands([p for v in groups.values() for p in v])
    bands = {g: plain_bands(v) if len(v) >= quality.OWN else [] for g, v in groups.items()}
    out = []
    for _, lang, text in rows:
        if base(text)[-1]:
            out.append("base")
            continue
        data = text.encode()
        nodes = bands.get(lang or "") or pooled
        ratio, o = squeeze(data) / len(data), off(nodes, squeeze(data), len(data)) if nodes else 0
        parts = [squeeze(data[a:a + 4096]) for a in range(0, len(data) // 4096 * 4096, 4096)]
        bad = 0
        for z in parts:
            p = off(nodes, z, 4096) if nodes else 0
            bad += z / 4096 < 0.15 or z / 4096 > 1 or p < -quality.CHUNK_BELOW or p > quality.CHUNK_ABOVE
        if ratio < 0.15 or o < -quality.BELOW:
            out.append("repetitive")
        elif ratio > 1 or o > quality.ABOVE:
            out.append("incompressible")
        else:
            out.append("chunks" if bad > 0.25 * len(parts) else None)
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_equals_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_quality"](spark, folder).collect()}
    assert len(found) == len(docs)
    for d, reason in zip(docs, plain_kept([tuple(d) for d in docs]), strict=True):
        r = found[d["doc_id"]]
        assert tuple(r[1:7]) == base(d["text"]), d["doc_id"]
        assert (r["reason"], r["kept"]) == (reason, reason is None), d["doc_id"]


def prose(n, seed):
    r = random.Random(seed)
    syllables = "an be co da en fi go ha in ja ka lo mi no or pa qu re so tu un vo wi".split()
    vocabulary = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(3000)]
    return " ".join(r.choices(vocabulary, k=n))


def test_bands_catch_odd_texts_and_leave_prose_alone(spark):
    r = random.Random(3)
    good = [(i, "en", prose(r.randint(60, 2000), i)) for i in range(600)]
    marked = [(1000 + i, "en", " ".join(w + r.choice(["***", "$$$", "&&&"]) for w in prose(500, 5000 + i).split())) for i in range(20)]
    noise = [(2000 + i, "en", " ".join("".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=8)) for _ in range(300))) for i in range(20)]
    # A third of a long text is one short line over and over, in a text whose words as a whole vary.
    part = [(3000 + i, "en", prose(3000, 7000 + i) + " " + "buy now " * 2500) for i in range(5)]
    rows = good + marked + noise + part
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {x["doc_id"]: x for x in quality.judge(df).collect()}
    assert sum(not found[k]["kept"] for k, _, _ in good) <= 6
    assert all(not found[k]["kept"] for k, _, _ in marked + noise + part)
    assert {found[k]["reason"] for k, _, _ in noise} == {"incompressible"}
    assert [found[k]["reason"] for k, _, _ in rows] == plain_kept(rows)


def test_odd_rows(spark):
    long = prose(200_000, 1)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b a b a b a b"), (5, "x\n\nx\n x\ny\nx\n  \n  "), (None, prose(80, 1)), (6, long), (6, long), (7, "\xa0 \x85 \x1f é日"), (8, "ab " * 100), (9, "w" * 1_000_000)]
    df = spark.createDataFrame([(k, t, 1, "z", [1]) for k, t in rows], "doc_id long, text string, n_words int, grp string, chunk_bytes array<int>")
    found = quality.judge(df, by=None)
    got = sorted(tuple(r)[:7] for r in found.collect() if r["doc_id"] is not None)
    assert got == sorted((k, *base(t)) for k, t in rows if k is not None)
    assert {r["kept"] for r in found.where("doc_id = 6").collect()} == {True}
    assert found.where("doc_id is null").first()["base_failed"] is False
    assert quality.judge(df.limit(0), by="grp").count() == 0


def test_copies_do_not_move_the_bands(spark):
    rows = [(i, "en", prose(random.Random(i).randint(60, 600), i)) for i in range(400)]
    one = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    copies = rows + [(1000 + i, "en", rows[7][2]) for i in range(2000)]
    many = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(copies, "doc_id long, lang string, text string")).collect()}
    assert {k: many[k] for k in one} == one and {many[1000 + i] for i in range(2000)} == {one[7]}
