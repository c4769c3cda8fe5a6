import random
import re

import pytest

from fleetwear.llm import jaccard_join as J
from fleetwear.llm import queries
from fleetwear.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def shingles(text, width):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """Sorted (id, size, component) of all rows, by comparing all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = {(a, b) for own in held.values() for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted([(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)], key=repr)


def run(spark, rows, width, percent):
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id long, text string, node int, n int")
    return sorted([tuple(r)[:3] for r in J.grouped(df, width=width, percent=percent).collect()], key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.QUERIES["op4_jaccard_join"](spark, FOLDER).collect()], key=repr)
    assert got == brute(rows, 4, 85)
    assert any(k != c for k, _, c in got)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_near_copies(spark, monkeypatch, width, percent):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(width)
    rows = []
    for size in (2, 3, 5, 6, 8, 12, 20, 40, 90, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                    i = rng.randrange(max(1, len(copy)))
                    copy[i:i + 1] = rng.choice(([], [f"x{rng.randrange(50)}"], [*copy[i:i + 1], "y"]))
                rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (9, "one  TWO"), (5, "one two three four"), (None, "one two"), (5, "one two three four"),
        (7, "a b c d e " * 9000), (8, "a b c d e " * 9000 + "f"), (None, "lonely null id"), (6, "É é"), (10, "é é"), (11, "x\x0by z"), (12, "x y\x0cz"), (5, "other text of five"),
    ]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert run(spark, [], 4, 85) == []


def test_near_copies_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [
        (4, " ".join(["x1", "x2", *base])), (None, " ".join(base)), (2, " ".join([*base, "y1", "y2"])),
        (7, " ".join(f"v{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(61))), (None, " ".join(f"v{i}" for i in range(62))),
        (None, " ".join(f"u{i}" for i in range(60))), (None, " ".join(f"u{i}" for i in range(61))),
    ]
    got = run(spark, rows, 5, 95)
    assert got == brute(rows, 5, 95)
    assert (4, 58, 2) in got
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in J.one_of_each(df, percent=95).collect()]
    assert sorted(kept, key=repr) == [2, 7, None]


def test_one_of_each(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, near), (3, near), (2, near + " x"), (7, near + " y"), (None, near), (5, ""), (5, None), (9, "other text entirely"), (3, "third text here"), (None, "null id alone")]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    got = sorted([(r["doc_id"], r["text"]) for r in J.one_of_each(df).collect()], key=repr)
    want = [(2, near + " x"), (5, ""), (5, None), (9, "other text entirely"), (3, "third text here"), (None, "null id alone")]
    assert got == sorted(want, key=repr)
    assert J.one_of_each(df.limit(0)).columns == df.columns


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(200, 200)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(20)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
