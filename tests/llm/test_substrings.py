import hashlib
import pathlib
import random

import numpy as np
import pytest

from fleetwear.llm import queries, substrings
from fleetwear.session import shared_folder

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length=400):
    """Sorted (id, bytes, removed, spans, digest) by counting every string."""
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, d in data:
        for i in range(len(d) - length + 1):
            h = hash(d[i:i + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for k, d in data:
        gone = np.zeros(len(d) + 1, np.int32)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~mask].tobytes()
        out.append((k, len(d), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, id string")
    found = substrings.without_repeats(df).collect()
    return sorted([
        (r["doc_id"], r["n_bytes"], sum(x["e"] - x["b"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in found
    ], key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.QUERIES["op5_substrings"](spark, FOLDER).collect()], key=repr)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = word(1500)
    rows = []
    for _ in range(40):
        a = rng.randrange(0, 1100)
        part = shared[a:a + rng.choice((300, 390, 398, 399, 400, 401, 402, 450, 700))]
        if rng.random() < 0.5:
            i = rng.randrange(len(part))
            part = part[:i] + rng.choice("xyz") + part[i + 1:]
        rows.append((len(rows), word(rng.randrange(0, 500)) + part + word(rng.randrange(0, 500))))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 3000), (103, "ab" * 700 + "c"), (104, shared), (105, None), (106, ""), (107, word(399)), (None, rows[5][1][:600])]
    rows += [(103, "abcdefg" * 500), (108, word(900) * 2), (109, "\x00" * 500 + word(300))]
    return rows


@pytest.mark.parametrize(("split", "largest"), [(2048, 32_768), (3, 32_768), (3, 2)])
def test_planted(spark, monkeypatch, split, largest):
    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "LARGEST", largest)
    rows = texts(split + largest)
    assert run(spark, rows) == brute(rows)


def test_slabs_and_empty(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd ") for _ in range(9000))
    data = np.frombuffer((long + long[2000:6000]).encode(), np.uint8)
    whole = substrings.anchors(data)
    monkeypatch.setattr(substrings, "SLAB", 1000)
    for a, b in zip(whole, substrings.anchors(data), strict=True):
        assert a.tolist() == b.tolist()
    assert run(spark, []) == []


def test_deep_shallow_sorts():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (300, 120)).astype(np.uint8)
    rows[50:200, :100] = rows[50, :100]
    rows[60:70] = rows[60]
    group = rng.integers(0, 3, 300)
    group[50:200] = 1
    order = substrings.deep_shallow(group, rows)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(300)) and keys == sorted(keys)


def text_rows_moved(df):
    """Rows with texts that went through a shuffle while ``df`` was collected."""
    found, nodes = {}, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        while "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName() == "Exchange" and "_text#" in node.output().mkString(" "):
            found[node.id()] = node.metrics().get("shuffleRecordsWritten").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found.values())


def test_only_texts_that_lose_bytes_move(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(600)
    rows = [(i, word(900)) for i in range(60)] + [(90 + i, word(100) + shared + word(100)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:")) / "fleetwear" / spark.sparkContext.applicationId
    before = set(folder.glob("substring-*"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.without_repeats(df)
        lost = {r["doc_id"]: sum(x["e"] - x["b"] for x in r["removed"]) for r in found.collect()}
        assert lost == {i: 600 if i >= 90 else 0 for i, _ in rows}
        assert text_rows_moved(found) == 3
        left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("substring-*")) - before}
        assert left == {"substring-removed"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_among(spark, monkeypatch, bits):
    monkeypatch.setattr(substrings, "BITS", bits)
    texts = spark.range(3000).selectExpr("xxhash64(id) id").union(spark.sql("select -1L id union all select 0L"))
    ids = texts.where("id % 3 = 0 or id = -1")
    kept = {r["id"] for r in substrings.among(texts, ids).collect()}
    rest = {r["id"] for r in substrings.among(texts, ids, "left_anti").collect()}
    wanted = {r["id"] for r in ids.collect()}
    assert wanted <= kept and not kept & rest and len(kept) + len(rest) == 3002
    assert len(kept - wanted) <= (0 if bits > 1 << 15 else 150)
