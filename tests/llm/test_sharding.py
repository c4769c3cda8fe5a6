import hashlib
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from fleetwear.llm import queries, sharding  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plain_fill(shards, size):
    """Whole preference lists, and turns over them."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    lists = []
    for s in shards:
        offset, skip = number(f"offset:{s}") % size, number(f"skip:{s}") % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    owner, taken, turn = [None] * size, set(), 0
    while len(taken) < size:
        slot = next(x for x in lists[turn] if x not in taken)
        taken.add(slot)
        owner[slot] = turn
        turn = (turn + 1) % len(shards)
    return owner


def test_table():
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.fill(shards, 211)
    assert owner == plain_fill(shards, 211)
    sizes = [owner.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 211
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_query(spark):
    got = queries.QUERIES["op10_sharding"](spark, FOLDER)
    assert oracle.compare(got, oracle.connect(FOLDER), queries.ORACLES["op10_sharding"]) is None


def test_odd_rows(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "b", 5), (2, None, 5), (3, "x" * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.place(df, ["doc_id"]).collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert set(got[0].asDict()) == {"doc_id", "text", "slot", "shard"}
    assert sharding.place(df.limit(0), ["doc_id"]).count() == 0
    hot = spark.range(2000).selectExpr("id", "'same' as source")
    assert sharding.place(hot, ["source"]).select("shard").distinct().count() == 1
    assert sharding.place(hot, ["source"], spread=["id"], salts=32).select("shard").distinct().count() > 16
    with pytest.raises(ValueError):
        sharding.place(hot, ["source"], salts=2)
