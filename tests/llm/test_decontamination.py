import random

import numpy as np

from fleetwear.llm import decontamination as D
from fleetwear.llm import queries

FOLDER = "/root/testdata/sf0.001"


def smith_waterman(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best / len(a) if a else 0.0


def test_alignment_equals_the_table_version():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 12))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]
        if a:
            assert abs(D.align_words(a, b) - smith_waterman(a, b)) < 1e-9
    assert D.align(np.array([]), np.array([1])) == 0.0


def test_query_equals_full_alignment(spark):
    docs = {r["doc_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_decontamination"](spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    marked = 0
    for k, words in docs.items():
        want = []
        for i, item in items.items():
            if len(set(item) & set(words)) >= 0.5 * len(set(item)) and D.align_words(item, words) >= D.THRESHOLD:
                want.append(i)
        assert got[k]["item_ids"] == sorted(want), k
        assert got[k]["contaminated"] == bool(want)
        marked += bool(want)
    assert marked


def test_edited_copies_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(40)]
    edited = [w if i % 6 else "other" for i, w in enumerate(item)]
    cut = item[:15] + item[18:]
    filler = [f"z{rng.randrange(500)}" for _ in range(300)]
    docs = [
        (1, " ".join(filler + edited + filler)), (2, " ".join(cut)), (3, " ".join(item[:10] + filler)), (4, None), (5, ""), (None, " ".join(item).upper()),
        (6, " ".join(filler)), (6, ", ".join(item)), (7, " ".join(filler * 200 + item)), (8, "tiny item here"),
    ]
    items = [(10, " ".join(item)), (11, None), (12, ""), (13, "tiny item"), (14, "solo"), (None, "w1 w2 w3"), (15, " ".join(item))]
    d = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["contaminated"], r["item_ids"]) for r in D.judged(d, b).collect()]
    assert len(got) == len(docs)
    by = {k: (c, i) for k, c, i in got}
    assert by[1] == by[2] == by[None] == by[6] == by[7] == (True, [10, 15])
    assert by[3] == by[4] == by[5] == (False, [])
    assert by[8] == (True, [13])
    monkeypatch.setattr(D, "BLOCK", 20)
    again = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in D.judged(d, b).collect()}
    assert again == by
    assert D.judged(d.limit(0), b).count() == 0
    assert not D.judged(d, b.limit(0)).where("contaminated").count()


def test_edited_copies_in_many_documents(spark):
    item = [f"w{i}" for i in range(40)]
    edited = [w if i % 6 else f"other{i}" for i, w in enumerate(item)]
    assert D.align_words(item, edited) >= D.THRESHOLD
    docs = [(i, " ".join([f"a{i}", *edited, f"b{i}"])) for i in range(300)] + [(1000 + i, f"z{i} w1 w2 w3 w4") for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.judged(d, b).collect()}
    assert all(got[k]["contaminated"] == (k < 1000) and got[k]["item_ids"] == [10] * (k < 1000) for k, _ in docs)
    assert got[0]["score"] == D.align_words(item, edited) and got[1000]["score"] == 0.1
