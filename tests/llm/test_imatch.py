import hashlib

from pyspark.sql import functions as F

from fleetwear.llm import imatch, queries

FOLDER = "/root/testdata/sf0.001"


def check(rows, texts):
    """``texts``: (doc_id, text) in the order of the chain."""
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    for i, (k, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        key = (k, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got.get(key), key
    assert len(rows) == len(texts)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    rows = queries.QUERIES["op7_fingerprints"](spark, FOLDER).collect()
    check(rows, texts)
    by_text, prints = {}, {}
    for r in rows:
        prints[r["doc_id"]] = r["fingerprint"]
    for k, t in texts:
        assert by_text.setdefault(t, prints[k]) == prints[k]
    assert sum(r["near_edited"] for r in rows) > 3 * sum(r["near_next"] for r in rows)


def test_odd_rows(spark):
    rows = [(5, "b c d"), (5, "b c d"), (3, None), (None, "é" * 9), (9, ""), (7, "x" * 40000), (5, "a")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, piece int, ghost int")
    got = imatch.edited_pairs(df).collect()
    chain = [(9, ""), (7, "x" * 40000), (5, "b c d"), (5, "b c d"), (5, "a"), (3, ""), (None, "é" * 9)]
    check(got, chain)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 5}) == 1
    assert imatch.edited_pairs(df.limit(0)).count() == 0
    one = imatch.edited_pairs(df.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_likeness(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-4]), " ".join(words[:200] + [f"v{i}" for i in range(200)]), " ".join(f"u{i}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = imatch.lexicon(df, most=1.0)
    made = imatch.fingerprints(
        df.withColumn("k", F.col("doc_id")), lex, {"text": "f"}, ["doc_id"], ["k"]
    )
    f = {r["doc_id"]: r["f"] for r in made.collect()}
    pairs = spark.createDataFrame([(f[0], f[i]) for i in range(4)], "a string, b string")
    near = [r[0] for r in pairs.select(imatch.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.1
