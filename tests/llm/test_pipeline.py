import brute
import pytest
import test_jaccard_join as near
import test_packing as packs

import corpus_pipeline
from fleetwear.llm import decontamination as D
from fleetwear.llm import queries, toxicity
from fleetwear.llm.common import documents, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, in order."""
    from fleetwear.session import stage

    docs, out = documents(spark, FOLDER), []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, kept):
    docs = documents(spark, FOLDER)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(k.columns == docs.columns for k in kept[:-1])
    before = texts(docs)
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    clean = texts(kept[0])
    assert clean == {k: t for k, t in before.items() if scores[k] < 0.5}
    single = texts(kept[1])
    groups = near.brute(list(clean.items()), 5, 80)
    assert single == {k: clean[k] for k, _, c in groups if k == c}
    items = [D.words_of(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    fresh = texts(kept[2])
    for k, t in single.items():
        words = D.words_of(t)
        hit = any(len(set(i) & set(words)) * 2 >= len(set(i)) and D.align_words(i, words) >= D.THRESHOLD for i in items)
        assert (k in fresh) != hit
    masked = {r["doc_id"]: r for r in kept[3].collect()}
    assert masked.keys() == fresh.keys()
    for k, t in fresh.items():
        after = masked[k]["text"]
        counts, _, _ = brute.spans(t, brute.SECRETS)
        assert (after == t) if not any(counts) and "[secret]" not in after else "[secret]" in after
        assert not any(brute.spans(after, brute.SECRETS)[0])
        assert masked[k]["n_chars"] == len(after)


def test_packed(kept):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packs.check(kept[4].collect(), {k: [t] for k, t in texts(kept[3]).items()}, tokenizer)


def test_run(spark, kept):
    got = sorted(tuple(r) for r in queries.QUERIES["pipeline"](spark, FOLDER).select("doc_id", "start", "length", "ids_crc32").collect())
    pieces = sorted({(r["doc_id"], r["doc_tokens"]) for r in kept[4].collect()})
    assert sorted({g[0] for g in got}) == sorted({p[0] for p in pieces})


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "plain text without an id", "en", "s", 3), (2, "", "en", "s", 0), (4, "x " * 9000, None, "s", 9), (5, 'token = "abcdef123456"', "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        out = source
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, out, FOLDER)
            assert out.columns == docs.columns
        assert out.count() == source.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, FOLDER)
        assert (pieces.count() > 0) == (source.count() > 0)
