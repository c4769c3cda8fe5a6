import random

import public_tokenizers
import pytest
import sentencepiece

from fleetwear.llm import queries, token_counts

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "\n", "a" * 100_000, " " * 5000, "ab" * 5000, "=-" * 3000, "    def f(x):\n        return\n" * 300, "<s></s><unk><0x0A>",
    "ﬀ½²", "\x00", "　 x", "▁x ▁▁ y", "日本語テキスト", "🎉 party 🎉🎉", "line\nline\n\n line", "\r\n\t",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_transducer_equals_the_library(library):
    machine = token_counts.transducer()
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyzABCSTéüß 01  \n.,'▁-_=/x日本🎉"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        want = len(library.encode(t))
        assert machine.count(t) == want, t[:60]
        assert len(t) > 10_000 or machine.count(t, rng.randrange(1, 20)) == want, t[:60]


def test_maps_compose_in_any_order():
    machine = token_counts.transducer()
    text = " the  quick\nbrown   fox" * 5
    maps = [machine.chunk_map(text[i:i + 7]) for i in range(0, len(text), 7)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert left == right == machine.scan(maps)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    machine = token_counts.compiled(public_tokenizers.path("piece_bpe_32k.model"))
    text = "several ordinary words and some unordinary ones, twice over " * 2
    assert machine.count(text) == len(library.encode(text))


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(library.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_odd_rows(spark, library):
    texts = [*ODD, None, "same", "same"]
    df = spark.createDataFrame([(1, t, "x") for t in texts], "doc_id long, text string, n_tokens string")
    rows = token_counts.count_tokens(df).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "")) for t in texts)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
