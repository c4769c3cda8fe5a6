import zlib

import numpy as np
import pytest

from fleetwear.llm import queries, toxicity
from fleetwear.llm.toxicity import TERMS, Automaton, features

FOLDER = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "scum", "loser", "closet", "pathetic"]
    automaton = Automaton(terms, {})
    rng = np.random.default_rng(1)
    words = set(terms)
    for _ in range(4000):
        w = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 3)):
            i, c = rng.integers(len(w) + 1), "abcdefghilmoprstu"[rng.integers(17)]
            w = [w[:i] + [c] + w[i:], w[:i] + w[i + 1:], w[:i] + [c] + w[i + 1:]][rng.integers(3)] or ["a"]
        words.add("".join(w))
    for w in words:
        best = min((edits(w, t) for t in terms if len(t) >= 5), default=9)
        first = any(w[:1] == t[:1] for t in terms if edits(w, t) <= 1)
        got = automaton.match(w)
        if w in terms:
            assert got == (1.0, 0.0, 0.0)
        elif best > 1:
            assert got is None, w
        elif first:
            assert got == (0.0, 1.0, 0.0), w


def test_first_letters():
    terms = ["idiot", "scum", "loser", "asshole", "pathetic"]
    automaton = Automaton(terms, {})
    for term in terms:
        if len(term) >= 5:
            for c in "xzq":
                for word in (c + term[1:], c + term, term[1:]):
                    assert automaton.match(word) == (0.0, 1.0, 0.0), word
            for c in "$1@*":
                for word in (c + term[1:], c + term):
                    assert automaton.match(word) == (1.0, 0.0, 0.0), word
            assert automaton.match("xy" + term) is None


def test_edits_of_stems_and_masks_of_short_terms():
    terms, stems = ["scum", "shit", "pathetic"], {"lowei": 0.5, "grum": 0.4, "bocoo": 0.7}
    automaton = Automaton(terms, stems)
    for word in ("sc*m", "$cum", "sh1t", "shi7", "5hit"):
        assert automaton.match(word) == (1.0, 0.0, 0.0), word
    for word in ("scam", "shot", "sh1ts", "s**m", "gram", "grams"):
        assert automaton.match(word) is None, word
    assert automaton.match("gr*ms") == automaton.match("9rum") == (0.0, 0.0, 0.4)
    assert automaton.match("l0wei") == automaton.match("low*ischaft") == automaton.match("lo-weis") == (0.0, 0.0, 0.5)
    rng = np.random.default_rng(2)
    for _ in range(3000):
        w = list([*stems, *terms][rng.integers(6)]) + list("ab"[: rng.integers(3)])
        for _ in range(rng.integers(0, 3)):
            i, c = rng.integers(len(w) + 1), "abcegilmorstuw"[rng.integers(14)]
            w = [w[:i] + [c] + w[i:], w[:i] + w[i + 1:], w[:i] + [c] + w[i + 1:]][rng.integers(3)] or ["a"]
        word = "".join(w)
        exact = max((v for s, v in stems.items() if word.startswith(s)), default=0.0)
        near = max((v for s, v in stems.items() if len(s) >= 5 and any(edits(word[:n], s) <= 1 for n in range(len(word) + 1))), default=0.0)
        if word in terms:
            want = (1.0, 0.0, 0.0)
        elif exact:
            want = (0.0, 0.0, exact)
        elif edits(word, "pathetic") <= 1:
            want = (0.0, 1.0, 0.0)
        else:
            want = (0.0, near, 0.0) if near else None
        assert automaton.match(word) == want, word


def test_forms_and_context():
    automaton = Automaton(list(TERMS), {"lowei": 0.5})
    assert automaton.match("st*pid") == (1.0, 0.0, 0.0)
    assert automaton.match("loweischaft") == (0.0, 0.0, 0.5)
    assert automaton.match("scam") is None
    plain = features("What an idiot this is", automaton)
    quoted = features('He wrote "what an idiot this is" yesterday', automaton)
    reported = features("they said idiot this is", automaton)
    addressed = features("you are an idiot", automaton)
    assert quoted[0] < reported[0] < plain[0] < addressed[0]
    assert features("", automaton) == features(" ... ", automaton) == [0.0] * toxicity.FEATURES
    assert features('a " lone mark ' + "fine " * 100 + "idiot", automaton)[0] == plain[0]


def test_misspelled_terms_decide_together(spark):
    bad = ["you stupiid mooron", "stupiid " * 12, "what a stupiid patheticc filthhy lot " + "and so on it goes " * 8, "you are a worthles imbecille"]
    good = ["a stupiid thing", "where the whole crown of the shore is lower", "you are closer to the pitch", "plain talk of harbours and mills",
            "oron vellis oron tamber " + "ditto velum carda " * 9]
    rows = list(enumerate(bad + good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = [(100 + i, f"oron number {i} whore stupid idiot" if i % 2 else f"oron velum {i} verein") for i in range(60)]
    for labelled in (docs.limit(0), spark.createDataFrame(odd, "doc_id long, text string")):
        labels = labelled.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
        model = toxicity.train(labelled, labels)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
        for k, text in rows:
            assert (got[k] > 0.5) == (k < len(bad)), (text, got[k])


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in queries.QUERIES["op1_toxicity"](spark, FOLDER).collect()}


def test_query(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    right = n = 0
    for k, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and k in labels:
            n, right = n + 1, right + (r["predicted"] == labels[k])
    assert n > 30 and right / n > 0.95


def test_odd_rows(spark):
    rows = [(1, "you stupid idiot"), (2, None), (2, ""), (None, "plain"), (3, "word " * 50000), (1, "you stupid idiot")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["score"])
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())
    assert by[None] == by[""] == by["plain"] and max(by["plain"]) < 0.5 < min(by["you stupid idiot"])
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_reporting_words_count_only_before_the_hit():
    automaton = toxicity.Automaton(["idiot"], {})
    filler = " ".join(f"word{i}" for i in range(12))
    for lead in ("", "so ", filler + " "):
        after = toxicity.features(f"{lead}they idiot he said", automaton)
        before = toxicity.features(f"{lead}he said they idiot", automaton)
        assert after[3] == 1.0 and before[3] == pytest.approx(0.6), lead
        assert toxicity.features(f"{lead}you idiot he said", automaton)[3] == 1.5


def test_tables_of_other_operators_are_dropped():
    from fleetwear.llm import common

    gone = []
    common.working("one", lambda: gone.append(1))
    common.working("one", lambda: gone.append(1))
    assert not gone
    common.working("two", lambda: gone.append(2))
    assert gone == [1]
    common.working("three")
    assert gone == [1, 2]


def test_every_supported_stem_is_kept(spark):
    rows = [(1, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}qzx" for i in range(3000)), 0)] * 8
    rows += [(0, "plain words only", 0)] * 50
    sample = spark.createDataFrame(rows, "toxic int, text string, half int")
    assert len(toxicity.learn_stems(sample)) == 3000
