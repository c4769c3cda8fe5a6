import random
import re
from collections import Counter

import pytest

from fleetwear.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000, longest=3):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    by = {}
    for lang, text in rows:
        counts = by.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in by.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in f.items() if len(q) > len(p) and c >= least and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= 50 * a for c in longer):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, g, i, 1, "x") for i, (g, t) in enumerate(rows)], "text string, lang string, doc_id int, n int, phrase string")
    return sorted(tuple(r) for r in phrases.phrases(df.repartition(5), **more).collect())


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["a", "B", "the", "of", "New", "York", "x-y", "é", "É", "日本", "ab", "a'b", "\x1f", "\xa0", "z" * 30] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(words[:15] if r.random() < 0.7 else words) if r.random() < 0.8 else "new york city"
            text += r.choice([" "] * 8 + ["  ", "\t", ". ", "\n", ",", " ; ", "\x0b", "!?"])
        rows.append((r.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), ("xx", " .\n. \t"), (None, "."), ("fr", "only once here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting_everything(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least=2, top=7) == plain(rows, 2, 7)
    assert found(spark, rows, longest=2) == plain(rows, longest=2)


def test_small_containers_chunks_and_bitmaps(spark, monkeypatch):
    """Bursts, spills, forgotten words, cut texts and bits that fall together change nothing."""
    rows = corpus(3) + [("en", "a b " * 3000), ("en", "q" * 5000 + " a b " + "r" * 5000), ("de", "one two three " * 2000)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    for name, value in (("BURST", 3), ("HELD", 50), ("WORDS", 20), ("CHUNK", 100), ("BITS", 1 << 15), ("RUN", 7)):
        monkeypatch.setattr(phrases, name, value)
    # What the workers run is pickled by reference, so the small numbers are set in here and the tries run here too.
    for size in (1, 2, 3):
        counts = Counter()
        own = {}
        for lang, text in rows:
            own.setdefault(lang if lang is not None else "und", []).append((text or "").encode().translate(phrases._PLAIN))
        for lang, texts in own.items():
            language = phrases.Language(lang)
            batches = []
            for chunk in phrases.chunks(b".".join(texts), size):
                language.count(chunk, size, None)
                if len(language.words) > phrases.WORDS:
                    batches += language.spill(1, size)
                    language.forget()
                elif language.trie.held > phrases.HELD:
                    batches += language.spill(0.5, size)
            for batch in [*batches, *language.spill(1, size)]:
                for r in batch.to_pylist():
                    counts[r["lang"], r["phrase"]] += r["n"]
            assert not language.trie.root and not language.trie.held
        exact = Counter()
        for lang, texts in own.items():
            for text in texts:
                for piece in text.split(b"."):
                    words = piece.decode().split(" ")
                    words = [w for w in words if w]
                    exact.update((lang, " ".join(words[i:i + size])) for i in range(len(words) - size + 1))
        assert counts == exact, size
    monkeypatch.undo()
    assert sorted(tuple(r) for r in phrases.phrases(df).collect()) == want


def test_bits_agree_with_spark(spark):
    import numpy as np

    rows = [("en", "a"), ("en", "a b"), ("de", "a b"), ("en", "é 日本"), ("und", "x" * 100 + " y")]
    df = spark.createDataFrame(rows, "lang string, phrase string")
    bits = [r[0] for r in df.select(phrases.bit_of("lang", "phrase")).collect()]
    for (lang, phrase), bit in zip(rows, bits, strict=True):
        language = phrases.Language(lang)
        ids = language.ids(phrase.encode())
        assert int(phrases.folded([language.hashes[i:i + 1] for i in ids])[0]) == bit
    held = np.frombuffer(phrases.bitmap_of(df), np.uint8)
    assert sorted(set(bits)) == np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist()


def test_empty_table(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert queries.ORACLES["op13_phrases"]
