import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetwear.llm import packing, queries
from fleetwear.llm.tokens import byte_bpe

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", " ", "<|endoftext|>", "a<|endoftext|>b", "x² ½ Ⅻ ١٢ ªº µ", "  x​", "it's 'tis we'll they've I'm you'd can't", "tab\t\tnew\n\n  \n x  ", "日本語 한국어 ไทย", "é ñ ﻿",
    "𝒳 🎉🎉 emoji", "a_b __init__ x__ _1_", "1234567 12.5e7", "!!!??? ...", "\x00\x1f\x0b\x0c\x85", "é" * 5000, "ab" * 40000, "Ärger über ñandú œuvre Œ ſ ß", "–—‘’“”…€", "\r\n\r\n end ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_library(spark, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = byte_bpe()
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


def check(rows, texts, tokenizer, window=2048):
    """Every id in one piece, sequences gapless and padded as stated."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for key, group in texts.items():
        for t in group:
            want = ids(tokenizer, t)
            total += len(want)
            own = sorted(by_doc[key, len(want)], key=lambda r: (r["start"], r["sequence_id"]))
            seen = {}
            for r in own:
                assert r["ids_crc32"] == zlib.crc32(np.asarray(want[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) or len(group) > 1
                seen[r["start"]] = r["length"]
            if len(group) == 1:
                assert sum(r["length"] for r in own) == len(want)
                at = 0
                while at < len(want):
                    at += seen[at]
    sizes = []
    for _, parts in sorted(by_sequence.items()):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        sizes.append(at)
    assert sum(sizes) == total
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(s == window or s & (s - 1) == 0 for s in sizes)


def test_query(spark, tokenizer):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check(queries.QUERIES["op9_packing"](spark, FOLDER).collect(), texts, tokenizer)


def test_odd_rows(spark, tokenizer):
    rows = [*enumerate(ODD), (None, "null key"), (99, None), (98, "same"), (98, "same")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, part int")
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t)
    check(packing.digest(packing.pack(df)).collect(), texts, tokenizer)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("total", [0, 1, 7, 8, 9, 15, 16, 29])
def test_cut(total):
    edges = packing.tail_edges(total, 8)
    pieces = [p for start, n in ((0, min(total, 11)), (11, max(0, total - 11))) for p in packing.cut(start, n, 8, edges, total)]
    assert sum(p[1] for p in pieces) == total
    sizes = {}
    for _, length, sequence, offset in pieces:
        assert offset == sizes.get(sequence, 0)
        sizes[sequence] = offset + length
    assert all(n == 8 or n & (n - 1) == 0 for n in sizes.values())
