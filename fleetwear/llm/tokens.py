"""Token ids of texts under a byte-level BPE vocabulary, inside Python workers."""

from __future__ import annotations

import base64
import os
import re
import struct

import public_tokenizers

from fleetwear.llm.common import working

BYTE_BPE, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The split pattern of the vocabulary, for texts of the plain
#: characters below, where the standard ``re`` classes agree with Unicode's.
SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
ODD = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-ɏ‐-‧€]|<\\|endoftext\\|>")
REMEMBERED = 150_000  # words whose ids a worker keeps
LONG_WORD = 64


class ByteBpe:
    """``ids(text)``: little-endian 16-bit ids, as the tokenizer file gives them without added tokens.

    Words that were seen before come from a bounded table. Texts with
    characters outside the plain ones, or with the special string, go through
    the tokenizer itself.
    """

    def __init__(self, folder: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        def place(name: str) -> str:
            return os.path.join(folder, name) if folder else public_tokenizers.path(name)

        self.exact = Tokenizer.from_file(place(BYTE_BPE))
        with open(place(BYTE_BPE_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = words._core_bpe.encode_single_piece

        class Seen(dict):
            def __missing__(self, word: str) -> bytes:
                ids = encode(word.encode())
                packed = struct.pack(f"<{len(ids)}H", *ids)
                if len(word) <= LONG_WORD:
                    self[word] = packed
                return packed

        self.seen = Seen()

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}H", *ids)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return b"".join(map(self.seen.__getitem__, SPLIT.findall(text)))


_loaded: dict[str | None, ByteBpe] = {}


def byte_bpe(folder: str | None = None) -> ByteBpe:
    """One tokenizer a worker process."""
    working("tokens", _loaded.clear)
    if folder not in _loaded:
        _loaded[folder] = ByteBpe(folder)
    return _loaded[folder]
