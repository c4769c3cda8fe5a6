"""Token counts by a compiled finite-state transducer.

The merge rules of a byte-pair vocabulary are compiled into a deterministic
transducer whose transitions carry how much the token count changes. After each
character the last token of the text so far is the one that ends there and is
*compatible* with the last token before it: merging the two alone leaves both
as they are. A state therefore needs, for every place where a token that is
not finished may have begun, the last token before that place and the count
there. Pieces are of bounded length, so states are finitely many; they are
made when first reached and kept.

A text is cut into chunks. The map of a chunk is (head, total, tail): the part
before its first place where a word ends, which depends on the state at entry;
the tokens between the first and the last such place; and the part after it,
which decides the state at exit. Maps compose associatively, so the counts of
a text are a parallel prefix scan over its chunks (here a tree of pairs).

Nulls and ties: null and empty texts have no tokens; repeated rows stay
repeated; an empty table gives an empty result; texts are counted whole; other
columns are kept, and those that clash with the added ones are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fleetwear.llm.common import python_workers, whole_text, working

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 1 << 16
REMEMBERED = 250_000  # words, and states, that a worker keeps
LONG_WORD = 64
UNITS = re.compile(r" *[^ ]+| +")
LINES = re.compile(r"[^\n]+|\n")

State = tuple[str, tuple]
START: State = ("", ((0, None, 0),))


class Transducer:
    def __init__(self, pieces: dict[str, float]):
        """``pieces``: text (spaces as spaces) to score; higher scores merge first. Other characters are bytes."""
        self.pieces = pieces
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.whole: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.number: dict[State, int] = {}
        self.states: list[State] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.breaks_lines = not any("\n" in p for p in pieces)

        class Words(dict):
            def __missing__(words, unit: str) -> int:  # noqa: N805
                found = self.split_unit(unit)
                if len(unit) <= LONG_WORD:
                    if len(words) > REMEMBERED:
                        words.clear()
                    words[unit] = found
                return found

        self.words = Words()
        self.unit = self.words.__getitem__
        self._forget()

    def _forget(self) -> None:
        self.number.clear()
        self.states.clear()
        self.moves.clear()
        self._state(START)

    def _state(self, state: State) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def merged(self, text: str) -> list[str]:
        """The merge rules themselves, on a short text."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _token(self, t: str) -> bool:
        """Whether the rules can make ``t``; single characters always stand."""
        found = self.whole.get(t)
        if found is None:
            found = self.whole[t] = len(t) == 1 or (t in self.pieces and self.merged(t) == [t])
        return found

    def _split(self, t: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a token joins; None for a single character."""
        if t not in self.halves:
            parts = list(t)
            while len(parts) > 2:
                at = max(
                    (i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.pieces),
                    key=lambda i: (self.pieces[parts[i] + parts[i + 1]], -i),
                )
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[t]

    def _compatible(self, a: str | None, b: str) -> bool:
        """Whether merging the text of two tokens leaves them apart.

        The merges of both are undone, the latest first: a merge over the border
        would have happened if it comes before the one just undone.
        """
        if a is None:
            return True
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b)
        return found

    def _apart(self, a: str, b: str) -> bool:
        pieces, first = self.pieces, float("inf")  # single characters were there from the start
        limit, left = float("-inf"), False  # score of the merge undone last, and its side
        while True:
            score = pieces.get(a + b)
            # Of equal scores, that is the same piece twice, the left one merges first.
            if score is not None and (score > limit or (score == limit and not left)):
                return False
            sa = pieces[a] if len(a) > 1 else first
            sb = pieces[b] if len(b) > 1 else first
            if sa == sb == first:
                return True
            if sb <= sa:
                limit, left, b = sb, False, self._split(b)[0]
            else:
                limit, left, a = sa, True, self._split(a)[1]

    def _cost(self, t: str) -> int:
        return 1 if t in self.pieces else len(t.encode())

    def _step(self, state: State, c: str) -> tuple[State, int]:
        seen, starts = state
        for k, last, behind in starts:  # the longest token first
            t = seen[len(seen) - k:] + c
            if self._token(t) and self._compatible(last, t):
                break
        else:
            raise AssertionError("no token ends here")
        emitted = behind + self._cost(t)
        open_starts = tuple(
            (k + 1, last, behind - emitted) for k, last, behind in starts if seen[len(seen) - k:] + c in self.prefixes
        )
        if not open_starts:
            return START, emitted
        return (seen[len(seen) - open_starts[0][0] + 1:] + c, (*open_starts, (0, t, 0))), emitted

    def run(self, unit: str) -> int:
        """Tokens of a text, from the start state."""
        if len(self.states) > REMEMBERED:
            self._forget()
        at, total, moves = 0, 0, self.moves
        for c in unit:
            move = moves[at].get(c)
            if move is None:
                state, emitted = self._step(self.states[at], c)
                move = moves[at][c] = (self._state(state), emitted)
            at = move[0]
            total += move[1]
        return total

    def split_unit(self, unit: str) -> int:
        """A line feed that no piece contains stands alone, and so do the parts around it."""
        if self.breaks_lines and "\n" in unit:
            return sum(1 if part == "\n" else self.run(part) for part in LINES.findall(unit))
        return self.run(unit)

    def chunk_map(self, chunk: str) -> tuple[str, int, str]:
        """(head, total, tail). Words end where a space follows something else: no piece spans that place."""
        units = UNITS.findall(chunk)  # a word with the spaces before it
        if len(units) < 2:
            return chunk, 0, ""
        return units[0], sum(map(self.unit, units[1:-1])), units[-1]

    def compose(self, f: tuple[str, int, str], g: tuple[str, int, str]) -> tuple[str, int, str]:
        if not f[2]:  # nothing ended in f: its whole text is head
            return self._rejoined(f[0] + g[0], 0, g)
        if not g[2]:
            return self._rejoined_tail(f, g[0])
        joined = UNITS.findall(f[2] + g[0])
        return f[0], f[1] + sum(map(self.unit, joined)) + g[1], g[2]

    def _rejoined(self, head: str, total: int, g: tuple[str, int, str]) -> tuple[str, int, str]:
        units = UNITS.findall(head)
        if len(units) < 2:
            return head, total + g[1], g[2]
        if not g[2]:
            return units[0], total + sum(map(self.unit, units[1:-1])), units[-1]
        return units[0], total + sum(map(self.unit, units[1:])) + g[1], g[2]

    def _rejoined_tail(self, f: tuple[str, int, str], text: str) -> tuple[str, int, str]:
        units = UNITS.findall(f[2] + text)
        return f[0], f[1] + sum(map(self.unit, units[:-1])), units[-1]

    def scan(self, maps: list[tuple[str, int, str]]) -> tuple[str, int, str]:
        """All maps composed, as a tree of pairs."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]  # noqa: B905
            maps = pairs + maps[len(pairs) * 2:]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        head, total, tail = self.scan(maps)
        return self.unit(head) + total + (self.unit(tail) if tail else 0)


def compiled(path: str) -> Transducer:
    """From a model file of the sentencepiece library; its merge vocabulary is read, nothing is encoded with it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i).replace(SPACE, " ")] = model.get_score(i)
    if any(" " in p.lstrip(" ") for p in pieces):
        raise ValueError("a piece spans the end of a word")
    return Transducer(pieces)


_loaded: dict[str, Transducer] = {}


def transducer(folder: str | None = None) -> Transducer:
    """One transducer a worker process."""
    working("token_counts", _loaded.clear)
    path = os.path.join(folder, MODEL) if folder else public_tokenizers.path(MODEL)
    if path not in _loaded:
        _loaded[path] = compiled(path)
    return _loaded[path]


def count_tokens(df: DataFrame, text: str = "text", limit: int = 4096, folder: str | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    python_workers(df.sparkSession)

    @pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(folder)
        for t in texts:
            yield t.map(machine.count).astype("int64")

    rows = df.drop("n_bytes", "n_tokens", "over_limit")
    return rows.withColumns(
        {"n_bytes": F.octet_length(whole_text(text)).cast("long"), "n_tokens": counted(whole_text(text))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
