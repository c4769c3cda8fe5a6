"""Toxicity of texts: a lexicon met with spelling errors, judged in context.

Terms live in a trie: given ones, and stems and words learned from labelled
rows. A Levenshtein automaton (one edit; in short terms only a sign or digit in
place of a letter) is intersected with the trie: a state is a set of (trie node, edits spent), made when first
needed, and a word is one walk through the states that ends early when the set
is empty. Every hit is weighted by its form (exact, masked such as ``st*pid``,
or another edit) and by its context window: inside quotation marks or after
words of reporting it counts less, beside an address to the reader more. The
sums of a text are the features of a logistic classifier. A misspelled term is
doubtful alone, since other words come near it; several together, or beside an
address, decide. Ordinary words that come near a term count nothing: given ones,
and those that labelled rows hold as often without toxicity as with it.

Learning uses at most ``SAMPLE`` labelled rows, chosen by the digest of their
key; scoring covers every text whole. Every stem and ordinary word that these
rows give enough support for is kept, so the sample alone bounds the model.

Nulls and ties: a null text is empty; empty texts have the score of a text
without hits; rows with a null label are not learned from, and a document with
several labels is toxic if any says so; repeated rows get equal scores; without
labelled rows of both classes the starting weights decide; an empty table gives
an empty result. Other columns are kept; one named like the added column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fleetwear.llm.common import python_workers, texts_by_bytes, whole_text, working
from fleetwear.session import stage

#: Terms of abuse that need no learning.
TERMS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic",
    "disgusting", "clown", "imbecile", "vermin", "filthy", "retard", "bastard", "asshole", "bitch", "fuck", "fucking",
    "shit", "whore", "slut", "dumbass", "subhuman",
    "idiota", "imbécil", "estúpido", "basura", "idiote", "imbécile", "connard", "salaud", "dummkopf", "arschloch", "abschaum",
)
QUOTES = "\"“”„«»"
REPORTING = frozenset(
    "said says say called calling wrote writes quoted quote quoting reported reports term word slur insult meaning "
    "dit écrit appelé mot terme sagte schrieb nannte wort dijo escribió llamó palabra término".split()
)
ADDRESS = frozenset("you your you're youre u ur yourself du dich dein ihr tu toi vous votre tú usted vosotros".split())
#: Words of the languages one edit from a term.
ORDINARY = frozenset(
    "idiom idioms boron mormon mormons loner loners lover lovers lower lowers laser lasers loses lose closer closers poser "
    "leser lesers lesen loger doser crash brash thrash rash crown crowns blown flown clow filth regard regards reward retards retardé "
    "retarde batch botch butch ditch hitch pitch witch birch itch ducking sucking tucking bucking lucking mucking rucking "
    "whole where whose shore chore wore stupidly verein canard salade dastard".split()
)

SAMPLE = 20_000  # labelled rows learned from, at most
STEMS = (4, 8)  # lengths of learned stems
PRECISION, SUPPORT = 0.95, 5  # of a learned stem among labelled rows, both classes weighted alike
REACH = 8  # words on either side of a hit
EDIT_FROM = 5  # shortest term that may be misspelled
STATES = 60_000  # automaton states and remembered words a worker keeps


class Automaton:
    """Levenshtein automata of all terms at once, as one lazily built deterministic automaton.

    A state is a frozen set of (node, edits, letters): ``letters`` tells whether
    the edit concerned a letter. Given words are matched whole; a learned stem,
    with its weight, matches any word that begins with it, and the edit is one of
    the stem. ``features`` takes ``ordinary`` words for no misspelled terms.
    """

    def __init__(self, words: list[str], stems: dict[str, float], ordinary: frozenset[str] = ORDINARY):
        self.ordinary = ordinary
        self.child: list[dict[str, int]] = [{}]
        self.length: list[int] = [0]  # longest term through the node
        self.depth: list[int] = [0]
        self.word: list[bool] = [False]
        self.stem: list[float] = [0.0]
        for term, weight in [*((w, 0.0) for w in words), *stems.items()]:
            node = 0
            for c in ["", *term]:
                if c and c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.length.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.word.append(False)
                    self.stem.append(0.0)
                node = self.child[node][c] if c else node
                self.length[node] = max(self.length[node], len(term))
            if weight:
                self.stem[node] = weight
            else:
                self.word[node] = True
        self.steps: dict[frozenset, dict[str, frozenset]] = {}
        self.known: dict[str, tuple[float, float, float] | None] = {}
        self.begin = self._closed({(0, 0, False)})

    def _closed(self, items: set) -> frozenset:
        """With the terms' letters that the word leaves out."""
        out = set(items)
        for node, edits, _ in items:
            if not edits:
                for n in self.child[node].values():
                    if self.length[n] >= EDIT_FROM:
                        out.add((n, 1, True))
        return frozenset(out)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        letter = c.isalpha()
        for node, edits, other in state:
            if self.stem[node]:
                out.add((node, edits, other))  # the rest of the word does not matter
            n = self.child[node].get(c)
            if n is not None:
                out.add((n, edits, other))
            if not edits and self.length[node] >= EDIT_FROM:
                out.add((node, 1, letter))  # a letter too many
            if not edits:
                for n in self.child[node].values():
                    if not letter or self.length[n] >= EDIT_FROM:
                        out.add((n, 1, letter))  # another letter
        return self._closed(out)

    def match(self, word: str) -> tuple[float, float, float] | None:
        """What the word adds to the certain, doubtful and learned sums; None if it meets no term.

        Certain are given terms, and learned are stems, also if one letter is
        masked by a sign or digit; doubtful are both with another edit of one
        letter, a stem by its weight.
        """
        if word in self.known:
            return self.known[word]
        state = self.begin
        for c in word:
            moves = self.steps.get(state)
            if moves is None:
                if len(self.steps) >= STATES:
                    self.steps.clear()
                moves = self.steps[state] = {}
            after = moves.get(c)
            if after is None:
                after = moves[c] = self._step(state, c)
            state = after
            if not state:
                break
        near = [x for x in state if not x[1] or not x[2] or self.depth[x[0]] >= EDIT_FROM]
        sure = [node for node, edits, letters in near if not edits or not letters]
        learned = max((self.stem[node] for node in sure), default=0.0)
        doubtful = max((1.0 if self.word[node] else self.stem[node] for node, _, _ in near), default=0.0)
        found = None
        if any(self.word[node] for node in sure):
            found = (1.0, 0.0, 0.0)
        elif learned:
            found = (0.0, 0.0, learned)
        elif doubtful:
            found = (0.0, doubtful, 0.0)
        if len(self.known) >= STATES:
            self.known.clear()
        self.known[word] = found
        return found


EDGE = ".,;:!?()[]{}<>…*_~'`´’‘" + QUOTES
FEATURES = 8
REPEATED = 0.25  # what a doubtful word adds to a window when it stands there again


def features(text: str, automaton: Automaton) -> list[float]:
    """What the classifier looks at.

    Logs of the certain, doubtful and learned sums; the largest certain sum of a window; certain and learned sums per
    100 words; the largest doubtful sum of a window over that of one word, and doubtful sums per 100 words.
    """
    words = text.lower().split()
    clean = {w: w.strip(EDGE) for w in set(words)}
    hits = {w: f for w, c in clean.items() if (f := automaton.match(c)) and not (f[1] and c in automaton.ordinary)}
    if not hits:
        return [0.0] * FEATURES
    found: list[tuple[int, float, float, float]] = []
    inside = False
    marks = [sum(w.count(q) for q in QUOTES) for w in words]
    for i, w in enumerate(words):
        form = hits.get(w)
        if form:
            quoted = inside or (marks[i] >= 2) or (marks[i] == 1 and w[0] in QUOTES)
            before, after = words[max(0, i - REACH):i], words[i + 1:i + REACH + 1]
            factor = 1.0
            if quoted or any(clean[x] in REPORTING for x in before):
                factor = 0.3 if quoted else 0.6
            if any(clean[x] in ADDRESS for x in before + after):
                factor *= 1.5
            found.append((i, *(factor * x for x in form)))
        if marks[i] % 2:
            # A mark without its partner within reach opens nothing.
            inside = not inside and any(marks[i + 1:i + 1 + 4 * REACH])
    certain, doubtful, learned = (sum(f[k] for f in found) for k in (1, 2, 3))
    window, first, top, several = 0.0, 0, 0.0, 0.0
    unsure: dict[str, list[float]] = {}  # doubtful words of the window, and what each place adds
    for i, c, d, _ in found:
        window += c
        if d:
            unsure.setdefault(clean[words[i]], []).append(d)
        while found[first][0] < i - REACH:
            window -= found[first][1]
            if found[first][2]:
                unsure[clean[words[found[first][0]]]].pop(0)
            first += 1
        top = max(top, window)
        if d:
            several = max(several, sum(max(x) + REPEATED * (sum(x) - max(x)) for x in unsure.values() if x) - 1)
    return [
        math.log1p(certain), math.log1p(doubtful), math.log1p(learned), min(top, 3.0),
        *(min(100 * x / len(words), 10.0) / 10 for x in (certain, learned)),
        min(several, 3.0), min(100 * doubtful / len(words), 10.0) / 10,
    ]


#: Weights before anything is learned: one certain hit outside quotation is toxic, a doubtful one is not, several together are.
START = np.array([-3.0, 4.0, 0.4, 1.5, 1.5, 1.0, 3.0, 2.0, 1.5])


def fit(x: np.ndarray, y: np.ndarray, pull: float = 5.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps, pulled towards ``START`` so that rare features keep a sensible sign."""
    x = np.hstack([np.ones((len(x), 1)), x]) if len(x) else np.zeros((0, len(START)))
    w = START.copy()
    if len(set(y.tolist())) < 2:
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - START))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """At most ``SAMPLE`` labelled rows that are not held out: (text, toxic, half)."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.md5(F.col(key).cast("string")), key)
        .limit(SAMPLE)
        .withColumnRenamed(key, "_key")
    )
    # The chosen keys are at most SAMPLE rows.
    rows = docs.select(key, "text").join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    return rows.groupBy(key).agg(F.max(whole_text()).alias("text"), F.max("_toxic").alias("toxic")).select(
        "text", "toxic", (F.crc32(F.concat(F.col(key).cast("string"), F.lit("half")).cast("binary")) % 2).alias("half")
    )


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems that mark the toxic rows of the sample, with weights up to 1.

    Words that meet a given term are left out: they need no learning. Of stems
    that contain each other the shortest that is precise enough is kept.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    words = sample.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    given = F.array(*[F.lit(t) for t in TERMS])
    stems = words.select(
        "toxic",
        F.explode(F.array_distinct(F.flatten(F.transform(
            F.filter(F.array_except("w", given), lambda w: F.length(w) >= STEMS[0]),
            lambda w: F.transform(
                F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length(w))), lambda n: F.substring(w, F.lit(1), n)
            ),
        )))).alias("stem"),
    )
    counts = stems.groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    bad, good = F.col("bad") / sizes[1], (F.col("good") + 2) / sizes[0]
    top = (
        counts.where((F.col("bad") >= max(SUPPORT, 0.004 * sizes[1])) & (bad / (bad + good) >= PRECISION))
        .select("stem", F.least(F.log(bad / good) / 5, F.lit(1.0)).alias("weight"))
        .collect()
    )
    found: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"][:n] in found for n in range(STEMS[0], len(r["stem"]))):
            found[r["stem"]] = r["weight"]
    return found


class Model:
    """Terms and weights; the automaton is built again in every worker."""

    def __init__(self, words: list[str], stems: dict[str, float], weights: list[float], ordinary: frozenset[str] = ORDINARY):
        self.words, self.stems, self.weights, self.ordinary = words, stems, weights, ordinary

    def key(self) -> tuple:
        return tuple(self.words), tuple(self.stems.items()), self.ordinary


_automata: dict[tuple, Automaton] = {}


def _each(texts: Iterator[pa.Array], model: Model, of: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``of(text, automaton)`` of every text, a few megabytes at a time."""
    automaton = automaton_of(model)
    for batch in texts:
        found: list = []
        for part in texts_by_bytes(batch):
            found += [of(t or "", automaton) for t in part]
        yield pa.array(found, kind)


def automaton_of(model: Model) -> Automaton:
    """One automaton a worker process for a model's terms."""
    working("toxicity", _automata.clear)
    key = model.key()
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(model.words, model.stems, model.ordinary)
    return _automata[key]


def learn_ordinary(sample: DataFrame, stems: dict[str, float]) -> frozenset[str]:
    """``ORDINARY`` and the words near a term or stem that are at least as frequent in clean rows, in two or more, as in toxic ones."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0):
        return ORDINARY
    model = Model(list(TERMS), stems, START.tolist())

    def doubtful(text: str, automaton: Automaton) -> list[str]:
        return sorted(w for w in {w.strip(EDGE) for w in text.lower().split()} if (automaton.match(w) or (0, 0))[1])

    @arrow_udf("array<string>")
    def near(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(texts, model, doubtful, pa.list_(pa.string()))

    counts = sample.select("toxic", F.explode(near("text")).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    common = F.col("good") / sizes[0] >= F.col("bad") / max(sizes.get(1, 0), 1)
    rows = counts.where((F.col("good") >= 2) & common).select("word").collect()
    return ORDINARY | {r["word"] for r in rows}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    python_workers(docs.sparkSession)
    sample = stage(labelled(docs, labels, key), "toxicity-sample")
    # Stems look better on the rows they were learned from, so the weights are
    # fitted on the half that the stems of this step have not seen.
    half = sample.where("half = 0")
    stems = learn_stems(half)
    model = Model(list(TERMS), stems, START.tolist(), learn_ordinary(half, stems))

    @arrow_udf("array<double>")
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(texts, model, features, pa.list_(pa.float64()))

    rows = sample.where("half = 1").select(measured("text").alias("x"), "toxic").collect()  # at most SAMPLE short rows
    rows.sort()
    weights = fit(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    stems = learn_stems(sample)
    return Model(list(TERMS), stems, weights.tolist(), learn_ordinary(sample, stems))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability ``out`` that the text is toxic."""
    python_workers(df.sparkSession)

    def one(x: str, automaton: Automaton) -> float:
        w = model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], features(x, automaton), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    @arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(texts, model, one, pa.float64())

    return df.withColumn(out, scored(whole_text(text)))
