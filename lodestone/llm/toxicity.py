"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into classes: insults (stems learned from labelled documents), threats, targets, negations and
verbs of speech.  Sequential transducers, composed into one machine, read a text's classes clause by clause and mark
each insult or threat with its setting: plain, aimed at somebody, negated, or reported.  Speech that is named before its
words, or opens a quotation, is found from left to right; "..., he wrote" after the words is found by a machine that reads
from right to left first.  Weighted counts of marked clauses, not of words, give the score; the weight of each kind of
marked clause, and the strength of each insult and threat, are learned.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, crc_bucket, map_arrow
from .labelled import bounded_sample

#: The bounded sample that stems and weights are learned from.
MAX_DOCS, MAX_CHARS = 8000, 16_000
#: A stem: this long; in so many toxic documents and so large a share of them; in at most this share of clean ones, as against these.
STEM_CHARS, STEM_DOCS, STEM_SHARE, STEM_CLEAN = range(4, 15), 3, 0.01, 0.15
#: And so many standard deviations more toxic documents than chance gives.
STEM_SURPRISE = 6.5
#: The share of toxic documents for which a longer stem is preferred.
STEM_KEPT = 0.8
THRESHOLD = 0.5

# Fixed word lists, by class.
WORDS = {
    "threat": "kill killing hurt beat burn destroy shoot stab strangle crush smash töten schlagen verbrennen zerstören tuer frapper brûler détruire matar golpear quemar destruir",
    "target": "you your yours yourself u ur he she him her they them du dich dir ihr euch sie er tu toi te vous votre il elle eux tú ti usted ustedes él ella ellos",
    "negation": "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás sin tampoco",
    "speech": "said says say wrote writes quoted claimed reported told called sagte schrieb behauptete berichtete zitierte dit écrit déclare rapporte prétend dijo escribió afirmó informó citó",
}
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;:,\n\"]")
#: Signs that are read as plain ones.
_PLAIN = str.maketrans({"\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"', "\u00bb": '"'})
#: So many words before an insult or threat, a negation or target still bears on it.
NEGATION_REACH, TARGET_REACH = 3, 4
#: A verb of speech after a quotation or comma is so many words from it at most: "..., the old man said".
SPEECH_REACH = 4
#: Classes of the lexicon's output and the settings the transducers add.
BASES, OTHER, BREAK = ("insult", "threat"), "-", "|"
#: The end of a line, a colon, a comma and a quotation mark; all but these end a clause by BREAK.
LINE, COLON, COMMA, QUOTE = "/", ":", ",", '"'
_SIGNS = {"\n": LINE, ":": COLON, ",": COMMA, '"': QUOTE}
#: Weights of the settings, before the learned ones: a setting that excuses a clause counts below one.
REPORTED, NEGATED, AIMED, AGAIN = 0.7, 0.5, 1.5, 1.3
#: Strength of a threat of which the labelled documents tell nothing.
THREAT_STRENGTH = 3.0
SETTINGS = ("negated", "reported", "aimed")
EVENTS = tuple("+".join((base, *marks)) for base in BASES for n in range(4) for marks in itertools.combinations(SETTINGS, n))


class Transducer:
    """A sequential weighted transducer: ``arcs[state][symbol]`` is (next state, output symbol, weight)."""

    def __init__(self, arcs: list[dict[str, tuple[int, str, float]]]) -> None:
        self.arcs = arcs

    def compose(self, then: Transducer) -> Transducer:
        """The machine that gives this one's output to ``then``; weights multiply.  Only reachable states are made."""
        number = {(0, 0): 0}
        todo, arcs = [(0, 0)], []
        for a, b in todo:
            out = {}
            for symbol, (a2, middle, w) in self.arcs[a].items():
                b2, last, v = then.arcs[b][middle]
                if (a2, b2) not in number:
                    number[a2, b2] = len(todo)
                    todo.append((a2, b2))
                out[symbol] = (number[a2, b2], last, w * v)
            arcs.append(out)
        return Transducer(arcs)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for s in symbols:
            state, o, w = self.arcs[state][s]
            out.append((o, w))
        return out


_INPUT = (OTHER, BREAK, LINE, COLON, COMMA, QUOTE, "target", "negation", "speech", *EVENTS)
_ENDS = (BREAK, LINE, COLON, QUOTE)


def _marked(symbol: str, setting: str) -> str | None:
    """The event with ``setting`` added; None for what is no event or has it."""
    base, *marks = symbol.split("+")
    if base not in BASES or setting in marks:
        return None
    return "+".join((base, *(m for m in SETTINGS if m in marks or m == setting)))


def _marker(trigger: str, setting: str, reach: int, weight: float) -> Transducer:
    """Adds ``setting`` to insults and threats within ``reach`` words after ``trigger``, up to the clause's end."""
    arcs = []
    for state in range(reach + 1):
        out = {}
        for s in _INPUT:
            after = 0 if s in _ENDS else reach if s == trigger else state if s == COMMA else max(state - 1, 0)
            marked = _marked(s, setting) if state else None
            out[s] = (after, marked or s, weight if marked else 1.0)
        arcs.append(out)
    return Transducer(arcs)


def _reporter(steps: dict[tuple[str, str], str], inside: tuple[str, ...], weight: float) -> Transducer:
    """Marks what is said in the states ``inside``.  ``steps``: the state after a state and sign; others stay as they are."""
    names = ["out", *dict.fromkeys([k for k, _ in steps] + list(steps.values()))]
    names = list(dict.fromkeys(names))
    arcs = []
    for state in names:
        out = {}
        for s in _INPUT:
            kind = "word" if s in (OTHER, "target", "negation", *EVENTS) else s
            after = names.index(steps.get((state, s), steps.get((state, kind), state)))
            marked = _marked(s, "reported") if state in inside else None
            out[s] = (after, marked or s, weight if marked else 1.0)
        arcs.append(out)
    return Transducer(arcs)


def _reported_before(weight: float) -> Transducer:
    """From left to right: a verb of speech reports up to its clause's end, past a colon, and all of a quotation that it opens."""
    steps = {("out", "speech"): "said", ("said", BREAK): "out", ("said", LINE): "out", ("said", QUOTE): "quoted", ("quoted", QUOTE): "out", ("quoted", LINE): "out"}
    return _reporter(steps, ("said", "quoted"), weight)


def _reported_after(weight: float) -> Transducer:
    """From right to left: a verb of speech right after a comma or quotation reports the clause, or all of the quotation, before it."""
    steps: dict[tuple[str, str], str] = {}
    for i in range(SPEECH_REACH):
        name = f"verb{i}"
        steps |= {(name, "word"): f"verb{i + 1}" if i + 1 < SPEECH_REACH else "out", (name, "speech"): "verb0", (name, COMMA): "comma", (name, QUOTE): "quoted"}
        steps |= {(name, s): "out" for s in (BREAK, LINE, COLON)}
    steps |= {("out", "speech"): "verb0", ("comma", QUOTE): "quoted", ("comma", "word"): "clause", ("comma", "speech"): "clause", ("comma", BREAK): "out", ("comma", LINE): "out"}
    steps |= {("clause", BREAK): "out", ("clause", LINE): "out", ("clause", QUOTE): "out", ("quoted", QUOTE): "out", ("quoted", LINE): "out"}
    return _reporter(steps, ("comma", "clause", "quoted"), weight)


def _repeater(base: str, weight: float) -> Transducer:
    """A second ``base`` in one clause weighs more."""
    return Transducer([{s: (0 if s in _ENDS else 1 if s.split("+")[0] == base else state, s, weight if state and s.split("+")[0] == base else 1.0) for s in _INPUT} for state in (0, 1)])


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads from right to left first, and reported speech, negation, target, insult and threat, composed."""
    machine = _reported_before(REPORTED)
    for part in (_marker("negation", "negated", NEGATION_REACH, NEGATED), _marker("target", "aimed", TARGET_REACH, AIMED), _repeater("insult", AGAIN), _repeater("threat", AGAIN)):
        machine = machine.compose(part)
    return _reported_after(REPORTED), machine


def marked_clauses(symbols: list[str], machines: tuple[Transducer, Transducer]) -> list[tuple[str, float]]:
    """Each symbol as the machines mark it, and its weight."""
    back, ahead = machines
    first = back.run(symbols[::-1])[::-1]
    return [(o, w * v) for (o, w), (_, v) in zip(ahead.run([s for s, _ in first]), first)]


def learn_stems(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Word beginnings that toxic documents have and clean ones don't, with their log odds (at most 6).

    A beginning gives way to a longer one that keeps most of its toxic documents, and to a shorter one that was chosen.  Copies
    of a whole text count once.
    """
    bad, good = Counter(), Counter()
    once = dict.fromkeys(zip(texts, toxic))
    n = Counter(y for _, y in once)
    for text, y in once:
        found = {w[:k] for w in set(re.findall(r"[^\W_]+", text.lower())) for k in STEM_CHARS if len(w) >= k}
        (bad if y else good).update(found)
    odds = lambda s: math.log((bad[s] + 0.5) / (n[1] + 1)) - math.log((good[s] + 0.5) / (n[0] + 1))
    expected = lambda s: good[s] * (n[1] + 1) / (n[0] + 1)
    likely = {s for s, c in bad.items() if c >= max(STEM_DOCS, STEM_SHARE * n[1]) and c - expected(s) >= STEM_SURPRISE * math.sqrt(expected(s) + 1) and expected(s) <= STEM_CLEAN * c and odds(s) > 1.5}
    longer = defaultdict(list)
    for s in likely:
        longer[s[:-1]].append(s)
    closed = [s for s in likely if not any(bad[x] >= STEM_KEPT * bad[s] for x in longer[s])]
    chosen: dict[str, float] = {}
    for s in sorted(closed, key=lambda s: (-bad[s], len(s), s)):
        if not any(s[:k] in chosen for k in range(STEM_CHARS[0], len(s))):
            chosen[s] = min(odds(s), 6.0)
    return chosen


class ToxicityGrammar:
    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.words = {w: kind for kind, words in WORDS.items() for w in words.split()}
        self.threats = dict.fromkeys(WORDS["threat"].split(), THREAT_STRENGTH)
        self.machines = grammar()
        self.beta = np.zeros(len(EVENTS) + 2)
        self._matcher = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def _seen(self, text: str) -> bool:
        """Whether any insult or threat occurs at all; most texts need no more than this."""
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for s in [*self.stems, *(w for w, k in self.words.items() if k == "threat")]:
                self._matcher.add_word(s, s)
            self._matcher.make_automaton()
        return bool(len(self._matcher)) and next(self._matcher.iter(text), None) is not None

    def _stem(self, word: str) -> float:
        return max((self.stems.get(word[:k], 0.0) for k in STEM_CHARS if k <= len(word)), default=0.0)

    def symbols(self, text: str) -> tuple[list[str], list[float]]:
        """The classes of a lower-case text's words and signs, and their strengths."""
        symbols, strength = [], []
        for m in _WORD.finditer(text.translate(_PLAIN)):
            word = m[0]
            weight = self._stem(word) if len(word) >= STEM_CHARS[0] else 0.0
            kind = "insult" if weight else self.words.get(word) or (OTHER if word[0].isalnum() else _SIGNS.get(word, BREAK))
            symbols.append(kind)
            strength.append(weight or self.threats.get(word, 0.0))
        return symbols, strength

    def events(self, text: str) -> np.ndarray:
        """For each kind of marked clause, the log of one plus the weights of its insults and threats; last, the same of all per 100 words.

        Long clean texts meet a stem now and then by chance, which their density tells.
        """
        out = np.zeros(len(EVENTS) + 1)
        text = text.lower()
        if not self._seen(text):
            return out
        symbols, strength = self.symbols(text)
        at = {e: i for i, e in enumerate(EVENTS)}
        for (symbol, weight), s in zip(marked_clauses(symbols, self.machines), strength):
            if symbol in at:
                out[at[symbol]] += weight * s
        out[-1] = 100 * out.sum() / max(len(symbols), 100)
        return np.log1p(out)

    def _learn_threats(self, texts: list[str], toxic: list[int]) -> None:
        """A threat's log odds among toxic documents, drawn towards THREAT_STRENGTH where few have it, from 0 to 6."""
        n = Counter(toxic)
        found = {0: Counter(), 1: Counter()}
        for text, y in dict.fromkeys(zip(texts, toxic)):
            found[y].update(set(re.findall(r"[^\W_]+", text.lower())) & self.threats.keys())
        for word in self.threats:
            bad, good = found[1][word], found[0][word]
            odds = math.log((bad + 0.5) / (n[1] + 1)) - math.log((good + 0.5) / (n[0] + 1))
            told = (bad + good) / (bad + good + 5)
            self.threats[word] = min(max(told * odds + (1 - told) * THREAT_STRENGTH, 0.0), 6.0)

    def fit(self, texts: list[str], toxic: list[int], rounds: int = 30, ridge: float = 0.05) -> ToxicityGrammar:
        """Threats' strengths, then logistic regression on the events by Newton's method."""
        self._learn_threats(texts, toxic)
        x = np.hstack((np.array([self.events(t) for t in texts]).reshape(len(texts), len(EVENTS) + 1), np.ones((len(texts), 1))))
        y = np.array(toxic, float)
        if len(set(toxic)) < 2:
            share = (y.sum() + 0.5) / (len(y) + 1)
            self.beta[-1] = math.log(share / (1 - share))
            return self
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))
            hessian = (x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9)
            step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * self.beta)
            self.beta = self.beta + step / max(1.0, np.abs(step).max() / 2)
        return self

    def score(self, text: str) -> float:
        z = float(self.events(text) @ self.beta[:-1] + self.beta[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ToxicityGrammar:
    """Trained on at most ``max_docs`` labelled documents whose crc32 bucket of 5 isn't 0.

    Of a text beyond ``max_chars`` runs over the whole of it are learned from.  Without labels, or with one value only, all
    texts get that share as their score.
    """
    sample = bounded_sample(docs, labels, F.col("toxic").cast("int"), crc_bucket(F.col(id_col), 5) != 0, max_docs, max_chars, id_col, text_col)
    texts, toxic = [t for t, _ in sample], [int(y > 0) for _, y in sample]
    return ToxicityGrammar(learn_stems(texts, toxic)).fit(texts, toxic)


def score_toxicity(docs: DataFrame, model: ToxicityGrammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: whole texts, null as empty; a null id isn't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.decode("utf-8", "replace")) for t in texts], pa.float64())], ["doc_id", "score"])

    scored = map_arrow(rows, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
