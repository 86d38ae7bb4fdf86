"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a clause is read as a string over seven symbol classes:
INSULT, THREAT, OBJECT, SUBJECT, INTENT, NEGATION and REPORT (other words are skipped).
Five small automata read the same string - the insult transducer (an insult, aimed at a
person or not), the threat transducer (a verb of harm that has a person as its object,
with or without an intent), targets, negation in front of what it denies, and reported
speech - and are composed into one machine. Nothing is scored before a clause ends: its
final state says what the clause is, and the arc weights below what that counts:

* an insult clause counts the learnt weights of its insults, AIMED times as much with a
  person in it;
* a threat clause needs verb and object (``kill time`` is none) and counts THREAT_WEIGHT,
  less without an intent;
* a denied clause counts NEGATED times, a reported one REPORTED times as much.

So aiming never lowers a score and denying or quoting never raises one, whatever the
labels are. A text's evidence is the sum over its clauses; a logistic curve gives the
score, which rises with the logarithm of the evidence and falls with that of the number
of clauses (both slopes are zero at least).

Learnt from a bounded sample of labelled rows (:mod:`pagelore.llm._labels`): the insult
lexicon - whole words and word stems whose log-odds between toxic and other texts are
high - and the curve. The curve is fitted on rows that the lexicon of that step has not
seen, so words that merely memorise their texts don't make it steep; then the lexicon is
learnt from all rows. Of near copies in the sample only one is learnt from. Cue lists and
arc weights are fixed values.

Defined cases: null or empty text has no clause and gets the base score, as does a text
with no matched clause; a null doc_id is scored, its held_out is null; equal texts tie,
repeated rows are scored each; a table without labels of both kinds yields the constant
score 0; an empty table gives no rows; very long texts are scanned in full, clause by
clause; of several labels of a doc_id the largest counts; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import Words, give_back, mix, shingle_hashes, table
from pagelore.llm._labels import labelled_sample

# Cue words of the grammar.
THREATS = ("kill", "hurt", "destroy", "murder", "beat", "burn", "shoot", "stab", "strangle", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear")
OBJECTS = ("you", "your", "yours", "yourself", "u", "ur", "him", "her", "them", "dich", "dir", "euch", "dein", "toi", "vous", "ti", "usted", "ustedes")
SUBJECTS = ("he", "she", "they", "du", "ihr", "er", "tu", "il", "elle", "ils", "ellos")
INTENTS = ("will", "i'll", "we'll", "gonna", "going", "shall", "should", "must", "werde", "werden", "vais", "allons", "voy", "vamos")
NEGATIONS = ("not", "no", "never", "none", "isn't", "aren't", "wasn't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "ne", "nunca", "ni")
REPORTS = ("said", "says", "called", "calls", "quoted", "quotes", "wrote", "claimed", "alleged", "sagte", "nannte", "dit", "appelé", "dijo", "llamó")

INSULT, THREAT, OBJECT, SUBJECT, INTENT, NEGATION, REPORT = range(7)
_WORD_OR_STOP = re.compile(r"[\w'’]+|[.!?;\n]+")
_STOP = re.compile(r"[.!?;\n]")

# Arc weights of the grammar.
AIMED, NEGATED, REPORTED = 1.5, 0.1, 0.5
THREAT_WEIGHT, WITHOUT_INTENT = 24.0, 0.5


@dataclass
class Grammar:
    """The composed machine with its learnt lexicon and curve."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    length: float = 0.0
    bias: float = 0.0
    constant: bool = True

    def symbol(self, word: str) -> tuple[int, float] | None:
        if word in self.words:
            return INSULT, self.words[word]
        for n in range(min(len(word), STEM[1]), STEM[0] - 1, -1):
            if word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return _CUES.get(word)


_CUES: dict[str, tuple[int, float]] = {}
for _kind, _list in ((THREAT, THREATS), (OBJECT, OBJECTS), (SUBJECT, SUBJECTS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
    for _w in _list:
        _CUES[_w] = (_kind, 1.0)

#: Lengths of learnt stems, in characters.
STEM = (4, 8)

Automaton = list[list[int]]


def _automaton(states: int, arcs: dict[tuple[int, int], int]) -> Automaton:
    """Rows of next states by symbol; without an arc the state stays."""
    return [[arcs.get((s, symbol), s) for symbol in range(7)] for s in range(states)]


def _compose(parts: list[Automaton]) -> Automaton:
    """The product of automata that read the same string; a state's number has their states as digits."""
    out: Automaton = [[0] * 7]
    size = 1
    for part in parts:
        out = [[out[a][x] + size * part[b][x] for x in range(7)] for b in range(len(part)) for a in range(size)]
        size *= len(part)
    return out


#: 1 insult, 2 insult and a person (either first); 3 only the person so far.
_INSULT = _automaton(4, {(0, INSULT): 1, (3, INSULT): 2, **{(a, x): b for x in (OBJECT, SUBJECT) for a, b in ((0, 3), (1, 2))}})
#: Bits: 1 a verb of harm, 2 an object.
_THREAT = _automaton(4, {(0, THREAT): 1, (2, THREAT): 3, (0, OBJECT): 2, (1, OBJECT): 3})
_INTENT = _automaton(2, {(0, INTENT): 1})
#: 1 a negation, 2 one in front of what it denies, 3 an insult or verb that none stands before.
_NEGATION = _automaton(4, {(0, NEGATION): 1, **{(a, x): b for x in (INSULT, THREAT) for a, b in ((0, 3), (1, 2))}})
_REPORT = _automaton(2, {(0, REPORT): 1})
MACHINE = _compose([_INSULT, _THREAT, _INTENT, _NEGATION, _REPORT])


def _output(state: int) -> tuple[float, float]:
    """(what the clause's insult weights count, what its threat counts) by the final state."""
    state, insult = divmod(state, 4)
    state, threat = divmod(state, 4)
    state, intent = divmod(state, 2)
    report, negation = divmod(state, 4)
    by = (NEGATED if negation == 2 else 1.0) * (REPORTED if report else 1.0)
    return by * (AIMED if insult == 2 else 1.0 if insult == 1 else 0.0), by * (THREAT_WEIGHT * (1.0 if intent else WITHOUT_INTENT) if threat == 3 else 0.0)


OUTPUTS = [_output(s) for s in range(len(MACHINE))]

Seen = dict[str, tuple[int, float] | None]


def evidence(text: str, grammar: Grammar, seen: Seen) -> tuple[float, int]:
    """(the sum of what the text's clauses count, number of clause ends). ``seen`` remembers words' symbols."""
    total, state, insults, ends = 0.0, 0, 0.0, 0
    for token in _WORD_OR_STOP.findall(text.lower()):
        try:
            hit = seen[token]
        except KeyError:
            if len(seen) > 100_000:  # bounded memory, whatever the vocabulary
                seen.clear()
            hit = seen[token] = (-1, 0.0) if _STOP.match(token) else grammar.symbol(token)
        if hit is None:
            continue
        symbol, weight = hit
        if symbol < 0:
            ends += 1
            if state:
                aimed, threat = OUTPUTS[state]
                total += insults * aimed + threat
                state, insults = 0, 0.0
            continue
        if symbol == INSULT:
            insults += weight
        state = MACHINE[state][symbol]
    aimed, threat = OUTPUTS[state]
    return total + insults * aimed + threat, ends


def text_score(text: str | None, grammar: Grammar, seen: Seen) -> float:
    """Between 0 and 1, from the whole text."""
    if grammar.constant:
        return 0.0
    found, ends = evidence(text, grammar, seen) if text else (0.0, 0)
    z = grammar.bias + grammar.slope * math.log1p(found) - grammar.length * math.log1p(ends)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _lexicon(texts: list[str], y: np.ndarray, least: int = 8, odds: float = 3.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic texts, with their capped log-odds: how much more often
    they occur among the words of toxic texts than among those of others.

    Each must stand in ``least`` toxic texts, so no text's own words count however often
    they repeat. A stem must carry three words; of stems that hold each other the most
    frequent stays, and the longest of equally frequent ones."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in _WORD_OR_STOP.findall(t.lower()) if not _STOP.match(w)], np.int64) for t in texts]
    names, none = list(number), [np.zeros(0, np.int64)]
    count = np.stack([np.bincount(np.concatenate(none + [v for v, c in zip(docs, y, strict=True) if c == k]), minlength=len(names)) for k in (0, 1)])
    total = count.sum(1)
    odd = lambda c: float(np.log((c[1] + 0.5) / (total[1] + 1)) - np.log((c[0] + 0.5) / (total[0] + 1)))
    prefixes = lambda w: [w[:m] for m in range(STEM[0], min(len(w), STEM[1]) + 1)]
    stems: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # occurrences elsewhere, in toxic texts, words
    for i in np.flatnonzero(count[1]).tolist():
        for p in prefixes(names[i]):
            at = stems[p]
            at[1] += int(count[1][i])
            at[2] += 1
    for i in np.flatnonzero(count[0]).tolist():
        for p in prefixes(names[i]):
            if p in stems:
                stems[p][0] += int(count[0][i])
    toxic = [{names[i] for i in np.unique(v).tolist()} for v, k in zip(docs, y, strict=True) if k == 1]
    marks = {p for p, c in stems.items() if c[2] >= 3 and c[1] >= least and odd(c) >= odds}
    stands = Counter(p for v in toxic for p in {p for w in v for p in prefixes(w) if p in marks})
    found_stems: dict[str, float] = {}
    for p in sorted(marks, key=lambda p: (-stems[p][1], -len(p), p)):
        if stands[p] >= least and not any(p.startswith(f) or f.startswith(p) for f in found_stems):
            found_stems[p] = min(odd(stems[p]), 6.0)
    marked = lambda w: any(p in found_stems for p in prefixes(w))
    often = Counter(w for v in toxic for w in v)
    found_words = {w: min(odd(count[:, number[w]]), 6.0) for w, n in often.items() if n >= least and odd(count[:, number[w]]) >= odds and not marked(w)}
    return _explained(found_words, found_stems, [{w for w in v if w in found_words or marked(w)} for v in toxic], {w: int(count[0][number[w]]) for w in found_words}, least)


def _explained(words: dict[str, float], stems: dict[str, float], toxic: list[set[str]], clean: dict[str, int], least: int) -> tuple[dict[str, float], dict[str, float]]:
    """Without words that only keep company with others: from the most frequent entry down,
    a word that isn't frequent must mark enough toxic texts that no entry before it does."""
    places: dict[str, set[int]] = defaultdict(set)
    covered: set[int] = set()
    for i, v in enumerate(toxic):
        for w in v:
            if w in words:
                places[w].add(i)
            elif any(w[:m] in stems for m in range(STEM[0], STEM[1] + 1)):
                covered.add(i)
    kept = {}
    for w in sorted(words, key=lambda w: (-len(places[w]), w)):
        alone = len(places[w] - covered)
        if len(places[w]) >= max(least, 0.02 * len(toxic)) or (2 * alone >= least and alone >= 0.75 * (alone + clean[w])):
            kept[w] = words[w]
            covered |= places[w]
    return kept, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps of ridge logistic regression."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + ridge * len(y) * np.append(w[:-1], 0) / 10
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(np.append(np.full(x.shape[1], ridge * len(y) / 10), 1e-9))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _no_near_copies(texts: list[str]) -> list[int]:
    """The numbers of texts that share fewer than two of four MinHash values (of word pairs) with an earlier one."""
    first: dict[tuple[int, int], int] = {}
    out = []
    for i, t in enumerate(texts):
        raw = t.encode()
        h = shingle_hashes(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash, 2)
        low = [(k, int((h * seed).min())) for k, seed in enumerate(_COPY_SEEDS)] if len(h) else [(4, zlib.crc32(raw))]
        same = Counter(first[x] for x in low if x in first)
        if same and max(same.values()) >= min(2, len(low)):
            continue
        for x in low:
            first.setdefault(x, i)
        out.append(i)
    return out


_COPY_SEEDS = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def fit(texts: list[str], labels: list[int]) -> Grammar:
    """Lexicon on one half of the rows, curve on the other half's evidence by it (and the
    halves changed about, so that every row is used); then the lexicon over all rows."""
    if len(set(labels)) < 2:
        return Grammar(constant=True)
    own = [_no_near_copies([t for t, c in zip(texts, labels, strict=True) if c == k]) for k in (0, 1)]
    kind = [[t for t, c in zip(texts, labels, strict=True) if c == k] for k in (0, 1)]
    texts = [kind[k][i] for k in (0, 1) for i in own[k]]
    y = np.repeat([0, 1], [len(own[0]), len(own[1])])
    half = np.arange(len(y)) % 2
    x = np.zeros((len(y), 2))
    for k in (0, 1):
        g, seen = Grammar(*_lexicon([texts[i] for i in np.flatnonzero(half == k).tolist()], y[half == k])), {}
        for i in np.flatnonzero(half != k).tolist():
            x[i] = np.log1p(evidence(texts[i], g, seen))
    w, bias = _logistic(x, y)
    if w[1] > 0:  # a longer text alone is no evidence
        (one, bias), w = _logistic(x[:, :1], y), np.zeros(2)
        w[0] = one[0]
    return Grammar(*_lexicon(texts, y), slope=max(0.0, float(w[0])), length=max(0.0, -float(w[1])), bias=bias, constant=False)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_chars: int = 30_000_000, fold: int = 5, held: int = 0) -> Grammar:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; scoring covers
    every row and whole texts."""
    return fit(*labelled_sample(docs, labels, "toxic", fold, held, max_rows, max_chars))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score for every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # lexicon of at most some thousand entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, seen = shared.value, {}
        for b in batches:
            b["score"] = [text_score(t, g, seen) for t in b.pop("__t")]
            yield b
        seen.clear()
        give_back()

    return docs.select("doc_id", F.col("text").alias("__t")).mapInPandas(run, "doc_id long, score double")


def toxic_flag(grammar: Grammar, spark: SparkSession, threshold: float = 0.5):
    """A boolean column function: does a text reach the threshold?"""
    shared = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf("boolean")
    def flag(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g, seen = shared.value, {}
        for text in parts:
            yield text.map(lambda t: text_score(t, g, seen) >= threshold).astype(bool)
        seen.clear()
        give_back()

    return flag


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    flag = toxic_flag(train(docs, labels), docs.sparkSession, threshold)
    return docs.where(~flag(F.coalesce("text", F.lit(""))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
