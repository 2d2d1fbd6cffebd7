"""Toxicity by a lexicon trie intersected with Levenshtein automata and scored in context windows.

The lexicon is a short general list of insults and the stems that labelled training documents show
to go with toxicity. A lazily determinised automaton accepts each term within its edit distance:
its states are sets of (trie node, edits so far). Every distinct word is run through it once. Each hit
then weighs by its window: less inside quotation or reported speech, more in direct address.
A logistic model turns a document's hits into its score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_logistic, logistic, training_sample

# A general list of insults, leet letters, endings of inflected words, and words that tell the kind of a window.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumb", "fool", "loser", "scum", "trash", "garbage", "filth", "vermin", "pathetic", "worthless", "disgusting", "clown", "jerk", "creep", "bastard", "degenerate")
LEET = str.maketrans("01345789@$!|", "oieastbgasii")
ENDINGS = frozenset("s es 's ed d er ers est ing ings ish ity ities ly ness ion ions y ic al able ous ment ments ism ist ists".split())
REPORTING = frozenset("said says wrote writes called calls quote quoted reported reports tweeted headline according".split())
ADDRESS = frozenset("you your you're youre u ur".split())
QUOTES = "\"'“”«»‘’"

WINDOW = 8
QUOTED_FACTOR, ADDRESS_FACTOR, FUZZY_FACTOR = 0.1, 1.25, 0.8
#: Fitting: at most about so many labelled documents; least support of a learned stem.
MAX_FIT_DOCS, LEAST_DOCS, LEAST_G2 = 8_000, 6, 30.0
#: Words whose result a worker remembers.
CACHE_WORDS = 200_000


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Lexicon trie x Levenshtein automaton, determinised as words need it.

    ``match(word)`` returns (term, edits) or None: the term that the word starts with, else the one
    nearest to the whole word within the term's allowed edits (insertion, deletion, substitution or
    swap of neighbours), else the one nearest to a beginning of five letters or more that an ending of ``ENDINGS`` follows, so that
    inflections of misspelled terms are found as those of others are.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.slack = [0]
        for t in sorted(terms):
            node = 0
            self.slack[0] = max(self.slack[0], edits_allowed(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], edits_allowed(t))
            self.term[node] = t
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem: list[str | None] = []
        self.final: list[tuple[str, int] | None] = []
        self.alphabet = {c for kids in self.children for c in kids}
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        """Close under deletions and drop what has used up its edits; the number of the state, -1 if dead."""
        todo, closed = list(items), set()
        while todo:
            node, e, wait = item = todo.pop()
            if e > self.slack[node] or item in closed:
                continue
            closed.add(item)
            if not wait:
                todo += [(kid, e + 1, "") for kid in self.children[node].values()]
        if not closed:
            return -1
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = sorted((e, self.term[n]) for n, e, wait in key if not wait and self.term[n] and e <= edits_allowed(self.term[n]))
            self.final.append((ends[0][1], ends[0][0]) if ends else None)
            self.stem.append(next((t for e, t in ends if e == 0), None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:
                if c == wait:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))  # an extra character
            for k, kid in self.children[node].items():
                out.add((kid, e if k == c else e + 1, ""))
                if k != c and c in self.children[kid]:
                    out.add((self.children[kid][c], e + 1, k))  # two neighbours swapped
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        state, stem, begins = self.start, None, None
        for n, c in enumerate(word, 1):
            c = c if c in self.alphabet else "\0"
            moves = self.moves[state]
            nxt = moves.get(c)
            if nxt is None:
                nxt = moves[c] = self._move(state, c)
            if nxt < 0:
                return (stem, 0) if stem else begins
            state = nxt
            stem = self.stem[state] or stem
            if n >= 5 and (ends := self.final[state]) and (begins is None or ends[1] < begins[1]) and word[n:] in ENDINGS:
                begins = ends
        if stem:
            return stem, 0
        return self.final[state] if self.final[state] and len(word) >= 5 else begins


def clean_word(token: str) -> str:
    """A token's letters: outer signs stripped, leet digits read as letters, inner dots and dashes dropped."""
    if token.isalpha():
        return token
    token = token.strip(".,;:!?()[]{}<>#%&*-_=+/\\^~`" + QUOTES)
    if token.isalpha():
        return token
    if not any(c.isalpha() for c in token):
        return ""
    return "".join(c for c in token.translate(LEET) if c.isalpha())


@dataclass
class ToxicityModel:
    weight: dict[str, float]
    benign: frozenset[str] = frozenset()
    coef: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(list(model.weight))
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def look_up(self, words: set[str]) -> None:
        new = words - self.known
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.hits = set(), {}
            new = words
        match, benign = self.automaton.match, self.model.benign
        for token in new:
            word = clean_word(token)
            if word and (found := match(word)) and not (found[1] and word in benign):
                self.hits[token] = found
        self.known |= new

    def document_hits(self, tokens: list[str]) -> list[tuple[int, str, int]]:
        words = set(tokens)
        self.look_up(words)
        if words.isdisjoint(self.hits):
            return []
        return [(i, *self.hits[t]) for i, t in enumerate(tokens) if t in self.hits]

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        mass, terms, top = 0.0, set(), 0.0
        for i, term, edits in self.document_hits(tokens):
            w = self.model.weight[term] * (FUZZY_FACTOR if edits else 1.0) * self.context(tokens, i)
            mass += w
            terms.add(term)
            top = max(top, w)
        return [math.log1p(mass), math.log1p(1000 * mass / max(20, len(tokens))), math.log1p(len(terms)), top]

    @staticmethod
    def context(tokens: list[str], i: int) -> float:
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        token = tokens[i]
        opened = token[0] in QUOTES or any(t[0] in QUOTES and t[-1] not in QUOTES for t in before)
        closed = token[-1] in QUOTES or token.rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(t.rstrip(".,;:!?")[-1:] in tuple(QUOTES) and t[0] not in QUOTES for t in after)
        near = {t.strip(".,;:!?" + QUOTES) for t in before + after}
        if (opened and closed) or (near & REPORTING and (opened or closed)):
            return QUOTED_FACTOR
        return ADDRESS_FACTOR if near & ADDRESS else 1.0


def g2(a: int, b: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a of n1 against b of n0."""
    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, p) - part(b, n0, p))


def learn_terms(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Stems of four to nine letters that go with toxicity, with their log-odds; the general list besides."""
    n1, n0 = len(toxic), len(clean)
    stems = lambda words: {w[:k] for w in words for k in range(4, 10) if len(w) >= k}
    in_toxic = Counter(s for words in toxic for s in stems(words))
    wanted = {s for s, a in in_toxic.items() if a >= LEAST_DOCS}
    in_clean = Counter(s for words in clean for s in stems(words) & wanted)
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    found = []
    for s in wanted:
        a, b = in_toxic[s], in_clean[s]
        if n1 and n0 and a / n1 > 3 * b / n0 and (score := g2(a, b, n1, n0)) >= LEAST_G2:
            found.append((score, len(s), s, odds(a, b)))
    out = {t: 2.5 for t in INSULTS}
    for t in INSULTS:
        if in_toxic[t] >= LEAST_DOCS:
            out[t] = max(0.1, odds(in_toxic[t], in_clean[t]))
    for _, _, s, w in sorted(found, reverse=True):
        if not any(s.startswith(t) or t.startswith(s) for t in out):
            out[s] = w
    return out


def one_per_family(texts: list[str]) -> list[int]:
    """Places of texts that share none of their four smallest hashes of three words with an earlier one.

    A family of copies would otherwise make each of its words look like a sign of its label.
    """
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        grams = sorted({zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))})[:4]
        if seen.isdisjoint(grams):
            out.append(i)
        seen.update(grams)
    return out


def fit(sample: pd.DataFrame) -> ToxicityModel:
    """A model of labelled texts (text, label). Without both labels, the list alone with a fixed weight."""
    sample = sample.iloc[one_per_family(sample["text"].tolist())]
    y = sample["label"].to_numpy(float)
    words = [{c for w in set(t.lower().split()) if (c := clean_word(w))} for t in sample["text"]]
    toxic, clean = [w for w, k in zip(words, y, strict=True) if k], [w for w, k in zip(words, y, strict=True) if not k]
    model = ToxicityModel(learn_terms(toxic, clean))
    if not toxic or not clean:
        model.coef = np.array([1.0, 0.5, 0.0, 0.0, -3.0])
        return model
    automaton = LexiconAutomaton(list(model.weight))
    near = {w for w in set().union(*clean) if (m := automaton.match(w)) and m[1]}
    in_clean, in_toxic = Counter(w for d in clean for w in d & near), Counter(w for d in toxic for w in d & near)
    # A near miss that clean documents use as much as toxic ones is a word of its own.
    model.benign = frozenset(w for w in near if in_clean[w] / len(clean) >= 0.5 * in_toxic[w] / len(toxic))
    scorer = model.scorer()
    model.coef = fit_logistic(np.array([scorer.features(t) for t in sample["text"]]), y, ridge=1.0)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) plus toxicity_score.

    Nulls: a null text is empty and gets the score of a text without hits. All rows stay, repeated
    ones too; an input column named toxicity_score is replaced, all others pass through untouched.
    """
    keep = [c for c in (keep or docs.columns) if c != "toxicity_score"]
    src = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            x = np.array([scorer.features(t or "") for t in batch.column(len(keep)).to_pylist()]).reshape(batch.num_rows, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(logistic(x, model.coef), pa.float64())], [*keep, "toxicity_score"])

    return src.mapInArrow(run, docs.select(*keep).schema.add("toxicity_score", "double"))


def fit_from_tables(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, max_docs: int = MAX_FIT_DOCS) -> ToxicityModel:
    return fit(training_sample(docs, labels, "toxic", modulus, held, max_docs))

