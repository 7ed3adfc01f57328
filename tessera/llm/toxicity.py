"""Toxicity: Levenshtein automata over a lexicon trie, weighed by the window around each hit.

The lexicon is learned from labels: whole terms, and stems that begin a word. Matching
runs a word through the intersection of the terms' Levenshtein automata with the trie: a
state is a set of (trie node, errors), determinised as words need it. So misspelled terms
are found in one pass over the word, whatever the size of the lexicon.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import PIECE, WordMemo, word_groups
from tessera.llm.quality import labelled_sample, score_texts

#: Marks that open or close a quotation (fixed values).
QUOTES = "\"“”„«»‹›‘’`"
#: Words that report someone else's words (fixed values, in the four languages of the tables).
REPORTING = frozenset(
    "said says called calls quote quoted quotes word term wrote sagte sagt nannte zitat wort dijo dice llamó palabra dit disait appelé mot".split()
)
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "“”„«»‹›‘’…–—¡¿"
WINDOW = 8


class LexiconAutomaton:
    """Matches a word against terms and stems, with as many edits as each term's length allows."""

    def __init__(self, terms: list[str], stems: list[str], most_states: int = 20_000) -> None:
        self.terms = [*terms, *stems]
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.allowed: list[int] = [0]
        for i, term in enumerate(self.terms):
            is_stem = i >= len(terms)
            errors = self.errors_for(term, is_stem)
            node = 0
            self.allowed[0] = max(self.allowed[0], errors)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.stem_at.append(-1)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], errors)
            (self.stem_at if is_stem else self.term_at)[node] = i
        self.most_states = most_states
        self._forget()

    @staticmethod
    def errors_for(term: str, is_stem: bool) -> int:
        """Edits allowed: none for short terms and for stems, which stand for open sets of words."""
        return 0 if is_stem or len(term) < 5 else 1 if len(term) < 9 else 2

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        """The number of the state for these nodes, each with its least errors, after skipping letters of terms."""
        todo = list(best.items())
        while todo:
            node, errors = todo.pop()
            if best[node] < errors:
                continue
            for child in self.children[node].values():
                if errors + 1 <= self.allowed[child] and errors + 1 < best.get(child, 99):
                    best[child] = errors + 1
                    todo.append((child, errors + 1))
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term_at[n]) for n, e in key if self.term_at[n] >= 0 and e <= self.errors_for(self.terms[self.term_at[n]], False)]
            self.ends.append(min(ends, default=None))
            self.stems.append(min((self.stem_at[n] for n, e in key if e == 0 and self.stem_at[n] >= 0), default=-1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.allowed[node] and errors < best.get(node, 99):
                best[node] = errors

        for node, errors in self.sets[state]:
            reach(node, errors + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, errors if letter == c else errors + 1)
        to = self.moves[state][c] = self._state(best)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the best match, or None. A stem matches any word that begins with it."""
        if len(self.sets) > self.most_states:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if self.stems[state] >= 0:
                return 0, self.stems[state]
            if not self.sets[state]:
                return None
        return self.ends[state]


@dataclass(frozen=True)
class Unit:
    """An entry of the lexicon: a whole word or a stem, and how many times a text must hold it to count."""

    text: str
    is_stem: bool
    least: int = 1


def mentioned(words: list[str], reporting: frozenset[str] = REPORTING) -> np.ndarray:
    """Which words stand between quotation marks, or after a reporting word, within WINDOW words."""
    opens = np.array([w[0] in QUOTES for w in words], int)
    bare = [w.rstrip(".,;:!?)") for w in words]
    closes = np.array([b[-1:] in QUOTES and b != "" for b in bare], int)
    reports = np.array([w.strip(_EDGE) in reporting for w in words], int)
    place = np.arange(len(words))
    low, high = np.maximum(0, place - WINDOW), np.minimum(len(words), place + WINDOW + 1)
    count = lambda marks, a, b: (total := np.concatenate([[0], np.cumsum(marks)]))[b] - total[a]
    return ((count(opens, low, place + 1) > 0) & (count(closes, place, high) > 0)) | (count(reports, low, place) > 0)


def units_of(text: str) -> Counter:
    """How often a text holds each unit, where it does not merely quote it: whole words (True, w), and the first 4 to 7 letters of longer words (False, w)."""
    found: Counter = Counter()
    for _, words in word_pieces([text]):
        used = Counter(w.strip(_EDGE) for w, quoted in zip(words, mentioned(words).tolist()) if not quoted) if words else {}
        for w, n in used.items():
            if len(w) >= 4:
                found[True, w] += n
            for k in (4, 5, 6, 7):
                if len(w) > k:
                    found[False, w[:k]] += n
    return found


def learn_lexicon(
    texts: list[str], labels: list[int], least: int = 6, odds: float = 3.0, common: float = 0.04, most: int = 400, times: int = 3
) -> list[Unit]:
    """Units that mark label 1: a greedy cover of the labelled texts by units of high log-odds.

    A unit is a whole word or a stem that a text holds at least 1, 2, .. `times` times: what
    clean texts hold now and then, and toxic ones again and again, counts from its second
    or third time on. Equal texts count once, with the label that most of them have (of equal
    numbers, 1). The texts are dealt into two halves, and a unit must have its log-odds and
    half of `least` texts of label 1 in each, so what only happens to be in some toxic texts
    is not learned. The unit that covers the most texts of label 1 not yet covered is taken,
    while those are `least`; of equals the fewer times, then a whole word, then the longer one.
    Whole words in a share `common` of the texts of label 1 and in hardly any other are
    units too, covered or not.
    """
    votes: dict[str, int] = {}
    for text, label in zip(texts, labels):
        votes[text] = votes.get(text, 0) + (1 if label else -1)
    told = [(text, v >= 0) for text, v in votes.items()]
    half = [crc32(text.encode("utf-8", "surrogatepass")) & 1 for text, _ in told]
    size = Counter((y, h) for (_, y), h in zip(told, half))
    holders: dict[tuple[bool, str, int], set[int]] = {}
    for i, (text, y) in enumerate(told):
        if y:
            for (whole, w), n in units_of(text).items():
                for k in range(1, min(n, times) + 1):
                    holders.setdefault((whole, w, k), set()).add(i)
    holders = {u: h for u, h in holders.items() if len(h) >= least}
    wanted = {u[:2] for u in holders}
    clean: Counter = Counter()
    for i, (text, y) in enumerate(told):
        if not y:
            for unit, n in units_of(text).items():
                if unit in wanted:
                    clean.update((*unit, k, half[i]) for k in range(1, min(n, times) + 1))

    def log_odds(unit: tuple[bool, str, int]) -> float:
        """The smaller of the two halves' log-odds; none where a half has too few toxic texts."""
        least_odds = np.inf
        for h in (0, 1):
            n = sum(half[i] == h for i in holders[unit])
            if n < least / 2 and size[True, h] > 0:
                return -np.inf
            own = np.log((n + 0.5) / (size[True, h] + 1)) - np.log((clean[(*unit, h)] + 0.5) / (size[False, h] + 1))
            least_odds = min(least_odds, own)
        return float(least_odds)

    strength = {u: log_odds(u) for u in holders}
    left = {u: h for u, h in holders.items() if strength[u] >= odds}
    n1 = size[True, 0] + size[True, 1]
    chosen = [u for u in left if u[0] and u[2] == 1 and len(holders[u]) >= max(least, common * n1) and strength[u] >= odds + 0.5]
    chosen = sorted(chosen, key=lambda u: (-len(holders[u]), u[1]))[: most // 2]
    covered = set().union(*(holders[u] for u in chosen))
    while left and len(chosen) < most:
        left = {u: fresh for u, h in left.items() if len(fresh := h - covered) >= least}
        if not left:
            break
        unit = max(left, key=lambda u: (len(left[u]) + min(2.0, strength[u] - odds), -u[2], u[0], len(u[1]), u[1]))
        chosen.append(unit)
        covered |= holders[unit]
    # of one word or stem with several numbers of times, the fewest
    fewest: dict[tuple[bool, str], int] = {}
    for whole, w, k in chosen:
        fewest[whole, w] = min(k, fewest.get((whole, w), k))
    return [Unit(w, not whole, k) for (whole, w), k in fewest.items()]


def word_pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The lower-case words of each text, a very long text in parts."""
    for group in word_groups(texts):
        for i, piece in group:
            yield i, piece.lower().split()


#: Weights before learning: bias, exact hits, misspelled hits, quoted hits, densest window.
PRIOR = np.array([-3.0, 4.0, 2.5, 0.5, 1.0])


@dataclass
class Hits:
    """What is kept of a text's hits: place, unit and kind (0 exact, 1 misspelled, 2 quoted), and the words that a window may still need."""

    place: list[int] = field(default_factory=list)
    unit: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    rows: list[tuple[int, int, int]] = field(default_factory=list)
    before: int = 0


@dataclass
class ToxicityModel:
    """A lexicon of bounded size, the words that report others' words, and the weights of the window features."""

    units: list[Unit]
    reporting: frozenset[str] = REPORTING
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    automaton: LexiconAutomaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each lower-case word: 0 no hit, 1 exact hit, 2 misspelled hit; and the number of the unit."""
        if self.automaton is None:
            ordered = sorted(self.units, key=lambda u: u.is_stem)
            self.units = ordered
            self.automaton = LexiconAutomaton([u.text for u in ordered if not u.is_stem], [u.text for u in ordered if u.is_stem])
        match = self.automaton.match
        out = np.zeros((len(words), 2), np.int32)
        for i, w in enumerate(words):
            if (m := match(w.strip(_EDGE))) is not None:
                out[i] = 1 + (m[0] > 0), m[1]
        return out

    def feed(self, hits: Hits, words: list[str], rows: np.ndarray, is_last: bool) -> None:
        """Takes the next words of a text; a hit is settled when the window on its right is there or the text ends.

        A hit is quoted when it stands between quotation marks or near a reporting word.
        """
        at = len(hits.words)
        hits.words = [*hits.words, *words] if at else words
        hits.rows += [(at + i, int(rows[i, 0]), int(rows[i, 1])) for i in np.flatnonzero(rows[:, 0]).tolist()]
        end = len(hits.words) if is_last else max(0, len(hits.words) - WINDOW)
        ready = [row for row in hits.rows if row[0] < end]
        for i, status, unit in ready:
            first = max(0, i - WINDOW)
            quoted = mentioned(hits.words[first : i + WINDOW + 1], self.reporting)[i - first]
            hits.place.append(hits.before + i)
            hits.unit.append(unit)
            hits.kind.append(2 if quoted else status - 1)
        cut = max(0, end - WINDOW)
        hits.rows = [(i - cut, status, unit) for i, status, unit in hits.rows[len(ready) :]]
        hits.words = hits.words[cut:]
        hits.before += cut

    def features(self, hits: Hits) -> np.ndarray:
        """What the windows of WINDOW words on either side of each hit show, for the whole text."""
        held = np.bincount(hits.unit, minlength=len(self.units)) if hits.unit else np.zeros(len(self.units), int)
        enough = [k for k, u in enumerate(hits.unit) if held[u] >= self.units[u].least]
        n = np.bincount([hits.kind[k] for k in enough], minlength=3) if enough else np.zeros(3)
        at = np.array([hits.place[k] for k in enough])
        dense = 0 if len(at) < 2 else int(max(np.searchsorted(at, at + WINDOW, "right") - np.arange(len(at)))) - 1
        return np.array([1.0, min(n[0], 1) + np.log1p(n[0]), min(n[1], 1) + np.log1p(n[1]), np.log1p(n[2]), np.log1p(dense if n[0] + n[1] else 0)])

    def all_features(self, memo: WordMemo, texts: list[str]) -> np.ndarray:
        """The features of each text; those of one without hits are the same for all."""
        found: dict[int, Hits] = {}
        out = np.zeros((len(texts), len(PRIOR)))
        out[:, 0] = 1

        def finish(i: int) -> None:
            hits = found.pop(i)
            self.feed(hits, [], np.zeros((0, 2), np.int32), True)
            if hits.place:
                out[i] = self.features(hits)

        for group in word_groups(texts):
            words = [piece.lower().split() for _, piece in group]
            rows = memo([w for ws in words for w in ws]) if any(words) else np.zeros((0, 2), np.int32)
            end = 0
            for (i, _), ws in zip(group, words):
                end += len(ws)
                own = rows[end - len(ws) : end]
                for old in [k for k in found if k < i]:
                    finish(old)
                if i in found or own[:, 0].any() or len(texts[i]) > LONG_TEXT:
                    self.feed(found.setdefault(i, Hits()), ws, own, False)
        for old in list(found):
            finish(old)
        return out


#: A text of more characters is read in parts, and the ends of its parts are kept for the windows that reach over them.
LONG_TEXT = PIECE


def score_toxicity(model: ToxicityModel | None, memo: WordMemo | None, texts: list[str]) -> np.ndarray:
    """The probability of label 1 for each text; that of a text without hits is the same for all, empty ones included."""
    if model is None:
        return np.zeros(len(texts))
    logit = model.all_features(memo, texts) @ model.weights
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def learn_reporting(model: ToxicityModel, memo: WordMemo, texts: list[str], labels: list[int], least: int = 4, odds: float = 2.0, most: int = 100) -> frozenset[str]:
    """Words that stand before hits in texts of label 0 much more often than in those of label 1, and than elsewhere, beside the fixed ones."""
    near = {0: Counter(), 1: Counter()}
    size, everywhere = Counter(), Counter()
    for i, words in word_pieces(texts):
        rows = memo(words) if words else np.zeros((0, 2), np.int32)
        label = int(bool(labels[i]))
        seen = {w.strip(_EDGE) for k in np.flatnonzero(rows[:, 0]).tolist() for w in words[max(0, k - WINDOW) : k]}
        near[label].update(seen)
        size[label] += bool(seen)
        if seen and not label:
            everywhere.update(w.strip(_EDGE) for w in words)
    total = max(1, everywhere.total())

    def is_reporting(w: str) -> bool:
        share = (near[0][w] + 0.5) / (size[0] + 1)
        return np.log(share) - max(np.log((near[1][w] + 0.5) / (size[1] + 1)), np.log(WINDOW * everywhere[w] / total)) >= odds

    found = [w for w, n in near[0].items() if w and n >= least and is_reporting(w)]
    return REPORTING | frozenset(sorted(found, key=lambda w: (-near[0][w], w))[:most])


def fit_toxicity_model(texts: list[str], labels: list[int], steps: int = 400, rate: float = 0.5, hold: float = 0.02) -> ToxicityModel:
    """Learns lexicon, reporting words and weights; the weights are logistic regression held near PRIOR."""
    model = ToxicityModel(learn_lexicon(texts, labels))
    memo = WordMemo(model.word_rows)
    model.reporting = learn_reporting(model, memo, texts, labels)
    x, y = model.all_features(memo, texts), np.array(labels, float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -50, 50)))
        model.weights = model.weights - rate * (x.T @ (p - y) / len(y) + hold * (model.weights - PRIOR) * len(PRIOR) / 50)
    return model


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    threshold: float = 0.5, most: int = 6000, most_chars: int = 1 << 26, folds: int = 5, held: int = 0,
) -> DataFrame:
    """Scores every whole text for toxicity.

    Returns key, held_out (crc32 of the key modulo `folds` is `held`), score (the
    probability of label 1) and predicted (1 if score >= threshold). Lexicon, reporting words
    and weights are learned on labelled rows outside the held-out fold, at most `most` of
    them and `most_chars` characters, one a key: a bounded sample, and the lexicon has at
    most 400 entries, so the model is broadcast. Only text is scored. A null or empty text
    scores as one without hits; every text scores 0 when there is nothing to learn from. A
    key with several labels counts with the largest; of several rows of one key, one is
    learned from; equal texts count once, with the label of most. A very long text is
    read in parts. Rows are independent: ties, repeated rows and null keys pass through;
    an empty table gives an empty result; other columns are not read.
    """
    told = labelled_sample(docs, labels, key, text, label, most, most_chars, folds, held)
    model = fit_toxicity_model([t for t, _ in told], [y for _, y in told]) if told else None
    return score_texts(docs, docs.sparkSession.sparkContext.broadcast(model), score_toxicity, key, text, folds, held, threshold)
