"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents. Its trie is intersected with a Levenshtein automaton: a state
is the set of (trie node, edits spent) that a word's characters so far can have led to. States are worked out
when first met and kept, so reading a word costs a table look-up per character, and most words leave the
automaton after three or four. Each hit, exact or misspelled, is then scored by its context window, which
tells quotation and report from abuse, and a logistic unit turns a document's sums into its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import in_short_batches
from skein.llm.quality_model import labelled_sample
from skein.operators.work import discard, saved

#: Words on each side of a hit that make its context.
WINDOW = 6
#: Marks of quotation, each opening one with those that can close it; verbs of report, names of what is said, words
#: of address. Of report and address these are the first; others are learned from the windows of the sample's hits.
CLOSES = {'"': '"', "'": "'", "`": "`'", "«": "»", "»": "«", "„": "“”", "“": "”", "‚": "‘’", "‘": "’", "‹": "›", "›": "‹"}
QUOTES = "\"'`«»„“”‚‘’‹›"
REPORTS = {"said", "says", "quoted", "called", "wrote", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"}
NAMES = {"quote", "word", "words", "term", "zitat", "wort", "citation", "mot", "mots", "cita", "palabra"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "te", "tú", "usted", "ustedes"}
TERM = r"[^\W\d_]+"
FEATURES = 6
#: Share of a term's weight that misspellings have before any is seen, and how many seen ones weigh as much as that; its limits.
BENT, BENT_SEEN, BENT_LIMITS = 0.75, 5, (0.5, 1.0)


class Lexicon:
    """Terms and their weights, found in words within an edit (5 to 7 letters) or two (8 and more)."""

    #: States that are remembered; beyond, all are forgotten and worked out again.
    LIMIT = 200_000

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = dict(weights)
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[str | None] = [None]
        self.letters: set[str] = set()
        starts = []
        for edits in (0, 1, 2):
            starts.append((self._node(), edits))
            for term in sorted(t for t in self.weights if self.edits(t) == edits):
                at = starts[-1][0]
                for c in term:
                    self.letters.add(c)
                    at = self.children[at].get(c) or self._child(at, c)
                self.terms[at] = term
        self.starts = starts
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(node, left): 0 for node, left in self.starts})

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 8 else 2

    def _node(self) -> int:
        self.children.append({})
        self.terms.append(None)
        return len(self.children) - 1

    def _child(self, at: int, c: str) -> int:
        self.children[at][c] = self._node()
        return self.children[at][c]

    def _state(self, reached: dict[tuple[int, int], int]) -> int:
        """The state of what is reached: (node, edits left) and the edits spent, closed under letters left out."""
        todo = list(reached.items())
        while todo:
            (node, left), spent = todo.pop()
            if left:
                for child in self.children[node].values():
                    if reached.get((child, left - 1), 9) > spent + 1:
                        reached[child, left - 1] = spent + 1
                        todo.append(((child, left - 1), spent + 1))
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[tuple[int, int], int] = {}

        def reach(node: int, left: int, spent: int) -> None:
            if out.get((node, left), 9) > spent:
                out[node, left] = spent

        for (node, left), spent in self.members[state]:
            if c in self.children[node]:
                reach(self.children[node][c], left, spent)
            if left:
                reach(node, left - 1, spent + 1)
                for other, child in self.children[node].items():
                    if other != c:
                        reach(child, left - 1, spent + 1)
        return self._state(out) if out else -1

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and the edits between, the first in order of edits, weight and name; None if none is near enough."""
        if len(self.members) > self.LIMIT:
            self._forget()
        at = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            after = self.moves[at].get(c)
            if after is None:
                after = self.moves[at][c] = self._move(at, c)
            if after < 0:
                return None
            at = after
        near = [(spent, -self.weights[t], t) for (node, _), spent in self.members[at] if (t := self.terms[node])]
        return (min(near)[2], min(near)[0]) if near else None


class _Finder(dict):
    """Hits (place, term, edits, form) of each blank-separated run, remembered up to a bound; long runs aren't remembered.

    The place is that of the TERM in the run. Only if no TERM hits, all of them together can, at place -1.
    """

    LIMIT = 120_000
    LONG = 200

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[tuple[int, str, int, str], ...]:
        parts = re.findall(TERM, word.lower())
        out = tuple((k, *hit, p) for k, p in enumerate(parts) if (hit := self.lexicon.find(p)))
        if not out and len(parts) > 1 and (hit := self.lexicon.find("".join(parts))):
            out = ((-1, *hit, "".join(parts)),)
        if len(word) < self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = out
        return out


def _pieces(run: str) -> list[str]:
    """A run cut into a piece for each of its TERMs. Quotes that follow another mark open the next piece."""
    low, out, at, end = run.lower(), [], 0, None
    run = run if len(run) == len(low) else low
    for m in re.finditer(TERM, low):
        if end is not None:
            between = run[end : m.start()]
            cut = m.start() - (len(between) - len(between.rstrip(QUOTES))) if between.strip(QUOTES) else m.start()
            out.append(run[at:cut])
            at = cut
        end = m.end()
    return [*out, run[at:]]


def _edges(word: str) -> tuple[str, str]:
    """The quotation marks before a word's first letter or digit and after its last; those inside are apostrophes."""
    inner = [i for i, c in enumerate(word) if c.isalnum()]
    head, tail = (word[: inner[0]], word[inner[-1] + 1 :]) if inner else (word, word)
    return "".join(c for c in head if c in QUOTES), "".join(c for c in tail if c in QUOTES)


def _quoted(before: list[str], word: str, after: list[str]) -> tuple[int, int] | None:
    """Where the quotation around a word begins and ends, counted from the word: a mark that opens at the word or before it,
    and isn't closed there, and is closed at the word or after it. None if there is none."""
    around = [_edges(w) for w in before]
    own = _edges(word)
    behind = [own[1], *[_edges(w)[1] for w in after]]
    for i in range(len(around), -1, -1):
        for mark in own[0] if i == len(around) else around[i][0]:
            closing = CLOSES.get(mark, "")
            ends = [k for k, tail in enumerate(behind) if any(c in tail for c in closing)]
            if ends and not any(c in tail for _, tail in around[i:] for c in closing):
                return i - len(around), ends[0]
    return None


def _bare(words: list[str]) -> set[str]:
    return {w.strip(QUOTES + ".,;:!?()").lower().replace("’", "'").partition("'")[0] for w in words}


@dataclass(frozen=True)
class Hit:
    """A term in a text, how it is written there, and what its window says: whether a mark pair is around it, whether someone
    is addressed or speech reported, whether that is outside the marks, and whether, all in all, the term is quoted."""

    term: str
    edits: int
    form: str
    marked: bool
    addressed: bool
    reported: bool
    quoted: bool


def hits(text: str | None, found: _Finder, reports: frozenset = frozenset(REPORTS), address: frozenset = frozenset(ADDRESS)) -> Iterator[Hit]:
    """Each hit of a text. A run of several TERMs is as many words for the windows of its own hits.

    A term is quoted if marks hold more words than it, or a verb of report is near and outside the marks, or
    marks hold it alone and what is said has a name nearby; but not if, outside the marks, someone is addressed.
    """
    words = (text or "").split()
    for i, several in enumerate(map(found.__getitem__, words)):
        if several:
            own = _pieces(words[i]) if several[0][0] >= 0 else [words[i]]
            left, right = words[max(0, i - WINDOW) : i], words[i + 1 : i + WINDOW + 1]
            around = left + own + right
            for place, term, edits, form in several:
                k = len(left) + max(place, 0)
                before, after = around[max(0, k - WINDOW) : k], around[k + 1 : k + WINDOW + 1]
                span = _quoted(before, around[k], after)
                first, last = span or (0, 0)
                outside = _bare(before[: len(before) + first] + after[last:])
                every = _bare(before + after)
                told = bool(outside & reports) or (span is not None and (last > first or bool(outside & NAMES)))
                yield Hit(term, edits, form, span is not None, bool(every & address), bool(every & (reports | NAMES)), told and not outside & address)


@dataclass(frozen=True)
class Worth:
    """What hits weigh: terms, forms that the sample has more than once, and the share of a term's weight that other forms have."""

    terms: dict[str, float]
    forms: dict[tuple[str, str], float]
    share: float
    reports: frozenset
    address: frozenset

    def of(self, hit: Hit) -> float:
        w = self.forms.get((hit.term, hit.form))
        return w if w is not None else self.terms[hit.term] * (self.share if hit.edits else 1.0)


def features(text: str | None, found: _Finder, worth: Worth) -> tuple[list[float], int]:
    """Sums over a text's hits by what their windows say, and the number of hits: plain ones, the strongest, those that
    address someone, the number of plain ones, quoted ones, and plain ones a word. What each is worth is learned."""
    plain = top = quotes = address = n = every = 0.0
    for hit in hits(text, found, worth.reports, worth.address):
        w = worth.of(hit)
        if w <= 0:
            continue
        every += 1
        if hit.quoted:
            quotes += w
        else:
            plain, top, address, n = plain + w, max(top, w), address + hit.addressed, n + 1
    logs = [math.log1p(x) for x in (plain, address, n, quotes)]
    return [*logs, top, n / (20 + len((text or "").split()) ** 0.5)], int(every)


def _odds(hit: int, of: int, miss: int, other: int) -> float:
    return math.log((hit + 0.1) / (of + 1)) - math.log((miss + 0.5) / (other + 1))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; the last coefficient is the constant."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_logistic() without negative weights: features that would have one are left out, the most negative first."""
    used = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, used], y)
        if not used or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        used.pop(int(np.argmin(w[:-1])))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, bound: int = 6000, least: int = 4, odds: float = 20.0) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5), n_hits.

    labels: doc_id, toxic. Learns from at most bound labelled documents for which learn_from, a condition on
    doc_id, holds: the lexicon is all terms in at least least different toxic texts that are odds times as usual there
    as in the others. Scores every whole text. Null and empty texts and texts without hits
    have the constant's score. Without labelled rows of both kinds no term is known. Repeated rows are scored as
    often as they occur; other columns are ignored.
    """
    docs = in_short_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = saved(labelled_sample(docs, labels, "toxic", learn_from, bound))
    total = {r["label"]: r["n"] for r in sample.dropDuplicates(["text"]).groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    used = sample.dropDuplicates(["text"]).select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([\p{L}]+)"), F.lit(1)))).alias("term"))
    counts = used.groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).filter((F.length("term") >= 3) & (F.col("t") >= least) & (F.col("t") * (clean + 1) >= odds * (F.col("c") + 0.5) * (toxic + 1)))
    learned = {r["term"]: _odds(r["t"], toxic, r["c"], clean) for r in counts.orderBy("term").collect()}
    lexicon = Lexicon(learned)
    spark = docs.sparkSession

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _Finder(lexicon)
        for b in batches:
            for label, text in zip(b["label"], b["text"], strict=True):
                seen = sorted({("form", h.term, h.form) for h in hits(text, found)} | {("near", "", w) for w in _near(text, found)})
                if seen:
                    yield pd.DataFrame({"label": [label] * len(seen), "kind": [k for k, *_ in seen], "term": [t for _, t, _ in seen], "form": [f for *_, f in seen]})

    counted = sample.dropDuplicates(["text"]).mapInPandas(observe, "label int, kind string, term string, form string").groupBy("kind", "term", "form").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    # A form is learned from two texts on, a word of a window from `least` on: their number is bounded by the sample.
    seen = counted.filter((F.col("kind") == "form") | (F.col("t") + F.col("c") >= least)).collect()
    worth = _worth([r for r in seen if r["kind"] == "form"], [r for r in seen if r["kind"] == "near"], learned, toxic, clean, odds)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _Finder(lexicon)
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [features(t, found, worth)[0] for t in b["text"]]})

    table = sample.mapInPandas(measure, "label int, x array<double>").toPandas()
    discard(sample)
    y = table["label"].to_numpy(np.float64)
    model = _rising(np.array(table["x"].tolist()), y) if len(set(y)) == 2 else np.array([0.0] * FEATURES + [4.0 * (2 * y[0] - 1) if len(y) else 0.0])
    sent = spark.sparkContext.broadcast((lexicon, worth, model))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, worth, model = sent.value
        found = _Finder(lexicon)
        for b in batches:
            rows = [features(t, found, worth) for t in b["text"]]
            x = np.array([r for r, _ in rows]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32), "n_hits": np.array([n for _, n in rows], np.int64)})

    return docs.mapInPandas(score, "doc_id string, score double, predicted int, n_hits long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _near(text: str | None, found: _Finder) -> set[str]:
    """The words in the windows of a text's hits."""
    words = (text or "").split()
    places = [i for i, several in enumerate(map(found.__getitem__, words)) if several]
    return _bare([w for i in places for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1]])


def _worth(forms: list, near: list, learned: dict[str, float], toxic: int, clean: int, odds: float) -> Worth:
    """Weights from the counts (t, c) of toxic and clean texts of the sample that have a form, or a word in a hit's window.

    Words that are odds times as usual in the windows of one kind of text as in those of the other report or address.
    """
    once = [r for r in forms if r["form"] != r["term"] and r["t"] + r["c"] == 1]
    t, c = sum(r["t"] for r in once), sum(r["c"] for r in once)
    usual = sum(learned.values()) / max(len(learned), 1) or 1.0
    new = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    share = (len(once) * new / usual + BENT_SEEN * BENT) / (len(once) + BENT_SEEN)
    known = {(r["term"], r["form"]): _odds(r["t"], toxic, r["c"], clean) for r in forms if r["t"] + r["c"] > 1}
    hit_t, hit_c = max((r["t"] for r in near), default=0), max((r["c"] for r in near), default=0)
    rate = lambda r: ((r["t"] + 0.5) / (hit_t + 1)) / ((r["c"] + 0.5) / (hit_c + 1))
    more = [r for r in near if hit_c and len(r["form"]) > 1]
    reports = REPORTS | {r["form"] for r in more if rate(r) * odds <= 1}
    address = ADDRESS | {r["form"] for r in more if rate(r) >= odds}
    return Worth(learned, known, min(max(share, BENT_LIMITS[0]), BENT_LIMITS[1]), frozenset(reports), frozenset(address))
