"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns give the base spans, which stay. Between them, the regions of a text that have digits or an @
are cut into atoms (runs of letters, runs of digits, single other characters), and the field scores every
candidate segment of bounded length under every kind by features of the whole span (digits, groups, check
digits, marks, what stands beside it) and by the kind of the entity before it in the region. Dynamic programming
chooses boundaries and kinds jointly. The field is trained, by the gradient of its likelihood, on generated regions
whose spans are known.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import in_short_batches

KINDS = ("email", "ip", "card", "phone")
#: Atoms a segment has at most.
LONGEST = 16
#: Atoms whose segments' features are held at once.
STRIDE = 1024
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEEN = re.compile(r"[0-9@]\S*")
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: each @ has as local part the run before it, as far as the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns' matches, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if SEEN.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def regions(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of words that have a digit or an @, without the base spans, with enough in them to be one."""
    runs: list[list[int]] = []
    for m in SEEN.finditer(text):
        start, end = m.span()
        least = runs[-1][1] if runs else 0
        while start > least and not text[start - 1].isspace():
            start -= 1
        if runs and start - runs[-1][1] <= 1:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    out, k = [], 0
    cuts = sorted((a, b) for a, _, b in base)
    for start, end in runs:
        while k < len(cuts) and cuts[k][1] <= start:
            k += 1
        at, j = start, k
        while j < len(cuts) and cuts[j][0] < end:
            if cuts[j][0] > at:
                out.append((at, cuts[j][0]))
            at, j = max(at, cuts[j][1]), j + 1
        if at < end:
            out.append((at, end))
    return [(a, b) for a, b in out if "@" in text[a:b] or sum("0" <= c <= "9" for c in text[a:b]) >= 7]


FEATURES = 25


def span_features(region: str, a: int, b: int) -> list[float]:
    """Features of the whole span region[a:b]."""
    s = region[a:b]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    left, right = region[a - 1 : a], region[b : b + 1]
    sizes = [len(g) for g in groups]
    others = set(s) - set("0123456789")
    parts = s.split(".")
    letters = sum(c.isalpha() for c in s)
    quads = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    local, _, domain = s.partition("@")
    return [
        1.0,
        float(s.count("@") == 1 and bool(local) and "." in domain and not domain.startswith(".")),
        float("@" in s and (" " in s or s.count("@") > 1)),
        float("@" in s and "." not in domain),
        float(quads and all(len(p) < 4 and int(p) <= 255 for p in parts)),
        float(quads and not all(len(p) < 4 and int(p) <= 255 for p in parts)),
        float(12 <= len(d) <= 19 and not others - set(" -.") and luhn(d)),
        float(12 <= len(d) <= 19 and not others - set(" -.") and not luhn(d)),
        float(12 <= len(d) <= 19 and len(groups) > 2 and set(sizes[:-1]) == {4}),
        float(s[:1] == "+" and 9 <= len(d) <= 15),
        float(s[:2] in ("00", "(0") and 9 <= len(d) <= 15),
        float(9 <= len(d) <= 15 and len(groups) >= 3 and not others - set(" ().-/+") and not quads),
        float("(" in s and ")" in s and 9 <= len(d) <= 15),
        float(len(groups) == 1 and len(s) == len(d)),
        float(len(d) < 9),
        float(len(d) > 15),
        float(left.isalnum() or right.isalnum()),
        float(left in "+.-/@_%" and left != "" or right in "-/@_%" and right != ""),
        float(right == "." and region[b + 1 : b + 2].isalnum() or left == "." and region[a - 2 : a - 1].isalnum()),
        float(right in (" ", "-") and region[b + 1 : b + 2].isdigit() or left in (" ", "-") and a > 1 and region[a - 2 : a - 1].isdigit()),
        float(sizes[-3:] == [3, 3, 4] or sizes[-2:] == [3, 4]),
        float(sizes[-3:] == [3, 3, 4] and len(d) <= 13),
        float(sizes[:3] in ([4, 2, 2], [2, 2, 4]) or len(groups) > 4),
        letters / max(len(s), 1),
        float(bool(s) and not (s[0].isalnum() or s[0] in "+(") or not s[-1:].isalnum()),
    ]


def _cuts(region: str) -> Sequence[int]:
    """0 and the ends of the atoms."""
    return array("q", [0]) + array("q", (m.end() for m in ATOM.finditer(region)))


class SegmentField:
    """Scores of kinds on segments and of a kind after another, their partition function and best segmentation.

    The state between segments is the last entity's kind plus one, 0 before the first; what is no entity scores 0 an
    atom and keeps the state.
    """

    def __init__(self, weights: np.ndarray | None = None) -> None:
        rows = len(KINDS) + 1
        self.w = np.zeros((len(KINDS), FEATURES + rows)) if weights is None else weights

    @property
    def after(self) -> np.ndarray:
        """Score of each kind (column) after each state (row)."""
        return self.w[:, FEATURES:].T

    def candidates(self, region: str) -> tuple[Sequence[int], list[tuple[int, int]], np.ndarray]:
        """Ends of the atoms, the candidate segments (atom from, atom to) and their features."""
        cuts = _cuts(region)
        return cuts, *self.segments(region, cuts, 0, len(cuts))

    def segments(self, region: str, cuts: Sequence[int], begin: int, end: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The candidate segments (atom from, atom to) that begin at the atoms from begin to end, and their features."""
        found = []
        for i in range(begin, min(end, len(cuts) - 1)):
            first = region[cuts[i]]
            if first.isalnum() or first in "+(":
                for j in range(i + 1, min(len(cuts) - 1, i + LONGEST) + 1):
                    s = region[cuts[i] : cuts[j]]
                    if s[-1].isalnum() and ("@" in s or sum("0" <= c <= "9" for c in s) >= 4 and not s.isalpha()):
                        found.append((i, j))
        x = np.array([span_features(region, cuts[i], cuts[j]) for i, j in found]).reshape(-1, FEATURES)
        return found, x

    def gradient(self, region: str, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Gradient of the log likelihood of a segmentation, gold: kind by (start, end) in characters."""
        cuts, found, x = self.candidates(region)
        n, scores = len(cuts) - 1, x @ self.w[:, :FEATURES].T
        before, onward = np.full((n + 1, len(KINDS) + 1), -np.inf), np.zeros((n + 1, len(KINDS) + 1))
        before[0, 0] = 0.0
        ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(found):
            ending[j].append(k)
            starting[i].append(k)
        for j in range(1, n + 1):
            before[j] = before[j - 1]
            for k in ending[j]:
                into = np.logaddexp.reduce(before[found[k][0]][:, None] + self.after, axis=0) + scores[k]
                before[j, 1:] = np.logaddexp(before[j, 1:], into)
        for i in range(n - 1, -1, -1):
            onward[i] = onward[i + 1]
            for k in starting[i]:
                out_of = np.logaddexp.reduce(self.after + scores[k] + onward[found[k][1], 1:], axis=1)
                onward[i] = np.logaddexp(onward[i], out_of)
        whole = np.logaddexp.reduce(before[n])
        out = np.zeros_like(self.w)
        for k, (i, j) in enumerate(found):
            p = np.exp(np.minimum(before[i][:, None] + self.after + scores[k] + onward[j, 1:] - whole, 0))
            out[:, :FEATURES] -= p.sum(0)[:, None] * x[k]
            out[:, FEATURES:] -= p.T
        place, state = {s: k for k, s in enumerate(found)}, 0
        for (a, b), kind in sorted(gold.items()):
            if a in cuts and b in cuts and (k := place.get((cuts.index(a), cuts.index(b)))) is not None:
                out[kind, :FEATURES] += x[k]
                out[kind, FEATURES + state] += 1
                state = kind + 1
        return out

    def best(self, region: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation's entities.

        Atoms are gone through once, features are made for STRIDE of them at a time, and scores are kept for the LONGEST atoms
        ahead: what grows with the region are a few numbers an atom, the way back.
        """
        cuts, states = _cuts(region), len(KINDS) + 1
        n, width = len(cuts) - 1, LONGEST + 1
        # A segment that no state lets score above 0 is never in the best segmentation: leaving it out scores more, unless it changes the state.
        gain = max(0.0, float(self.after.max() - self.after.min()))
        score, back, came = np.full((width, states), -np.inf), np.full((n + 1, states), -1, np.int32), np.zeros((n + 1, states), np.int8)
        last = np.full(states, -np.inf)
        last[0] = 0.0
        for begin in range(0, n, STRIDE):
            found, x = self.segments(region, cuts, begin, begin + STRIDE)
            scores = x @ self.w[:, :FEATURES].T
            kept = np.flatnonzero(scores.max(1) + self.after.max() + gain > 0).tolist() if found else []
            at = 0
            for i in range(begin, min(begin + STRIDE, n)):
                # What ends here: taken only where it scores above carrying on without it.
                row = score[i % width]
                carried = ~(row > last)
                last = np.where(carried, last, row)
                back[i, carried] = -1
                score[i % width] = -np.inf
                while at < len(kept) and found[kept[at]][0] == i:
                    k, at = kept[at], at + 1
                    j = found[k][1]
                    reach = last[:, None] + self.after + scores[k]
                    best, from_ = reach.max(0), reach.argmax(0)
                    better = np.flatnonzero(best > score[j % width, 1:])
                    score[j % width, better + 1], back[j, better + 1], came[j, better + 1] = best[better], i, from_[better]
        row = score[n % width]
        back[n, ~(row > last)] = -1
        out, j, state = [], n, int(np.maximum(row, last).argmax())
        while j > 0:
            if back[j, state] < 0:
                j -= 1
            else:
                i = int(back[j, state])
                out.append((cuts[i], state - 1, cuts[j]))
                j, state = i, int(came[j, state])
        return out[::-1]

    def fit(self, examples: list[tuple[str, dict[tuple[int, int], int]]], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-3) -> SegmentField:
        grown = np.full_like(self.w, 1e-6)
        for _ in range(epochs):
            for region, gold in examples:
                g = self.gradient(region, gold) - ridge * self.w
                grown += g * g
                self.w = self.w + rate * g / np.sqrt(grown)
        return self


def generated(n: int, seed: int) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """n regions with their spans: entities of every kind in several ways of writing, and look-alikes that are none."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abdehilmnorstu"), r.integers(2, 8)))
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))

    def card() -> str:
        d = "4" + num(r.integers(11, 15))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = str(r.choice(["", "", " ", "-", "."]))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        form = r.integers(0, 5)
        a, b, c, d = str(r.integers(1, 99)), num(3), num(3), num(4)
        return [f"+{a} ({b}) {c}-{d}", f"+{a}-{b}-{c}-{d}", f"({b}) {c}-{d}", f"00{a} {b} {c} {d}", f"{b}-{c}-{d}"][form]

    makers = [
        lambda: f"{word()}{str(r.choice(['', '.', '_']))}{num(r.integers(1, 4))}@{word()}.{word()}.{str(r.choice(['com', 'org', 'net']))}",
        lambda: ".".join(str(x) for x in r.integers(0, 256, 4)),
        card,
        phone,
        lambda: f"{num(4)}-{num(2)}-{num(2)}",
        lambda: num(r.integers(7, 24)),
        lambda: "".join(r.choice(list("0123456789abcdef"), 32)),
        lambda: ".".join(num(r.integers(1, 5)) for _ in range(5)),
        lambda: f"{word()}{num(3)}-{num(4)}",
        lambda: f"@{word()}{num(2)}",
        lambda: f"{num(3)},{num(3)},{num(3)}",
        lambda: f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}",
        lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"v{num(1)}.{num(2)}.{num(3)}",
        lambda: f"{word()}@{word()}",
    ]
    out = []
    for _ in range(n):
        text, gold = str(r.choice(["", "(", "x:", '"'])), {}
        for _ in range(r.integers(1, 3)):
            kind = int(r.integers(0, len(makers)))
            s = makers[kind]()
            if 5 == kind and (luhn(s) and 12 <= len(s) <= 19):
                kind = 2
            if kind < 4:
                gold[len(text), len(text) + len(s)] = kind
            text += s + str(r.choice([" ", ", ", "; ", ".", "*** ", "!! "]))
        out.append((text, gold))
    return out


def find_pii(docs: DataFrame, examples: int = 300, seed: int = 5) -> DataFrame:
    """Per row of docs: doc_id, base and extra spans, arrays of (start, kind, stop, value), code points, end exclusive.

    base holds every match of the fixed patterns, extra what the trained field finds outside them. Null and empty
    texts have none; repeated rows are searched as often as they occur; other columns are ignored. examples:
    generated regions to train on.
    """
    field = SegmentField().fit(generated(examples, seed))
    sent = docs.sparkSession.sparkContext.broadcast(field.w)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = SegmentField(sent.value)
        for b in batches:
            base, extra = [], []
            for text in b["text"]:
                text = text or ""
                own = base_spans(text)
                base.append([(a, KINDS[k], e, text[a:e]) for a, k, e in own])
                extra.append([(at + a, KINDS[k], at + e, text[at + a : at + e]) for at, to in regions(text, own) for a, k, e in found.best(text[at:to])])
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": base, "extra": extra})

    span = "array<struct<start:bigint,kind:string,stop:bigint,value:string>>"
    docs = in_short_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(search, f"doc_id string, base {span}, extra {span}").withColumn("doc_id", F.col("doc_id").cast("long"))

