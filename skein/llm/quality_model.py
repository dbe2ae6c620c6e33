"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (statistics of the shapes of its characters, then
a learned layer), a gated attention network weighs the passages, and a logistic unit scores the weighted
sum. Only documents have labels; encoder, attention and scorer are learned together from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import in_short_batches
from skein.operators.work import discard, saved

#: Words in a passage.
PASSAGE_WORDS = 128
HIDDEN, GATE = 16, 8
KINDS = 16


def _kinds() -> np.ndarray:
    """Kind of each UTF-8 byte: letters by case, digits, blanks, and the punctuation marks by use."""
    out = np.full(256, 15, np.uint8)
    for kind, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".", ",;:", "!?", "|", "#", "*", "%&$@^~", "'\"`", "()[]{}<>", "-_/\\+="]):
        for c in chars:
            out[ord(c)] = kind
    return out


_KIND = _kinds()
#: Slots of hashed words, and the hash: each byte times a number for its place in the word.
SLOTS = 64
_PLACES = np.random.default_rng(3).integers(1, 1 << 31, 32, np.int64) | 1
FEATURES = KINDS * KINDS + SLOTS + 2
#: Bytes of a text that are encoded at once.
PIECE = 1 << 19


def pieces(text: bytes | None, size: int = PIECE) -> Iterator[np.ndarray]:
    """A row of features per passage of PASSAGE_WORDS words: pairs of kinds of characters, hashed words, their number
    and length. A text without words is one passage.

    The text is read in pieces of size bytes; what is open at the end of one, a passage and a word, is carried on, so
    the rows don't depend on size and memory doesn't on the length of the text, of a passage or of a word.
    """
    whole = np.frombuffer(text or b" ", np.uint8)
    counts, slots, found = np.zeros((1, KINDS * KINDS)), np.zeros((1, SLOTS)), np.zeros(1)
    n_words, last, word, length = 0, None, np.int64(0), 0
    for begin in range(0, len(whole), size):
        bytes_ = whole[begin : begin + size]
        kinds = _KIND[bytes_]
        inside = (kinds != 3) & (kinds != 4)
        going = last is not None and last not in (3, 4)
        starts = inside.copy()
        starts[0] &= not going
        starts[1:] &= ~inside[:-1]
        base = max(n_words - 1, 0) // PASSAGE_WORDS
        at = np.maximum(np.cumsum(starts) + n_words - 1, 0) // PASSAGE_WORDS - base
        n = int(at[-1]) + 1
        more = np.zeros((n, KINDS * KINDS)), np.zeros((n, SLOTS)), np.bincount(at, weights=starts, minlength=n)
        pairs = at[:-1] * (KINDS * KINDS) + kinds[:-1].astype(np.int64) * KINDS + kinds[1:]
        more[0][:] = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1)
        if last is not None:
            more[0][0, int(last) * KINDS + int(kinds[0])] += 1
        first = np.flatnonzero(starts)
        head = np.r_[0, first]
        place = np.arange(len(bytes_)) - np.repeat(head, np.diff(np.r_[head, len(bytes_)]))
        place[: first[0] if len(first) else len(place)] += length
        values = np.where(inside, bytes_ * _PLACES[place % len(_PLACES)], 0)
        carried = first[0] if len(first) else len(bytes_)
        if going:
            word += values[:carried].sum()
            blank = np.flatnonzero(~inside[:carried])
            if len(blank) or len(first):
                more[1][0, (word >> 13) % SLOTS] += 1
                word, length = np.int64(0), 0
            else:
                length += len(bytes_)
        if len(first):
            hashed = np.add.reduceat(values, first)
            if inside[-1]:
                word, length = hashed[-1], len(bytes_) - int(first[-1])
                hashed, first = hashed[:-1], first[:-1]
            more[1][:] += np.bincount((at[first] * SLOTS + (hashed >> 13) % SLOTS).astype(np.int64), minlength=n * SLOTS).reshape(n, -1)
        for new, old in zip(more, (counts, slots, found), strict=True):
            new[0] += old[0]
        counts, slots, found = more
        n_words, last = n_words + int(starts.sum()), kinds[-1]
        if n > 1:
            yield _features(counts[:-1], slots[:-1], found[:-1])
            counts, slots, found = counts[-1:], slots[-1:], found[-1:]
    if last not in (3, 4):
        slots[0, (word >> 13) % SLOTS] += 1
    yield _features(counts, slots, found)


def _features(counts: np.ndarray, slots: np.ndarray, found: np.ndarray) -> np.ndarray:
    chars = np.maximum(counts.sum(1), 1.0)
    out = np.empty((len(found), FEATURES), np.float32)
    out[:, : KINDS * KINDS] = np.sqrt(counts / chars[:, None])
    out[:, KINDS * KINDS : -2] = np.sqrt(slots / np.maximum(found, 1)[:, None])
    out[:, -2] = np.log1p(found) / 5
    out[:, -1] = chars / np.maximum(found, 1) / 20
    return out


def passages(text: bytes | None) -> np.ndarray:
    """All rows of pieces()."""
    return np.concatenate(list(pieces(text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int) -> AttentionModel:
        r = np.random.default_rng(seed)
        shapes = {"we": (FEATURES, HIDDEN), "be": (HIDDEN,), "v": (HIDDEN, GATE), "bv": (GATE,), "u": (HIDDEN, GATE), "bu": (GATE,), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
        return cls({k: r.normal(0, 1 / np.sqrt(s[0]), s) if k in ("we", "v", "u", "w", "c") else np.zeros(s) for k, s in shapes.items()})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags one after the other; first: where each bag begins."""
        p, sizes = self.weights, np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        h = np.tanh(x @ p["we"] + p["be"])
        t, g = np.tanh(h @ p["v"] + p["bv"]), _sigmoid(h @ p["u"] + p["bu"])
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, first)
        dy = (f["y"] - labels) * importance / importance.sum()
        dz = (dy[:, None] * p["c"])[f["bag"]]
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"we": x.T @ dh, "be": dh.sum(0), "v": f["h"].T @ dt, "bv": dt.sum(0), "u": f["h"].T @ dg, "bu": dg.sum(0), "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, rate: float = 0.02, batch: int = 64) -> AttentionModel:
        """Adam on the log loss; the rarer label weighs as much as the other."""
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        share = labels.mean() if 0 < labels.mean() < 1 else 0.5
        importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(bags)), max(1, len(bags) // batch)):
                x, first = np.concatenate([bags[i] for i in rows]), np.cumsum([0, *[len(bags[i]) for i in rows[:-1]]])
                step += 1
                for k, d in self.gradients(x, first, labels[rows], importance[rows]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(np.concatenate(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]]))["y"] if bags else np.zeros(0)

    def score_long(self, parts: Iterable[np.ndarray]) -> tuple[float, int]:
        """Score and passages of one bag that comes in parts: sums of the softmax are kept relative to the largest logit so far."""
        p, top, total, z, n = self.weights, -np.inf, 0.0, np.zeros(HIDDEN), 0
        for x in parts:
            h = np.tanh(x @ p["we"] + p["be"])
            s = (np.tanh(h @ p["v"] + p["bv"]) * _sigmoid(h @ p["u"] + p["bu"])) @ p["w"]
            most = max(top, float(s.max()))
            e, fade = np.exp(s - most), np.exp(top - most)
            top, total, z, n = most, total * fade + e.sum(), z * fade + e @ h, n + len(x)
        return float(_sigmoid(z / total @ p["c"] + p["b"])[0]), n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, bound: int) -> DataFrame:
    """At most bound rows (doc_id, text, label) that may be learned from, those whose ids have the smallest hashes.

    A document labelled more than once has its largest label; labels other than 0 and 1 and null ids don't count;
    of documents with one id the one with the smallest text counts. Which rows are taken doesn't depend on their order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("doc_id", F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fold_of(folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, bound: int = 3000, most_passages: int = 60_000, epochs: int = 12, seed: int = 7) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5), n_passages.

    labels: doc_id, quality. Learns from at most bound labelled documents for which learn_from, a condition on
    doc_id, holds, in the order of a hash of the id as long as they have at most most_passages passages (a first one
    in any case); scores every whole text. Null and empty texts are one passage without words and get a score
    too. Without labelled rows of both kinds every score is the share of label 1, or 0.5. Repeated rows are
    scored as often as they occur; other columns are ignored.
    """
    docs = in_short_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [passages(t).tobytes() for t in b["text"]]})

    encoded = saved(labelled_sample(docs, labels, "quality", learn_from, bound).mapInPandas(encode, "doc_id string, label int, x binary"))
    sizes = encoded.select("doc_id", (F.octet_length("x") / (4 * FEATURES)).alias("n"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).toPandas().sort_values(["h", "doc_id"])
    taken = sizes["doc_id"][(sizes["n"].cumsum() <= most_passages) | (np.arange(len(sizes)) == 0)].tolist()
    found = encoded.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id string")), "doc_id").toPandas().sort_values("doc_id")
    discard(encoded)
    truth = found["label"].to_numpy(np.float64)
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(np.float64) for x in found["x"]]
    model = AttentionModel.new(seed)
    if len(set(truth)) == 2:
        model.fit(bags, truth, epochs, seed)
    else:
        model.weights = {k: np.zeros_like(w) for k, w in model.weights.items()}
        model.weights["b"] = np.array([20.0 * (2 * truth[0] - 1) if len(truth) else 0.0])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                long = np.array([t is not None and len(t) > PIECE for t in part["text"]])
                own = [passages(t) for t in part["text"][~long]]
                y, n = np.zeros(len(part)), np.zeros(len(part), np.int64)
                y[~long], n[~long] = sent.value.score(own), [len(x) for x in own]
                for i in np.flatnonzero(long):
                    y[i], n[i] = sent.value.score_long(pieces(part["text"].iloc[i]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": y, "predicted": (y >= 0.5).astype(np.int32), "n_passages": n})

    return docs.mapInPandas(score, "doc_id string, score double, predicted int, n_passages long").withColumn("doc_id", F.col("doc_id").cast("long"))
