"""N-gram Jaccard join over documents by set-relation skipping.

Exact set-similarity join on distinct word shingles. Equal sets are one class. Each class is indexed under
a prefix of its shingles in one global order (rare first), so that any two linked classes meet in an index
list. Two relations between sets then save work:

* Index level: lists are kept in blocks by size and position. Of the blocks of a token only those meet whose sizes can
  link and whose positions leave room for the needed overlap; the others are skipped as a whole. Inside blocks that
  meet, each pair's sizes and positions are judged, before any set is looked at.
* Answer level: a class that is highly similar to the head of a list (the entry in the earliest position,
  the set with the fewest own shingles) takes over the head's answers: both belong to one component, and it
  is compared only with entries that the head's component hasn't reached yet.

What remains after the heads are settled, entries of one list in different components, is compared in full,
so no link between different components is lost. Before that, a bitmap of each set, a bit a shingle, bounds
their overlap from above and drops the pairs that can't link. Shingles and sets are held as 64- and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WordHashes, in_short_batches, lower_words, shingle_hashes
from skein.operators.components import components
from skein.operators.work import discard, saved

#: Slots of the sketch of shingle frequencies, whose size doesn't depend on the corpus (256 KB as a broadcast), and the
#: documents, about, that it is taken from. Only costs depend on it.
SLOTS, SKETCHED = 1 << 16, 20_000
#: Entries from which a block of a list is dealt over several tasks.
HEAVY = 2000


def _need(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap that a set of this size has with any set at the threshold: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def _sets(texts: list[bytes | None], width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.unique(shingle_hashes(hashes.of(lower_words(text)), width))


def _bitmap(s: np.ndarray) -> bytes:
    """A bit of parity for each slot of the set's shingles; as many slots as shingles, rounded up to a power of two."""
    slots = max(64, 1 << int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def _may_link(x: bytes, m: int, y: bytes, n: int, percent: int) -> bool:
    """Whether sets of these bitmaps and sizes can reach the threshold: each slot that differs has an own shingle of one of them."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    apart = int(np.bitwise_count(a ^ b).sum())
    both = min((m + n - apart) // 2, m, n)
    return 100 * both >= percent * (m + n - both)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How common each slot of shingles is, in eighths of a power of two above the median slot. Only costs depend on it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            slots = [s % np.uint64(SLOTS) for s in _sets(batch["text"].tolist(), width, hashes)]
            found, n = np.unique(np.concatenate(slots) if slots else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"slot": found.astype(np.int32), "n": n.astype(np.int64)})

    n = docs.count()
    some = docs.sample(SKETCHED / n, seed=1) if n > SKETCHED else docs
    counted = some.mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.float64)
    out[counted["slot"]] = counted["n"]
    usual = max(float(np.median(out)), 1.0)
    return np.clip(np.ceil(8 * np.log2(np.maximum(out, usual) / usual)), 0, 255).astype(np.uint8)


def _signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document its set's size and key, the prefix of its shingles in the global order, and its set's bitmap."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(_sketch(docs.select("text"), width))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ranks = WordHashes(), rank.value
        for batch in batches:
            sizes, keys, prefixes, bitmaps = [], [], [], []
            for s in _sets(batch["text"].tolist(), width, hashes):
                k = len(s) - _need(len(s), percent) + 1 if len(s) else 0
                r = ranks[s % np.uint64(SLOTS)]
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefixes.append(s[np.argsort(r, kind="stable")[:k]].view(np.int64))
                bitmaps.append(_bitmap(s))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "key": keys, "prefix": prefixes, "bitmap": bitmaps})

    return saved(docs.mapInPandas(sign, "doc_id string, n long, key binary, prefix array<long>, bitmap binary").withColumn("doc_id", F.col("doc_id").cast("long")))


def _room(percent: int):
    """Whether two list entries (m, i) and (n, j), size and position, leave room for a link that first meets here."""
    size = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    least = F.ceil((F.col("m") + F.col("n")) * percent / F.lit(100.0 + percent) - 1e-9)
    apart = (100 + percent) * (F.col("i") + F.col("j")) <= (100 - percent) * (F.col("m") + F.col("n"))
    return size & apart & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= least)


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of entries of one list, in different components, whose blocks meet and that leave room for a link.

    Blocks by position: early or late in the set; of late ones no two leave room for each other, so early entries meet
    early and late ones. Lists of over HEAVY entries (c) have blocks by size too: sizes that can link are in the same step
    of a geometric scale or in neighbouring ones. Such a list is dealt by one side and repeated for the other.
    """
    heavy = F.col("c") > HEAVY
    scale = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    placed = lists.withColumns({"step": F.when(heavy, scale).otherwise(0), "early": (100 + percent) * F.col("pos") <= (100 - percent) * F.col("n"), "parts": F.ceil(F.col("c") / HEAVY).cast("int")})
    one = placed.filter("early").select("token", "step", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.col("cid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"), F.col("comp").alias("ca"))
    steps = F.when(heavy, F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array("step"))
    blocks = F.flatten(F.transform(steps, lambda s: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(s.alias("step"), k.alias("part")))))
    two = placed.select("token", F.explode(blocks).alias("block"), F.col("cid").alias("b"), "n", F.col("pos").alias("j"), F.col("comp").alias("cb"), F.col("early").alias("also"))
    two = two.select("token", "block.step", "block.part", "b", "n", "j", "cb", "also")
    pairs = one.join(two, ["token", "step", "part"]).filter("ca <> cb and (not also or ca < cb)").filter(_room(percent))
    turned = F.col("ca") > F.col("cb")
    lower = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return pairs.select(lower("a", "b").alias("a"), lower("b", "a").alias("b"), lower("ca", "cb").alias("ca"), lower("cb", "ca").alias("cb")).dropDuplicates(["a", "b"])


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bit for each slot of the hashed ids (id: string), 2 MB whatever their number: what isn't in it is no such id."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 24))
    words = ids.select((slot / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << 19, np.uint32)
    out[words["w"]] = words["b"].astype(np.uint32)
    return out


def _open_pairs(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps leave room for a link."""

    def room(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["x"], batch["m"], batch["y"], batch["n"], strict=True)
            keep = [_may_link(x, m, y, n, percent) for x, m, y, n in rows]
            yield batch.loc[keep, ["a", "b"]]

    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("m"), F.col("bitmap").alias("x"))
    two = classes.select(F.col("cid").alias("b"), "n", F.col("bitmap").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "m", "y", "n").mapInPandas(room, "a long, b long")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold. The sets are made again from one text each.

    Only pairs that their bitmaps leave open need sets. A sieve of fixed size keeps most other texts out of the shuffle.
    """
    pairs = saved(_open_pairs(classes, pairs, percent))
    wanted = classes.select("cid", "key", F.col("first_id").cast("string").alias("first_id")).join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi")
    wanted = saved(wanted)
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted.select(F.coalesce("first_id", F.lit("null")).alias("id"))))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            slot = batch["slot"].to_numpy()
            texts = batch["text"][(sieve.value[slot // 32] >> (slot % 32).astype(np.uint32)) & 1 == 1].tolist()
            items = {xxhash.xxh3_128_digest(own): own for own in (s.tobytes() for s in _sets(texts, width, hashes))}
            yield pd.DataFrame({"key": list(items), "items": list(items.values())})

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    slotted = docs.withColumn("slot", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("null"))), F.lit(1 << 24)))
    sets = saved(slotted.select("slot", "text").mapInPandas(make, "key binary, items binary").join(wanted.select("cid", "key"), "key").select("cid", "items"))
    with_b = pairs.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
    both = with_b.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")
    out = saved(both.mapInPandas(hold, "a long, b long").distinct())
    for used in (pairs, wanted, sets):
        discard(used)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its shingle set), component_id (smallest id reachable by links).

    Rows link when 100 * intersection >= percent * union of their sets of distinct width-word shingles; a text
    with fewer words has its whole sequence as one shingle. Null and empty texts, and texts without words, have
    an empty set and link with nothing: their component is their own id. A null id stays null and never names a
    component that has another id. Repeated rows are returned as often as they occur. Other columns are ignored.
    """
    docs = in_short_batches(docs, 200).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    signed = _signatures(docs, width, percent)
    classes = saved(
        signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap")).withColumn("cid", F.monotonically_increasing_id())
    )
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    lists = saved(entries.join(shared, "token"))
    # Heads: the earliest place in each list. A class is compared with the head that it meets most often.
    heads = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "cid")).alias("h"))
    met = lists.join(heads, "token").filter("cid <> h.cid").select(F.col("cid").alias("a"), F.col("h.cid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("i"), F.col("h.n").alias("n"), F.col("h.pos").alias("j"))
    votes = met.filter(_room(percent)).groupBy("a", "b").agg(F.count("*").alias("v"), F.min("j").alias("j"))
    tested = saved(votes.groupBy("a").agg(F.max(F.struct("v", -F.col("j"), "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    found = _verified(docs, classes, tested, width, percent)
    comp = components(found)
    # What is left: entries of one list that are in different components.
    placed = lists.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_lists = placed.groupBy("token").agg((F.min("comp") < F.max("comp")).alias("open"), F.count("*").alias("c")).filter("open").select("token", "c")
    left = saved(placed.join(open_lists, "token"))
    rest = _met(left, percent)
    rest = saved(rest.join(tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        late = _verified(docs, classes, rest.select("a", "b"), width, percent)
        over = components(rest.join(late, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        ids = comp.unionByName(late.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").withColumn("comp", F.col("id")))
        comp = saved(ids.join(over.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
    for used in (lists, tested, left, rest):
        discard(used)
    by_class = classes.select("key", "first_id", "cid").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = by_class.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = by_class.join(smallest, "comp").select("key", "component_id")
    out = signed.drop("prefix", "bitmap").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, without those of a component whose first row is another.

    Rows are named by numbers that are written once with them: numbering each read anew gives other names when the
    files are dealt otherwise, as after the loss of an executor. So of repeated rows, and of rows with null ids, one
    stays too. Texts without words all stay.
    """
    numbered = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    found = jaccard_components(numbered.select("row", F.col("doc.text").alias("text")), width, percent, id_col="row")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("row"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")
