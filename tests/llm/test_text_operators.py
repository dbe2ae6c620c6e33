"""Operators on documents against brute-force versions; edge cases in every one."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, ngram_join, pii, quality_model, quality_rules, queries, toxicity
from skein.llm.common import WordHashes, shingle_hashes

DOCS = "doc_id long, text string, source string, component_id string, n long"
WORDS = [w + s for w in "alpha beta gamma delta omega sigma kappa lambda".split() for s in ("", "s", "ed", "ing", "er")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = r.choice(WORDS) + str(r.randrange(999))
    return " ".join(words)


def odd_rows(start=900):
    """Nulls, empty and blank texts, repeated rows and ids, one very long text."""
    return [(start, None, None, "x", 1), (start + 1, "", "s", "x", 1), (start + 2, " \t\n ", "s", "x", None), (start + 3, "one", "s", "x", 1), (start + 3, "one", "s", "x", 1), (None, "two words", "s", None, 1), (start + 4, "long " * 30_000 + "end", "s", "x", 1)]


def corpus(seed=1):
    r, rows = random.Random(seed), []
    for i in range(25):
        base = sentence(r, r.randint(30, 160))
        rows.append((len(rows), base, f"s{i % 4}", "x", 1))
        for _ in range(r.randint(0, 6)):
            rows.append((len(rows), edited(r, base, r.randint(0, 5)), f"s{i % 4}", "x", 1))
    return rows + odd_rows()


def brute_components(rows, width, percent):
    def shingles(text):
        w = [x for x in re.split(r"[ \x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(x[1]) for x in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    out = []
    for i, x in enumerate(rows):
        ids = [y[0] for y, c in zip(rows, comp, strict=True) if c == comp[i] and y[0] is not None]
        out.append((x[0], len(sets[i]), x[0] if not sets[i] else min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "percent", "seed", "heavy"), [(3, 90, 1, 3), (5, 80, 2, 2000), (1, 60, 3, 4)])
def test_ngram_join(spark, width, percent, seed, heavy, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rows = corpus(seed)
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), width, percent)
    assert sorted([tuple(x) for x in found.collect()], key=repr) == brute_components(rows, width, percent)


def test_ngram_join_of_nothing_and_one_of_each(spark, tmp_path):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, sentence(random.Random(5), 40), "s", "x", 1)] * 3 + [(2, None, "s", "x", 1), (None, "", "s", "x", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    kept = ngram_join.one_of_each(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == ["doc_id", "text", "source", "component_id", "n"] and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 2]


@pytest.mark.parametrize("block", [10_000, 5])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    r = random.Random(2)
    items = [(i, sentence(r, r.randint(6, 60) if i < 9 else i - 4)) for i in range(12)] + [(50, None), (51, "only three words"), (52, ""), (52, "")]
    rows = corpus(3)
    for i, text in items[:12]:
        rows += [(2000 + i, sentence(r, 300) + " " + text.upper() + " " + sentence(r, 50), "s", "x", 1), (3000 + i, edited(r, text, 1), "s", "x", 1)]
    rows.append((4000, "here are only three words too", "s", "x", 1))
    for i, text in items[:12]:
        w, parts = text.split(), []
        for k in range(4):
            parts += [*w[k * len(w) // 4 : (k + 1) * len(w) // 4], *sentence(r, 200).split()]
        half = [*w[: len(w) // 2], *sentence(r, 400).split(), *w[len(w) // 2 :]]
        rows += [(5000 + i, " ".join(parts), "s", "x", 1), (6000 + i, " ".join(half), "s", "x", 1)]

    def shingles(text, k):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    expected = []
    for d in rows:
        for i, text in items:
            k = min(5, len((text or "").split()))
            s = shingles(text, k) if k else set()
            both = len(s & shingles(d[1], k)) if k else 0
            if s and 100 * both >= 80 * len(s):
                expected.append((d[0], i, len(s), both))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=repr) == sorted(expected, key=repr)
    kept = decontaminate.decontaminated(docs, bench)
    bad = {x[0] for x in expected}
    assert kept.columns == docs.columns and sorted(x["doc_id"] or -1 for x in kept.collect()) == sorted(x[0] or -1 for x in rows if x[0] not in bad)
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0 and decontaminate.contaminated(docs.filter("false"), bench).count() == 0


def test_shingles_of_short_and_empty_sequences():
    h = WordHashes().of([b"a", b"b"])
    assert len(shingle_hashes(h, 5)) == 1 and len(shingle_hashes(h[:0], 5)) == 0


def labelled(kind, n=240):
    r, rows, labels = random.Random(9), [], []
    for i in range(n):
        text, y = sentence(r, r.randint(20, 200)), int(r.random() < 0.4)
        if kind == "quality":
            text = text if y else " ".join(w + r.choice(["***", "###", "&&&"]) for w in text.split())
        elif y:
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumbly", "snorkish", "plomper", "grumbIy" if i % 7 == 0 else "grumbly"]))
            text = " ".join(w)
        rows.append((i, text, "s", "x", 1))
        labels.append((i, y, y))
    return rows + odd_rows(), labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    rows, labels = labelled(kind)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = quality_model.score_quality if kind == "quality" else toxicity.score_toxicity
    found = score(docs, known, learn_from=F.col("doc_id") % 3 != 1).collect()
    assert len(found) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in found)
    truth = {i: y for i, y, _ in labels}
    held = [x["predicted"] == truth[x["doc_id"]] for x in found if x["doc_id"] in truth and x["doc_id"] % 3 == 1]
    assert np.mean(held) > 0.9
    assert score(docs, known.filter("false"), learn_from=F.lit(True)).count() == len(rows) and score(docs.filter("false"), known, learn_from=F.lit(True)).count() == 0


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_finds_what_edit_distance_finds():
    r = random.Random(6)
    terms = {"idiot": 2.0, "moron": 1.5, "pathetic": 3.0, "bad": 1.0, "worthless": 2.5}
    lexicon = toxicity.Lexicon(terms)
    words = [*terms, "", "x", "bda", "idoit", "iddiot", "worthles"]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = r.choice(["", r.choice("abeiot"), r.choice("abeiot")])
            words.append("".join(w))
    for w in words:
        near = [(d, -v, t) for t, v in terms.items() if (d := edits_between(w, t)) <= lexicon.edits(t)]
        assert lexicon.find(w) == ((min(near)[2], min(near)[0]) if near else None), w


def test_context_tells_quotation_from_abuse():
    found = toxicity._Finder(toxicity.Lexicon({"moron": 2.0}))
    windows = lambda text: [(x.marked, x.addressed, x.reported) for x in toxicity.hits(text, found)]
    assert windows('He wrote "moron" in the book') == [(True, False, True)]
    assert windows("you utter moron go away") == [(False, True, False)]
    assert windows("don't be such a moron, you're useless and can't think") == [(False, True, False)]
    assert windows("«quel moron», a-t-on lu") == windows("the ‘old moron’ is here") == [(True, False, False)]
    assert windows("„du moron“, hieß es") == [(True, True, False)]
    assert windows('"one" moron "two"') == [(False, False, False)]


def test_automaton_forgets_and_finds_again(monkeypatch):
    monkeypatch.setattr(toxicity.Lexicon, "LIMIT", 5)
    lexicon = toxicity.Lexicon({"worthless": 1.0, "moron": 1.0})
    for _ in range(3):
        assert lexicon.find("wortless") == ("worthless", 1) and lexicon.find("mroon") is None and lexicon.find("moran") == ("moron", 1)


def test_learning_does_not_depend_on_order_or_repeats(spark):
    rows, labels = labelled("quality", 60)
    twice = spark.createDataFrame(rows[::-1] + [(i, "z" + t, *rest) for i, t, *rest in rows[:50]] * 3, DOCS).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = twice.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    sample = quality_model.labelled_sample(text, known, "quality", F.lit(True), 20).collect()
    truth = {str(i): (y, t) for (i, y, _), (_, t, *_) in zip(labels, rows, strict=False)}
    assert len(sample) == 20 == len({x["doc_id"] for x in sample}) and all((x["label"], x["text"]) == truth[x["doc_id"]] for x in sample)
    assert quality_model.score_quality(twice, known, F.lit(True), most_passages=5).count() == twice.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize(("name", "label"), [("op2_quality_model", "quality"), ("op3_toxicity", "toxic")])
def test_real_held_out_labels(spark, name, label):
    data = "/root/testdata/sf0.1"
    found = queries.queries()[name](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("held_out").collect()
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    right = sum(x["predicted"] == x[label] for x in found)
    assert right >= 0.95 * len(found) > 0
    # All that are labelled, whatever is in them; those that are missed are shown.
    sure = [x for x in found if x[label] == 1]
    missed = [(x["doc_id"], round(x["score"], 3), texts[x["doc_id"]][:80]) for x in sure if not x["predicted"]]
    print(f"{name}: {len(sure) - len(missed)} of {len(sure)} held-out rows of label 1 found; missed: {missed}")
    assert len(missed) <= 0.1 * len(sure) and sure


PLAIN = "The meeting was on Monday and the report is due soon. We went home after it."
ABUSE = {
    "exact": "You are an idiot and a pathetic moron, you clown.",
    "a letter more": "You are an idiott and a patthetic moronn, you cllown.",
    "a letter less": "You are an idot and a pathtic moon, you clwn.",
    "another letter": "You are an idoot and a pathetik morom, you klown.",
    "a digit": "You are an idi0t and a pathet1c mor0n, you cl0wn.",
    "mark my word": "Mark my word, you are an idiot and a pathetic moron, you clown.",
    "scare quotes": 'You are an "idiot" and a "pathetic" "moron", you "clown".',
}
FAIR = {
    "report": 'The review said "the idiot is a pathetic moron" and it was removed.',
    "mention": 'The word "idiot" comes from Greek, as does the word "moron".',
    "none": "Nothing was found there.",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_misspelt_abuse_is_toxic_and_quotation_is_not(spark):
    data = "/root/testdata/sf0.01"
    terms = ["idiot", "moron", "pathetic", "clown", "loser"]
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    bent = {f"{t} {k}": f"{PLAIN} You are a {x}, you {x}." for t in terms for k, x in (("twice", t[:2] + t[1:]), ("swap", t[:-1] + "q"), ("drop", t[:3] + t[4:]))}
    probes = {k: f"{t} {PLAIN}" for k, t in (ABUSE | FAIR).items()} | bent
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(probes.values())], "doc_id long, text string")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text").union(extra), labels, F.lit(True)).filter("doc_id >= 1000000000").collect()
    score = {k: x["score"] for k, x in zip(probes, sorted(scored, key=lambda x: x["doc_id"]), strict=True)}
    print({k: round(v, 3) for k, v in score.items()})
    assert all(score[k] >= 0.5 for k in [*ABUSE, *bent])
    assert all(score["none"] <= score[k] < 0.5 for k in FAIR)
    assert score["mark my word"] == pytest.approx(score["exact"], abs=0.01) and score["scare quotes"] == pytest.approx(score["exact"], abs=0.01)


def test_windows_quote():
    found = toxicity._Finder(toxicity.Lexicon({"moron": 2.0}))
    quoted = lambda text: [x.quoted for x in toxicity.hits(text, found)]
    for text in ('He wrote "moron" in the book', 'the word "moron" is old', "«quel moron», a-t-on lu", "„du moron“, hieß es", "she said the old moron left"):
        assert quoted(text) == [True], text
    for text in ('you are a "moron" my friend', "mark my word you moron", "you utter moron", 'I said that you are a "moron"', 'a "moron" is a "moron"'):
        assert not any(quoted(text)), text


def test_every_term_of_a_run_is_found():
    found = toxicity._Finder(toxicity.Lexicon({"moron": 2.0, "idiot": 1.0}))
    terms = lambda text: [x.term for x in toxicity.hits(text, found)]
    for sep in (",", "/", "_", "─"):
        assert terms(sep.join(["nice", "moron", "day", "iddiot", "moron"])) == ["moron", "idiot", "moron"]
        assert terms(sep.join(["nice", *["moron", "day"] * 300, "idiot"])) == ["moron"] * 300 + ["idiot"]
    assert terms("m.o.r.o.n") == ["moron"] and terms("İ,moron" + ",x" * 200) == ["moron"] and all(len(w) < 200 for w in found)
    run = "you,moron," + "day," * 200 + 'he,said,"moron",then,left,the,very,old,big,red,house,a,moron'
    assert [(x.marked, x.addressed, x.reported) for x in toxicity.hits(run, found)] == [(False, True, False), (True, False, True), (False, False, False)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_pii_base_spans_are_those_of_the_patterns():
    r, parts = random.Random(7), ["a@b.c", "@", "x_y", "a@b", ".", "_d@e.f", "1.2.3.4", "300.1.1.1", "+1 (499) 555-6503", "4111 1111 1111 1111", "4111111111111112", " ", "-", "9", "é", "0001.2.3.4.5"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        expected = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
        expected += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for k, p, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if low <= len(d) <= high and (k == 3 or pii.luhn(d)):
                    expected.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(expected), text


def test_pii_zeros_before_an_address_part():
    assert (0, 1, 5007) in pii.base_spans("0" * 5000 + "1.2.3.4")


def test_pii_field_on_held_out_regions():
    field = pii.SegmentField().fit(pii.generated(300, 5))
    right = wrong = missed = 0
    for text, gold in pii.generated(150, 99):
        found = {((a, e), k) for a, k, e in field.best(text)}
        right += len(found & set(gold.items()))
        wrong += len(found - set(gold.items()))
        missed += len(set(gold.items()) - found)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


#: Written by hand: texts and the personal data in them, in order.
WRITTEN = [
    ("Call (212) 555-0188 after noon.", ["(212) 555-0188"]),
    ("fax 212-555-0143, office 415-555-0199", ["212-555-0143", "415-555-0199"]),
    ("Telefon 0049 301 555 0187 oder mail an eva.k@firma.example.de", ["0049 301 555 0187", "eva.k@firma.example.de"]),
    ("card 4111.1111.1111.1111 was charged", ["4111.1111.1111.1111"]),
    ("card 4111 1111 1111 1111 was charged", ["4111 1111 1111 1111"]),
    ("from 10.0.0.1 to 192.168.12.7.", ["10.0.0.1", "192.168.12.7"]),
    ("tel +33 (145) 555-0134; bob_9@site.org", ["+33 (145) 555-0134", "bob_9@site.org"]),
    ("order 2024-05-17 of 12,500,000 units", []),
    ("commit 9f86d081884c7d659a2feaa0c55ad015", []),
    ("version 1.22.333.4444.5", []),
    ("see room 1234567 or @handle42", []),
    ("ISBN 978-3-1614-8410-0 in print", []),
    ("It was 2023-11-02 10:15:22 then.", []),
    ("pi is 3.14159265358979", []),
    ("00441 207 555 0111 is London", ["00441 207 555 0111"]),
    ("write to x.y2@mail.example.net or (650) 555-0170", ["x.y2@mail.example.net", "(650) 555-0170"]),
]


def test_pii_on_texts_written_by_hand():
    field = pii.SegmentField().fit(pii.generated(300, 5))
    right = wrong = missed = 0
    for text, expected in WRITTEN:
        base = pii.base_spans(text)
        found = [text[a:e] for a, _, e in base] + [text[at + a : at + e] for at, to in pii.regions(text, base) for a, _, e in field.best(text[at:to])]
        right += len(set(found) & set(expected))
        wrong += len(set(found) - set(expected))
        missed += len(set(expected) - set(found))
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9


def test_pii_best_segmentation_is_that_of_enumeration():
    r = np.random.default_rng(2)
    field = pii.SegmentField(r.normal(0, 1, (4, pii.FEATURES + 5)))
    for text in ("12 345 67", "a@b.c 4", "+12-34", "1.2.3.4"):
        cuts, found, x = field.candidates(text)
        scores = x @ field.w[:, : pii.FEATURES].T
        best = (0.0, [])

        def go(at, state, total, taken):
            nonlocal best
            best = max(best, (total, taken), key=lambda t: t[0])
            for k, (i, j) in enumerate(found):
                if i >= at:
                    for kind in range(4):
                        go(j, kind + 1, total + scores[k, kind] + field.after[state, kind], [*taken, (cuts[i], kind, cuts[j])])

        go(0, 0, 0.0, [])
        assert field.best(text) == best[1]


def test_pii_gradient_is_that_of_the_likelihood():
    text, gold = "x 12 345-67", {(2, 8): 3}
    field = pii.SegmentField(np.random.default_rng(4).normal(0, 0.3, (4, pii.FEATURES + 5)))

    def likelihood(w):
        f = pii.SegmentField(w)
        cuts, found, x = f.candidates(text)
        scores, totals, truth = x @ f.w[:, : pii.FEATURES].T, [], None

        def go(at, state, total, taken):
            nonlocal truth
            totals.append(total)
            truth = total if taken == gold else truth
            for k, (i, j) in enumerate(found):
                if i >= at:
                    for kind in range(4):
                        go(j, kind + 1, total + scores[k, kind] + f.after[state, kind], {**taken, (cuts[i], cuts[j]): kind})

        go(0, 0, 0.0, {})
        return truth - np.logaddexp.reduce(totals)

    g, h = field.gradient(text, gold), 1e-5
    for at in [(0, 0), (3, 14), (2, 13), (3, pii.FEATURES), (1, pii.FEATURES + 2)]:
        step = np.zeros_like(field.w)
        step[at] = h
        assert g[at] == pytest.approx((likelihood(field.w + step) - likelihood(field.w - step)) / (2 * h), abs=1e-4)


def test_pii_rows(spark):
    rows = [*odd_rows(), (1, "call (212) 555-0188 or me.x@y.org now", "s", "x", 1)]
    found = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(s["kind"], s["value"]) for s in found[1]["base"]] == [("email", "me.x@y.org")] and found[900]["base"] == []
    assert [(s["kind"], s["value"]) for s in found[1]["extra"]] == [("phone", "(212) 555-0188")]


def brute_rules(text):
    text = text or ""
    words = [w for w in re.split(r"[ \x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def brute_good_lines(text):
    """The lines that no rule fails, said another way: entries are found by walking runs."""
    lines, blanks = (text or "").split("\n"), " \t\n\x0b\x0c\r"
    entry = [0 < len(x.strip(blanks)) <= 40 and len(x) <= 80 and len(x.split()) <= 3 and x.strip(blanks)[-1] not in quality_rules.CLOSING for x in lines]
    listed, i = set(), 0
    while i < len(lines):
        k = i
        while k < len(lines) and entry[k]:
            k += 1
        listed |= set(range(i, k)) if k - i >= 4 else set()
        i = max(k, i + 1)
    good = []
    for i, x in enumerate(lines):
        odd = sum(w in quality_rules.SEPARATORS or w.startswith(("http://", "https://", "www.")) for w in x.split())
        bad = [
            i in listed,
            len(x) <= 40 and x.strip(blanks).lower() in quality_rules.NAVIGATION,
            sum(c in quality_rules.MARKS for c in x) * 14 > len(x),
            len(x) > 40 and x.count("!") * 25 > len(x),
            odd >= 2 and 3 * odd >= len(x.split()),
            any(b in x.lower() for b in quality_rules.BOILERPLATE),
        ]
        if not any(bad):
            good.append(x)
    return good


def test_quality_rules(spark):
    r, rows = random.Random(5), odd_rows()
    odd_lines = ["Startseite", "Lire la suite", "a › b › c › d", "see https://x.y www.z.w", "one two", "three", "Four", "five six", "Alle Rechte vorbehalten.", "wow!!!! " * 8, "x | y | z", "Über uns", "- - -", "", " \t"]
    for i in range(60):
        lines = [sentence(r, r.randint(1, 30)) for _ in range(r.randint(1, 6))]
        lines += [r.choice(odd_lines) for _ in range(r.randint(0, 8))]
        rows.append((i, "\n".join(lines + [r.choice(lines) for _ in range(r.randint(0, 3))]) + r.choice(["", "\n", "\t ", "###"]), "s", "x", 1))
    menu = "\n".join(["Home", "a | b | c | d | e", *[sentence(r, 40)] * 1, "All rights reserved."])
    rows.append((500, menu, "s", "x", 1))
    rows.append((501, " ".join(w + "***" for w in sentence(r, 60).split()), "s", "x", 1))
    docs = spark.createDataFrame(rows, DOCS)
    found = quality_rules.measure(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for x, row in zip(found, rows, strict=True):
        assert tuple(x[c] for c in names) == brute_rules(row[1]), row
        good = "\n".join(brute_good_lines(row[1]))
        assert x["cleaned"] == good or good == (row[1] or ""), row
        assert x["kept"] == (not x["base_failed"] and 2 * len("".join(good.split())) >= x["word_chars"]), row
    by_id = {x["doc_id"]: x for x in found}
    assert by_id[500]["kept"] and by_id[500]["cleaned"] == menu.split("\n")[2] and not by_id[501]["kept"]
    kept = quality_rules.cleaned(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x["kept"] for x in found)
    assert quality_rules.measure(docs.filter("false")).count() == 0


def test_quality_rules_keep_columns_of_their_own_names(spark):
    names = ["doc_id", "text", "words", "lines", "row", "kept", "cleaned", "doc", "good"]
    docs = spark.createDataFrame([(1, sentence(random.Random(1), 30), *"abcdefg")], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    assert [tuple(x) for x in quality_rules.cleaned(docs).collect()] == [tuple(x) for x in docs.collect()]


def test_bitmaps_never_drop_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        whole = r.integers(0, 1 << 63, int(r.integers(1, 900)), np.uint64)
        a, b = (np.unique(whole[r.random(len(whole)) < share]) for share in (0.95, r.uniform(0.5, 1)))
        if len(a) and len(b):
            both = len(np.intersect1d(a, b))
            for percent in (50, 80, 90):
                linked = 100 * both >= percent * (len(a) + len(b) - both)
                assert not linked or ngram_join._may_link(ngram_join._bitmap(a), len(a), ngram_join._bitmap(b), len(b), percent)


def test_attention_model_by_plain_loops():
    r = np.random.default_rng(5)
    model = quality_model.AttentionModel.new(1)
    p = {k: w + r.normal(0, 0.1, w.shape) for k, w in model.weights.items()}
    model.weights = p
    bags = [r.normal(0, 1, (n, quality_model.FEATURES)) for n in (1, 4, 2)]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for bag, score in zip(bags, model.score(bags), strict=True):
        h = [np.tanh(x @ p["we"] + p["be"]) for x in bag]
        e = [np.exp((np.tanh(v @ p["v"] + p["bv"]) * sigmoid(v @ p["u"] + p["bu"])) @ p["w"]) for v in h]
        assert score == pytest.approx(sigmoid(sum(a * v for a, v in zip(e, h, strict=True)) / sum(e) @ p["c"] + p["b"][0]))
    x, first, y, weight = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss(weights):
        s = quality_model.AttentionModel(weights).score(bags)
        return -(weight / weight.sum() * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    grads = model.gradients(x, first, y, weight)
    for name, at in (("we", (3, 2)), ("be", (1,)), ("v", (2, 3)), ("u", (4, 1)), ("w", (2,)), ("c", (5,)), ("b", (0,))):
        up, down = ({k: w.copy() for k, w in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_pii_of_nothing(spark):
    assert pii.find_pii(spark.createDataFrame([], DOCS), examples=5).count() == 0
