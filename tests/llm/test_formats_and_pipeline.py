"""Chat formatting and HTML extraction, exact; the pipeline on files; queries against their SQL."""

from __future__ import annotations

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import chat_format, html_text, ngram_join, queries, quality_rules
from tests.llm.test_secrets_and_mixing import brute_mix, brute_secrets
from tests.llm.test_text_operators import brute_components, brute_good_lines, brute_rules, corpus, sentence

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chats_are_read_back_exactly(spark):
    r, rows = random.Random(1), []
    bits = ["\\", "###", "#", "</turn>", "</part>", "\n", ": ", "a", "é", "\\h", "</turn>\n", "### User: ", ""]
    for c in range(40):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "tool: #x\\", "assistant"]), "".join(r.choice(bits) for _ in range(r.randint(0, 6))), "z"))
    rows += [(77, None, None, None, "z"), (77, 1, "assistant", None, "z"), (77, 1, "assistant", None, "z"), (None, 1, "user", "x" * 100_000, "z")]
    f = chat_format.format_chats(spark.createDataFrame(rows, TURNS))
    found = f.select("conv_id", "formatted", chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt")).collect()
    for x in found:
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == x["conv_id"]])
        assert [tuple(t) for t in x["turns"]] == [o[1:] for o in own]
        assert x["learnt"] == "".join(o[2] for o in own if o[1] == "assistant")
    merged = {x["conv_id"]: x["formatted"] for x in found}
    assert merged[77].count("</turn>\n") == 2
    assert len(found) == len({x[0] for x in rows}) and chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_take_linear_time(spark):
    def timed(n):
        turn = [F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é said ###"), F.col("id")).alias("text")]
        f = chat_format.format_chats(spark.range(n).select(*turn))
        began = time.perf_counter()
        found = f.select(F.size(chat_format.read_chats(F.col("formatted"))).alias("n"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt")).head()
        assert found["n"] == n and found["learnt"] == "".join(f"é said ###{i}" for i in range(n) if i % 3)
        return time.perf_counter() - began

    timed(1000)
    assert timed(100_000) < 2.5 * timed(50_000) + 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu, one.</a></li></ul></nav><!-- x <p>no</p> --><div class="ad">Buy, now.</div>
<article><h1>Head &amp; more</h1><p><b>First  line,</b>
 and&nbsp;more.<br><p>Second &lt;b&gt; one.</p><aside>Aside, that is.</aside><div class="comments"><p>I disagree, strongly.</p></div><form>F<input></form></article><footer>&copy; Foot, er.</footer></body></html>"""
PLAIN = "<body><div id=sidebar>Side, bar, text.</div><div class=content><h2>Head</h2><p>Long text, with commas, and more of it to read.</p><p>And a second, as long as that one was, in the end.</p></div><div class=footer>f</div>"


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & more\n\nFirst line, and more.\n\nSecond <b> one."
    assert html_text.main_text(PLAIN) == "Head\n\nLong text, with commas, and more of it to read.\n\nAnd a second, as long as that one was, in the end."
    assert html_text.main_text("<p>cut &am") == "cut &am"
    assert [html_text.main_text(x) for x in (None, "", "<nav>only</nav>", "<p> </p>", "</div></p>")] == [""] * 5


def test_marks_that_wrap_the_article():
    text = "A long first sentence, with commas, that tells it all.\n\nAnd a second one, as long as that, to read on."
    body = "".join(f"<p>{x}</p>" for x in text.split("\n\n"))
    rest = "<div class='related-posts'><p>Read more, here.</p></div><div class='ad'>Buy now!</div>"
    for marks in ("content no-sidebar", "has-sidebar", "with-comments", "search-result", "related-work", "content sidebar", "search"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
            assert html_text.main_text(f"<body><div class='{marks}'>{inner}</div>{rest}</body>") == text, marks
    comments = "<div class='comments'><article><p>" + "A comment, much longer than all of it. " * 9 + "</p></article></div>"
    assert html_text.main_text(f"<body><main><article>{body}</article>{comments}</main></body>") == text


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(x["n_chars"] for x in found) == [0, 51, 51] and html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t if t is None or len(t) > 1000 else "\n".join([t, "Token: abcdefgh12345678"]), "en", s, len(t or "")) for i, t, s, *_ in corpus(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[0][1].split()[:20]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_pipeline_stages(spark, files):
    docs = spark.read.parquet(f"{files}/documents.parquet")
    names, seen = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, files)
        out.write.parquet(f"{files}/stage{at}")
        docs = spark.read.parquet(f"{files}/stage{at}")
        seen[name] = docs.collect()
        assert docs.columns == names
    source = spark.read.parquet(f"{files}/documents.parquet")
    assert len(seen["quality_rules"]) == quality_rules.measure(source).filter("kept").count()
    words = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    kept = [words(x["text"]) for x in seen["ngram_jaccard_join"]]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])
    assert 0 not in {x["doc_id"] for x in seen["decontaminate"]} and len(seen["decontaminate"]) < len(seen["ngram_jaccard_join"])
    assert all("abcdefgh12345678" not in x["text"] and x["n_chars"] == len(x["text"]) for x in seen["secret_scan"])
    assert {x["doc_id"] for x in seen["mixing"]} <= {x["doc_id"] for x in seen["secret_scan"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    mine = queries.queries()[name](spark, DATA)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(x[c] for c in columns)) for x in mine.collect())


def test_one_of_each_when_files_are_dealt_otherwise(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(i, sentence(r, 40), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, t, *rest) for i, t, *rest in rows[::2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(8).write.parquet(f"{tmp_path}/d")
    join, conf = ngram_join.jaccard_components, "spark.sql.files.maxPartitionBytes"

    def join_and_lose_an_executor(*args, **named):
        found = join(*args, **named)
        spark.conf.set(conf, "1m")
        return found

    monkeypatch.setattr(ngram_join, "jaccard_components", join_and_lose_an_executor)
    try:
        kept = [x["text"] for x in ngram_join.one_of_each(spark.read.parquet(f"{tmp_path}/d")).collect()]
    finally:
        spark.conf.unset(conf)
    assert sorted(kept) == sorted({x[1] for x in rows})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_run(rows, items):
    """Every stage of the pipeline over (doc_id, text, lang, source, n_chars), said another way; rows in their order."""
    kept = []
    for x in rows:
        good = "\n".join(brute_good_lines(x[1]))
        _, word_chars, *_, failed = brute_rules(x[1])
        if not failed and 2 * len("".join(good.split())) >= word_chars:
            kept.append((x[0], good, x[2], x[3], len(good)))
    groups = brute_components([(i, x[1]) for i, x in enumerate(kept)], 5, 80)
    kept = [kept[i] for i, _, first in sorted(groups) if i == first]
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    kept = [x for x in kept if not any(100 * len(shingles(i) & shingles(x[1])) >= 80 * len(shingles(i)) for i in items)]
    clean = []
    for x, (_, base, extra) in zip(kept, brute_secrets([(x[0], x[1], x[3]) for x in kept]), strict=True):
        text, at = "", 0
        for start, _, stop, *_ in sorted(base + extra):
            if start >= at:
                text += x[1][at:start] + "[secret]"
            at = max(at, stop)
        text += x[1][at:]
        clean.append((x[0], text, x[2], x[3], len(text)))
    mixed = brute_mix([(x[0], x[1], x[3]) for x in clean])
    return sorted([x for x, m in zip(clean, mixed, strict=True) for _ in range(m[4])], key=repr)


def test_run_equals_brute_force(spark, tmp_path):
    r, rows = random.Random(12), []
    for i, t, s, *_ in corpus(8):
        extra = ["Token: abcdefgh12345678", "Startseite", "a › b › c", f"key Zyxwvuts9rqponmlkjih{i} end.", "see Bbcdefgh1jklmnopqrstu there.", "Alle Rechte vorbehalten."]
        rows.append((i, t if t is None or len(t) > 1000 else "\n".join([t, *r.sample(extra, 3)]), "en", s, len(t or "")))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [" ".join(rows[0][1].split()[:20]), " ".join(rows[30][1].split()[2:12])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert found == brute_run(rows, items) and len({x[0] for x in found}) > 10


def test_run_with_clashing_columns_and_with_nothing(spark, tmp_path):
    names = ["base", "extra", "doc", "row", "_row", "_text", "_size", "size", "copies", "words", "key", "component_id"]
    rows = [(i, sentence(random.Random(i), 40), "en", "s", 1, *["v"] * len(names)) for i in range(12)] + [(None, None, None, None, None, *[None] * len(names))]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        found = out.collect()
        assert out.columns == schema.replace(" long", "").replace(" string", "").split(", ") and (len(found) > 0) == bool(some)
        assert all(x[n] == "v" for x in found for n in names)
