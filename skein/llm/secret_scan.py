"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Fixed patterns give the base spans, and any other long token of mixed characters is a candidate too. The hashes of
all candidates, base ones included, are aggregated over the corpus by the distinct owners and repositories that hold
them: what many share is a widely copied example, what few hold looks like a live credential. Each span carries that
verdict. Base spans stay whatever it is; a token becomes a span only if it is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, running, text_of
from skein.operators.work import saved

#: The base patterns and their least lengths (of group 2 for assign, of the match otherwise).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 1, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: Long tokens with the letters and marks of encoded keys; candidates are those with upper case, lower case and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MASK = "[secret]"
SPAN = "struct<start:bigint,order:int,kind:string,stop:bigint,value:string>"
#: Share of all occurrences from which a secret is looked up in a broadcast table: there are at most so many of them.
HEAVY = 1000


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of SPAN, code points, of a pattern's leftmost matches of enough length.

    The text between matches and the matches themselves, both in order, give the places.
    """
    order = [*BASE, "token"].index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(m: Column) -> Column:
        steps = F.transform(m["hits"], lambda h, i: (F.length(F.get(m["gaps"], i)) + F.coalesce(F.length(F.get(m["hits"], i - 1)), F.lit(0))).cast("long"))
        rows = F.arrays_zip(running(steps, F.lit(0).cast("long"), lambda a, b: a + b).alias("start"), m["hits"].alias("hit"), m["values"].alias("value"))
        span = lambda r: F.struct(r["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (r["start"] + F.length(r["hit"])).alias("stop"), r["value"].alias("value"))
        return F.transform(F.filter(rows, lambda r: F.length(r["value"]) >= least), span)

    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("hits"), value.alias("values")), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array()).cast(f"array<{SPAN}>")


def _apart(spans: Column) -> Column:
    """Spans, ordered by start, without the tokens that overlap a base span."""
    token, long = F.lit([*BASE, "token"].index("token")), lambda x: F.lit(x).cast("long")
    late, never = long(-1), long(1 << 60)

    def kept(s: Column) -> Column:
        stops = running(F.transform(s, lambda x: F.when(x["order"] < token, x["stop"]).otherwise(late)), late, F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(s), lambda x: F.when(x["order"] < token, x["start"]).otherwise(never)), never, F.least))
        rows = F.arrays_zip(s.alias("span"), stops.alias("before"), starts.alias("after"))
        return F.transform(F.filter(rows, lambda r: (r["span"]["order"] < token) | ((r["before"] <= r["span"]["start"]) & (r["after"] >= r["span"]["stop"]))), lambda r: r["span"])

    return F.when(F.size(spans) > 0, let(spans, kept)).otherwise(spans)


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str | None = None, most_owners: int = 2, most_repositories: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, doc (a struct of the columns of keep), base and extra; these are arrays of
    (start, order, kind, stop, value, owners, repositories, verdict), code points, ordered by start and kind.

    base holds every match of the fixed patterns. extra holds the tokens that don't overlap a base span and are live.
    A candidate is live if at most most_owners distinct owners and at most most_repositories distinct repositories
    hold its value, else copied. Without a column for it, a repository is a text of an owner, so exact copies of a
    text count once for each owner that has them. A null owner or repository counts as one more.

    Null and empty texts have no spans; repeated rows are returned as often as they occur. Columns of docs may have
    any names. The scanned rows are written to the shared folder, with the columns of keep only.
    """
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(*(keep or ["doc_id"])).alias("doc"),
        F.col(owner).cast("string").alias("owner"),
        (F.col(repository).cast("string") if repository else F.sha2(text, 256)).alias("repository"),
        text.alias("whole"),
    )
    spans = {k: _spans(F.col("whole"), k, *v) for k, v in (*BASE.items(), ("token", (TOKEN, 0, 20)))}
    mixed = F.filter(spans["token"], lambda t: F.regexp_like(t["value"], F.lit("[0-9]")) & F.regexp_like(t["value"], F.lit("[A-Z]")) & F.regexp_like(t["value"], F.lit("[a-z]")))
    found = F.sort_array(F.concat(*[spans[k] for k in BASE], mixed))
    scanned = rows.select("doc_id", "doc", "owner", "repository", found.alias("found")).withColumn("found", _apart(F.col("found")))
    scanned = saved(scanned.withColumn("row", F.monotonically_increasing_id()))
    each = scanned.filter(F.size("found") > 0).select("row", "owner", F.when(F.lit(repository is None), F.concat_ws("\0", "owner", "repository")).otherwise(F.col("repository")).alias("repository"), F.explode("found").alias("span"))
    each = each.withColumn("secret", F.sha2("span.value", 256))
    owned = saved(ownership(each))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = owned.select("secret", "n", "owners", "repositories", F.when(live, "live").otherwise("copied").alias("verdict"))
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    heavy = F.col("n") * HEAVY > total
    # Secrets that many rows hold are few and come by broadcast; no other one is a large part of the shuffle.
    often = each.join(F.broadcast(judged.filter(heavy)), "secret")
    seldom = each.join(F.broadcast(judged.filter(heavy).select("secret")), "secret", "left_anti").join(judged.filter(~heavy), "secret")
    full = F.struct("span.*", "owners", "repositories", "verdict")
    by_row = often.unionByName(seldom).groupBy("row").agg(F.sort_array(F.collect_list(full)).alias("all"))
    base = F.filter("all", lambda s: s["order"] < len(BASE))
    extra = F.filter("all", lambda s: (s["order"] == len(BASE)) & (s["verdict"] == "live"))
    some = scanned.filter(F.size("found") > 0).select("row", "doc_id", "doc").join(by_row, "row").select("doc_id", "doc", base.alias("base"), extra.alias("extra"))
    none = F.array().cast(some.schema["base"].dataType)
    return some.unionByName(scanned.filter(F.size("found") == 0).select("doc_id", "doc", none.alias("base"), none.alias("extra")))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per secret of candidates (secret, owner, repository): n, its rows, and its distinct owners and repositories.

    Rows are reduced to distinct triples and these to counts, each before the shuffle as well, so neither a secret
    that a third of all rows hold nor one that all owners share is gathered in one task.
    """
    null = F.lit("\0")
    triples = candidates.groupBy("secret", F.coalesce("owner", null).alias("o"), F.coalesce("repository", null).alias("r")).agg(F.count("*").alias("n"))
    return triples.groupBy("secret").agg(F.sum("n").alias("n"), F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repositories"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by MASK; spans are ordered by start."""
    zero = F.lit(0).cast("long")

    def replaced(s: Column) -> Column:
        def joined(ends: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                at = F.coalesce(F.get(ends, i - 1), zero)
                return F.when(x["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")), F.lit(MASK))).otherwise("")

            return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))

        return let(running(F.transform(s, lambda x: x["stop"].cast("long")), zero, F.greatest), joined)

    return F.when(F.size(spans) > 0, let(spans, replaced)).otherwise(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs, their columns only, with base spans and live tokens masked in text, and n_chars to match if it is there.

    Null and empty texts stay as they are; repeated rows stay; no row goes. n_chars of a null text is 0.
    """
    found = scan_secrets(docs, keep=tuple(docs.columns))
    spans = F.sort_array(F.concat("base", "extra"))
    text = F.col("doc.text")
    out = found.select("doc", F.when(F.size(spans) > 0, masked(text, spans)).otherwise(text).alias("clean"))
    size = F.coalesce(F.length("clean"), F.lit(0))
    new = {"text": F.col("clean"), "n_chars": size}
    return out.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("doc")[f.name]).alias(f.name) for f in docs.schema])
