"""Text functions as Spark expressions; only Unicode folding needs a vectorised UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a match key; Greek letters by name; Roman numerals, always and after "type".
FILLERS = ("disease", "syndrome", "disorder", "type", "the", "of", "a", "an", "and", "form")
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "ς": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
ROMAN_AFTER_TYPE = {"i": "1", "v": "5", "x": "10"}
#: Dashes and other characters that part words.
PARTING = r"[‐-―−­_/-]"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def squeezed(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, most: int) -> Column:
    """A squeezed text of at most `most` characters, cut at a word with an ellipsis after it."""
    t = squeezed(text)
    head = F.substring(t, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def folded(text: Column) -> Column:
    """Compatibility form and full case folding, which Spark has no function for. Only texts that aren't ASCII go through Arrow; of others it is lower()."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    is_ascii = F.length(text) == F.octet_length(text)
    return F.coalesce(F.when(is_ascii, F.lower(text)), F.pandas_udf(fold, "string")(F.when(~is_ascii, text)))


def tokens(t: Column) -> Column:
    """Words of a text that is folded(): Greek letters by name, dashes, underscores and slashes as blanks, apostrophes and other marks
    gone, Roman numerals as digits. None for an empty text."""
    return _in_digits(_words(t))


def _words(t: Column) -> Column:
    spelt = t
    for letter, name in GREEK.items():
        spelt = F.replace(spelt, F.lit(letter), F.lit(f" {name} "))
    t = F.when(F.regexp_like(t, F.lit("[α-ω]")), spelt).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, PARTING, " "), "'", "")
    return F.filter(F.split(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")


def _in_digits(words: Column) -> Column:
    always, after = literal_map(ROMAN), literal_map(ROMAN_AFTER_TYPE)
    return F.transform(words, lambda w, i: F.coalesce(always[w], F.when(F.get(words, i - 1) == "type", after[w]), w))


def plain(text: Column) -> Column:
    """tokens() of a folded text parted by one blank."""
    return F.array_join(tokens(text), " ")


def registry_name(text: Column) -> Column:
    """Name as a registry's conditions are compared: possessive 's dropped, ASCII words, i to iv always digits."""
    words = F.regexp_extract_all(F.replace(F.lower(text), F.lit("'s"), F.lit("")), F.lit("([a-z0-9]+)"), F.lit(1))
    digits = literal_map({"i": "1", "ii": "2", "iii": "3", "iv": "4"})
    return F.array_join(F.transform(words, lambda w: F.coalesce(digits[w], w)), " ")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def content(words: Column) -> Column:
    """The words but fillers, or all of them if nothing else is left."""
    kept = F.filter(words, lambda w: ~w.isin(*FILLERS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def content_tokens(text: Column) -> Column:
    return content(tokens(text))


def match_key(text: Column) -> Column:
    """Content words of a folded text parted by one blank."""
    return F.array_join(content_tokens(text), " ")


def with_tokens(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with a column of the words of a text. The folded text is a column first: a UDF can't stand inside a lambda. So are the words
    before numerals are read: a lambda that looks at all words would part the text again at each."""
    return df.withColumn("_folded", folded(text)).withColumn("_words", _words(F.col("_folded"))).withColumn(name, _in_digits(F.col("_words"))).drop("_folded", "_words")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two arrays; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def numbers(text: Column) -> Column:
    """Decimals, and integers of two digits and more."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+\.[0-9]+|[0-9]{2,})"), F.lit(1))


def first_sentence(text: Column) -> Column:
    head = F.trim(F.substring_index(text, ". ", 1))
    return F.when(F.endswith(head, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))
