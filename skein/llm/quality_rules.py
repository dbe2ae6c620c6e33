"""Line-first quality rules with DataFrame functions only.

Rules of punctuation, navigation and boilerplate look at each line; lines that fail are removed; documents
that lose too much of their text that way, or fail the base measures, are rejected.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BLANKS, let, text_of, without, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Marks too many of which are no prose; marks that part the entries of a menu; marks that close a line of prose.
MARKS, SEPARATORS, CLOSING = SYMBOLS + "~^", "|/·•›»→>-", ".!?…:;,\"'”“»)"
#: Entries of menus and standing phrases, in lower case, in the four languages.
NAVIGATION = (
    "home", "menu", "login", "log in", "log out", "sign in", "sign up", "register", "search", "next", "previous", "back", "back to top", "skip to content", "contact", "contact us", "about", "about us", "share this", "read more", "more", "help", "sitemap",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "suche", "suchen", "weiter", "zurück", "nach oben", "zum inhalt", "kontakt", "über uns", "teilen", "mehr lesen", "weiterlesen", "mehr", "hilfe", "impressum",
    "accueil", "connexion", "déconnexion", "se connecter", "s'inscrire", "rechercher", "recherche", "suivant", "précédent", "retour", "haut de page", "aller au contenu", "contactez-nous", "à propos", "partager", "lire la suite", "plus", "aide", "plan du site",
    "inicio", "menú", "iniciar sesión", "cerrar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver", "volver arriba", "ir al contenido", "contacto", "acerca de", "sobre nosotros", "compartir", "leer más", "más", "ayuda", "mapa del sitio",
)
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "we use cookies", "enable javascript", "subscribe to our newsletter", "click here to", "licensed under the", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies", "javascript aktivieren", "newsletter abonnieren", "klicken sie hier",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies", "activer javascript", "abonnez-vous à notre", "cliquez ici",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utilizamos cookies", "habilite javascript", "suscríbase a nuestro", "haga clic aquí",
)
#: Characters from which a line is long; characters and words of an entry of a menu, and how many make one.
LOUD, ENTRY_CHARS, ENTRY_WORDS, ENTRIES = 40, 40, 3, 4


def standing(text: Column) -> Column:
    """Whether a text has a standing phrase."""
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def _entry(line: Column) -> Column:
    """Whether a line could be an entry of a menu: a few words that no mark closes."""

    def few(x: Column) -> Column:
        return (F.length(x) > 0) & (F.length(x) <= ENTRY_CHARS) & ~F.substring(x, -1, 1).isin(*CLOSING) & (F.size(words_of(x)) <= ENTRY_WORDS)

    return F.when(F.length(line) <= 2 * ENTRY_CHARS, let(F.trim(line, F.lit(BLANKS)), few)).otherwise(False)


def _fields(line: Column) -> Column:
    """Whether separators alone or links are a third of a line's words, and at least two."""

    def parted(w: Column) -> Column:
        odd = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS) | F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://")) | F.startswith(x, F.lit("www."))))
        return (odd >= 2) & (3 * odd >= F.size(w))

    return let(words_of(line), parted)


def line_fails(line: Column, marked: Column, phrased: Column, parted: Column, listed: Column) -> Column:
    """Whether a line that has a word is navigation, boilerplate or not punctuated as prose.

    marked, phrased, parted: whether the whole text has a mark or "!", a standing phrase, or a separator or link
    between blanks, at all. listed: whether the line is one of ENTRIES or more entries that follow one another.
    """
    n = F.length(line)
    symbols = (n - F.length(without(line, MARKS))) * 14 > n
    loud = (n > LOUD) & (F.length(without(line, "!")) * 25 < n * 24)
    menu = (n <= LOUD) & F.lower(F.trim(line, F.lit(BLANKS))).isin(*NAVIGATION)
    return listed | menu | (marked & (symbols | loud)) | (parted & _fields(line)) | (phrased & standing(line))


def _listed(entries: Column) -> Column:
    """For each line whether it is in a run of ENTRIES or more entries: by runs that end and begin at it."""
    yes = lambda i: F.coalesce(F.when(i >= 0, F.get(entries, i)), F.lit(False))

    def inside(e: Column, i: Column) -> Column:
        runs = [reduce(and_, [yes(i + (k - back)) for k in range(ENTRIES)]) for back in range(ENTRIES)]
        return e & reduce(or_, runs)

    return F.transform(entries, inside)


def _repeated_words(at: Column) -> Column:
    """Words in windows that occur twice or more, from the array of (hash, place) of the windows, sorted.

    Equal windows are neighbours there; those that have an equal neighbour are sorted by place, and each adds the
    words that the one before it doesn't cover.
    """
    rest = F.greatest(F.size(at) - 1, F.lit(1))
    before, after = F.concat(F.slice(at, 1, 1), F.slice(at, 1, rest)), F.concat(F.slice(at, 2, rest), F.slice(at, -1, 1))
    rows = F.arrays_zip(at.alias("own"), before.alias("before"), after.alias("after"))

    def equal(r: Column, other: str) -> Column:
        return (r["own"]["h"] == r[other]["h"]) & (r["own"]["i"] != r[other]["i"])

    places = F.sort_array(F.transform(F.filter(rows, lambda r: equal(r, "before") | equal(r, "after")), lambda r: r["own"]["i"]))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct((i + WINDOW).alias("to"), (s["n"] + (i + WINDOW - F.greatest(s["to"], i))).alias("n")))["n"]


def _runs(words: Column, length: int) -> Column:
    """Hash of the run of length words that begins at each word; the last ones are shorter."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, length)]))


def _repeats(words: Column) -> Column:
    """As _repeated_words, from the words."""
    whole = F.slice(_runs(words, WINDOW), 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return let(F.sort_array(F.transform(whole, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), _repeated_words)


def measure(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc (a struct of its columns), doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, cleaned and row, a number of the row.

    Null texts count as empty: no words, no lines, base failed. cleaned is the text without its failing lines, as
    it was if none fails; kept is false if the base failed or over half of the characters of words went. Repeated
    rows are measured as often as they occur. The columns of docs may have any names.
    """
    text, lines, blanks = F.col("text"), F.col("lines"), F.lit(BLANKS)
    t = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", text_of().alias("text"))
    apart = rf"(?:^|[\x20\x09-\x0D])(?:[{re.escape(SEPARATORS)}](?:[\x20\x09-\x0D]|$)|https?://|www\.)"
    t = t.withColumns({"words": words_of(text), "lines": F.split(text, "\n", -1), "marked": F.regexp_like(text, F.lit(f"[!{MARKS}]")), "phrased": standing(text), "parted": F.regexp_like(text, F.lit(apart))})
    entries = F.when(F.size("lines") >= ENTRIES, F.transform(lines, _entry)).otherwise(F.array().cast("array<boolean>"))
    listed = let(entries, lambda e: F.when(F.exists(e, lambda x: x), _listed(e)))
    rows = let(listed, lambda m: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(m, i), F.lit(False)).alias("listed"))))
    good = F.transform(F.filter(rows, lambda r: ~line_fails(r["line"], F.col("marked"), F.col("phrased"), F.col("parted"), r["listed"])), lambda r: r["line"])
    t = t.withColumns({"runs": _runs(F.col("words"), WINDOW // 2), "full": F.filter(lines, lambda x: F.trim(x, blanks) != ""), "good": good})
    # Texts in which no run of four words is repeated are done without any sorting.
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    t = t.select(
        "doc",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
        F.when(F.col("marked"), F.length(text) - F.length(without(text, SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(again & (F.size("words") >= WINDOW), _repeats(F.col("words"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.when(F.size("good") < F.size(lines), F.array_join("good", "\n")).alias("rest"),
        text.alias("whole"),
        F.monotonically_increasing_id().alias("row"),
    )
    t = t.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    left = F.when(F.col("rest").isNotNull(), F.length(without(F.col("rest"), BLANKS))).otherwise(F.col("word_chars"))
    t = t.withColumns({"kept": ~F.col("base_failed") & (2 * left >= F.col("word_chars")), "cleaned": F.coalesce("rest", "whole")})
    return t.drop("rest", "whole")


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, their columns only, with failing lines removed from text and n_chars, if there, to match."""
    # Without a number in the condition the optimizer copies each measure that it uses into the filter, many times over.
    kept = measure(docs).filter(F.col("kept") & (F.col("row") >= 0))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned")}
    return kept.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("doc")[f.name]).alias(f.name) for f in docs.schema])
