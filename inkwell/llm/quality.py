"""Line-first quality rules (native).

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, then documents that lost too much text, or whose text is too
short or repetitive, are rejected. A line fails

- if too many of its characters are symbols, or punctuation of any kind;
- if it is long and no sentence ends in it, in whatever script;
- if it holds words of navigation alone;
- if it is short and holds a phrase of boilerplate. A paragraph that only
  mentions such a phrase stays.

Defined results: a null or empty text has no words and is rejected; repeated
rows are judged one by one; further columns pass through untouched; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, words

#: Phrases of boilerplate lines in English, German, French and Spanish, lower case.
BOILERPLATE = "|".join(
    """cookie policy|privacy policy|terms of use|terms of service|terms and conditions|all rights reserved|enable javascript|lorem ipsum|click here|read more|subscribe to our|sign up for|powered by|accept cookies|uses cookies
alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|hier klicken|klicken sie hier|weiterlesen|newsletter abonnieren|javascript aktivieren|verwendet cookies
tous droits réservés|politique de confidentialité|conditions d.utilisation|mentions légales|cliquez ici|lire la suite|abonnez-vous|activer javascript|utilise des cookies
todos los derechos reservados|política de privacidad|términos de uso|aviso legal|haga clic aquí|haz clic aquí|leer más|suscríbete|activar javascript|utiliza cookies""".splitlines()
)
#: Words that alone make up a navigation line, in the same languages, lower case.
NAVIGATION = "|".join(
    """home|menu|login|log in|logout|sign in|sign up|register|search|next|previous|back|contact|about|sitemap|share|print|top|help|faq|blog|news
startseite|menü|anmelden|abmelden|registrieren|suche|weiter|zurück|kontakt|über uns|impressum|drucken|teilen|hilfe
accueil|connexion|déconnexion|inscription|rechercher|suivant|précédent|retour|à propos|plan du site|partager|imprimer|aide
inicio|menú|acceder|registrarse|buscar|siguiente|anterior|volver|contacto|acerca de|mapa del sitio|compartir|imprimir|ayuda""".splitlines()
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    #: A line fails when symbols exceed this percentage of its characters.
    symbol_percent: int = 15
    #: Nor may punctuation of any kind exceed this one.
    punctuation_percent: int = 40
    #: Lines of so many characters need the end of a sentence.
    long_line: int = 400
    #: Phrases of boilerplate count in lines of at most so many characters.
    short_line: int = 200
    #: A document goes when less than this percentage of its word characters is left.
    least_left_percent: int = 50


RULES = Rules()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "left_chars", "cleaned", "base_failed", "kept")
SYMBOLS = "[#*$%&|<>]"
#: What ends a sentence in Latin, Greek, Cyrillic, Chinese, Japanese, Arabic, Urdu, Syriac, Armenian, Ethiopic, Devanagari, Tibetan, Burmese,
#: Khmer, Mongolian and other scripts; and the letters of Thai and Lao, which end sentences by spaces.
SENTENCE_END = "[.!?…‼⁇⁈⁉。．！？｡؟۔܀܁܂։՜՞።፧፨।॥᱾᱿།༎༏༑။၊។៕᠃᠉᭞᭟꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫ก-๛ກ-ໟ]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NAVIGATION_LINE = rf"^[\x20\x09-\x0D]*(?:(?:{NAVIGATION})[\x20\x09-\x0D]*(?:[|>/]+[\x20\x09-\x0D]*|\z))+\z"


def line_fails(line: Column, rules: Rules = RULES) -> Column:
    """Whether a line with words breaks a rule; lines without words never fail."""
    n = F.length(line)
    without = lambda pattern: F.length(F.regexp_replace(line, pattern, ""))
    symbols = (n - without(SYMBOLS)) * 100 > n * rules.symbol_percent
    punctuation = (n - without(PUNCTUATION)) * 100 > n * rules.punctuation_percent
    endless = (n >= rules.long_line) & ~line.rlike(SENTENCE_END)
    phrases = (n <= rules.short_line) & (F.lower(line).rlike(NAVIGATION_LINE) | F.lower(line).rlike(BOILERPLATE))
    return symbols | punctuation | endless | phrases


def with_lines(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """docs with _lines, _kept_lines and _has_words (lines holding a word)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_lines", F.split(t, "\n")).withColumn(
        "_kept_lines", F.filter("_lines", lambda x: ~line_fails(x, rules))
    )


def measure(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, left_chars, cleaned, base_failed and kept; columns of docs with these names, or of working names that begin with _, give way."""
    k = rules.window
    t = F.coalesce(F.col(text), F.lit(""))
    df = with_lines(docs, text, rules).withColumn("_words", words(F.col(text)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"))
    full = F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    df = df.withColumn("_full", full).withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    hashes = F.when(F.col("n_words") >= k, F.transform(F.sequence(F.lit(1), F.size("_words") - (k - 1)), lambda i: F.xxhash64(F.slice("_words", i, k)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes)
    # Each step is a column of its own, so that no lambda computes it again; only repetitive texts sort.
    df = df.withColumn("_sorted", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn("_twice", F.filter(F.transform("_sorted", lambda x, i: F.when((F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
    df = df.withColumn("_starts", F.array_sort("_twice"))
    # A repeated window adds the words up to the next one's start, k at most.
    steps = F.transform("_starts", lambda s, i: F.least(F.lit(k), F.coalesce(F.get("_starts", i + 1) - s, F.lit(k))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    df = df.withColumn("cleaned", F.array_join("_kept_lines", "\n"))
    df = df.withColumn("left_chars", F.length(F.regexp_replace("cleaned", "[\\x20\\x09-\\x0D]", "")).cast("long"))
    df = df.withColumn("n_lines_removed", (F.size("_lines") - F.size("_kept_lines")).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("left_chars") * 100 >= F.col("word_chars") * rules.least_left_percent))
    # A filter on measures would be pushed below them and have them computed over and over; it does not get past _at. The measures themselves
    # stay outside the condition, or what they have in common would be computed for each.
    keep = [c for c in docs.columns if c not in MEASURES and not c.startswith("_")] + [c for c in docs.columns if c in ("_row", "_text")]
    df = df.select(*[F.col(f"`{c}`") for c in keep], *MEASURES, F.monotonically_increasing_id().alias("_at"))
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.when(F.col("_at") >= 0, F.col(c)).alias(c) for c in MEASURES])


def clean(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """Kept documents with their failing lines removed and the columns of docs; n_chars, where there is one, follows the text."""
    df = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text")), "_text", rules)
    new = [
        F.col("cleaned").alias(c) if c == text
        else F.length("cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("_row")[c].alias(c)
        for c in docs.columns
    ]
    # A filter on kept would be pushed below the measures and have them computed twice; a generated row is not.
    kept = df.select(F.inline_outer(F.when(F.col("kept"), F.array(F.struct(F.lit(True).alias("_kept"), F.struct(*new).alias("_new"))))))
    return kept.filter("_kept").select(*[F.col("_new")[c].alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
