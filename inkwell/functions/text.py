"""Text functions on columns: normalising, language, tokens, bigrams, chunks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .words import STOP_CODE, STOP_EN, STOP_KO, stop_words

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: What normalising keeps: Hangul syllables, ASCII letters and digits, white space, some punctuation, circled numbers.
DROPPED = r"(?U)[^가-힣A-Za-z0-9\s.,!?;:()\-①-⑩]"
#: The same of Latin-1 texts, with what becomes one space there. Characters are named one by one: regular expressions look those up in one table, but ask for each range in turn.
_LATIN_DROPPED = "".join(f"\\x{i:02x}" for i in range(256) if not (chr(i).isascii() and chr(i).isalnum() or chr(i) in ".,!?;:()-\t\n\x0b\f\r \x85\xa0"))
GAPS = rf"[{_LATIN_DROPPED} \t]{{2,}}|[{_LATIN_DROPPED}\t]"
BEYOND_LATIN, FULL_WIDTH, LATIN_SPACES = r"[^\x00-\xff]", "[！-～　]", " \t\n\x0b\f\r\x85\xa0"
#: Texts in which composing (NFC) can change what normalising keeps: marks, Hangul jamo, and two signs that compose to ASCII.
COMPOSES = r"[\p{M}ᄀ-ᇿK;]"
#: White space of Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HANGUL, LATIN = "[가-힣]", "[A-Za-z]"
_UNIT = "[%개건명억만원kg℃]"
NUMBER_UNIT = f"[0-9]+(?:\\.[0-9]+)?{_UNIT}+"


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(c, F.lit(WHITE))


def pinned(c: Column) -> Column:
    """c, computed where it stands: the optimiser neither pushes a filter on it below its inputs nor copies it into what uses it. The value never changes."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(c: Column, f) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def narrow(c: Column) -> Column:
    """Full-width characters as their ASCII forms."""
    return F.translate(c, WIDE, NARROW)


def normalize(c: Column) -> Column:
    """Normalised text, but for composing; see normalized(). Latin-1 texts take one pass."""
    kept = F.regexp_replace(F.when(c.rlike(FULL_WIDTH), narrow(c)).otherwise(c), DROPPED, " ")
    return F.when(~c.rlike(BEYOND_LATIN), F.btrim(F.regexp_replace(c, GAPS, " "), F.lit(LATIN_SPACES))).otherwise(strip(F.regexp_replace(kept, "[ \\t]{2,}|\\t", " ")))


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalized(df: DataFrame, text: str = "text", to: str = "normal") -> DataFrame:
    """df with the normalised text. Texts that composing can change go through Python; of the others a null goes, so that the input is read once."""
    rare = _composed(F.when(F.col(text).rlike(BEYOND_LATIN) & F.col(text).rlike(COMPOSES), F.col(text)))
    return df.withColumn(to, normalize(F.coalesce(rare, F.col(text))))


def detect_language(c: Column) -> Column:
    """ko, en or mixed by the share of Hangul among Hangul and ASCII letters; ko if there are none. Letters are counted only where both kinds stand."""
    ko, en = (F.length(c) - F.length(F.regexp_replace(c, f"{kind}+", "")) for kind in (HANGUL, LATIN))
    mixed = let(ko / (ko + en), lambda share: F.when(share >= 0.7, "ko").when(share <= 0.3, "en").otherwise("mixed"))
    return F.when(~c.rlike(LATIN), "ko").when(~c.rlike(HANGUL), "en").otherwise(mixed)


def _without(c: Column, words: frozenset[str]) -> Column:
    # A list this long becomes a hash set in the plan; an array would be searched from its start for each token.
    return F.filter(c, lambda x: ~x.isin(*sorted(words)))


def tokens(c: Column, language: Column | str = "ko", min_length: int = 2) -> Column:
    """Hangul runs, then lower-cased English runs, then numbers with units. Hangul stop words go in ko and mixed texts; English ones and code words always."""
    language = F.lit(language) if isinstance(language, str) else language
    long_enough = lambda x: F.filter(x, lambda t: F.length(t) >= min_length) if min_length > 2 else x
    ko = long_enough(F.regexp_extract_all(c, F.lit(f"{HANGUL}{{2,}}"), F.lit(0)))
    ko = F.when(language.isin("ko", "mixed"), _without(ko, STOP_KO)).otherwise(ko)
    en = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    plain = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))
    with_unit = F.when(c.rlike(f"[0-9]{_UNIT}"), F.regexp_extract_all(c, F.lit(NUMBER_UNIT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # ASCII texts hold no Hangul, and are lower-cased whole.
    return F.when(F.octet_length(c) == F.length(c), F.concat(_without(long_enough(plain), STOP_EN | STOP_CODE), with_unit)).otherwise(F.concat(ko, _without(long_enough(en), STOP_EN | STOP_CODE), with_unit))


def filter_stop_words(c: Column, language: str = "all") -> Column:
    """Tokens longer than one character that are no stop words in lower case."""
    return F.filter(c, lambda x: ~F.lower(x).isin(*sorted(stop_words(language))) & (F.length(x) > 1))


def bigrams(c: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    pairs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(F.size(c) > 1, pairs).otherwise(F.array().cast("array<string>"))


def ngrams(c: Column) -> Column:
    """All tokens, then all bigrams."""
    return F.concat(c, bigrams(c))


def frequencies(c: Column) -> Column:
    """Map of token to count, of one array."""
    distinct = F.array_distinct(c)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size(F.filter(c, lambda x: x == t)).cast("long")))


def chunks(c: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Overlapping pieces; a text of at most size characters is one."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.transform(starts, lambda s: F.substring(c, s + 1, size)))


def particle(word: Column) -> Column:
    """은 after a final consonant, or where there is no Hangul; else 는."""
    code = F.ascii(F.right(word, F.lit(1))) - 0xAC00
    return F.when((word == "") | (code < 0) | (code % 28 > 0), "은").otherwise("는")


def safe_name(c: Column) -> Column:
    """A file name with _ for each character that file systems refuse."""
    return strip(F.translate(c, '\\/:*?"<>|', "_________"))


def human_size(c: Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024 of it, B to TB."""
    units = ["B", "KB", "MB", "GB"]
    out = F.format_string("%.1f TB", c / 1024**4)
    for i, unit in reversed(list(enumerate(units))):
        out = F.when(c / 1024**i < 1024, F.format_string(f"%.1f {unit}", F.floor(c / 1024**i * 10 + 0.5) / 10)).otherwise(out)
    return out


def content_hash(c: Column) -> Column:
    """SHA-256 of bytes or text, to find files uploaded twice."""
    return F.sha2(c, 256)


def relative_path(c: Column, base: str) -> Column:
    """The path below base; paths elsewhere as they are."""
    base = base.rstrip("/") + "/"
    return F.when(c.startswith(base), F.substring(c, len(base) + 1, 1 << 30)).otherwise(c)
