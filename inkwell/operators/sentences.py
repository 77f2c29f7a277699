"""Sentences of normalised texts.

Paragraphs come from line breaks and structure markers; labelled parts and
numbered or long Korean clauses are split further; rows of tables become
sentences; of sentences that agree in their first 60 characters the first stays.

A text is an array of paragraphs, and every step maps arrays: nothing is
exploded or shuffled, and a document stays in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import HANGUL, let, particle, pinned, strip
from ..functions.words import WEAK_SUBJECTS

CIRCLED = "[①②③④⑤⑥⑦⑧⑨⑩]"
# Labels before which a paragraph is split, as patterns.
LABELS = (
    "정\\s*의:", "왜\\s+필요", "실무\\s+예시:", "특\\s*징:", "목적:", "배경:", "개요:", "효과:", "원칙:", "구성\\s+요소:", "종류:", "방법:",
    "단계:", "기\\s*능:", "역할:", "적용:", "의미:", "기\\s*호:", "표\\s*기:", "속\\s*성:", "주\\s*의:", "예\\s*:",
)
# Labels that may follow a dash, and labels that end a title.
DASHED = ("정\\s*의:", "기\\s*호:", "표\\s*기:", "속\\s*성:", "주\\s*의:", "특\\s*징:", "예\\s*:", "실무\\s+예시:", "왜\\s+필요")
TITLED = ("정의:", "왜\\s+필요", "실무\\s+예시:", "특징:", "목적:", "배경:", "개요:", "기호:", "표기:", "속성:", "주의:")
SECTION = "^\\d[\\d\\-\\.]*[\\.\\s]+"
SENTENCE_END = "(?U)(?=\\s)(?<=[^0-9][.!?])\\s+"
NUMBERED = "(?U)(?<=다)\\s+(?=\\d{1,2}[\\.\\)]\\s*[가-힣A-Z])"
CLAUSE = "(?U)(?<=다)\\s+(?=[가-힣A-Z\\(])"
LEAST, KEY = 15, 60


def marked(c: Column) -> Column:
    """Line breaks before circled numbers, (1), 1) and section numbers."""
    # Each pattern is tried where a text holds what it cannot match without.
    c = let(F.when(c.rlike(CIRCLED), F.regexp_replace(c, f"({CIRCLED})", "\n$1")).otherwise(c), _numbered)
    return let(c, lambda x: F.when(x.rlike("(?U)[-.]\\d+\\."), F.regexp_replace(x, "(?U)\\s+(\\d+[-\\.]\\d+\\.\\s+[가-힣A-Z])", "\n$1")).otherwise(x))


def _numbered(c: Column) -> Column:
    return F.when(c.rlike("(?U)\\d\\)"), F.regexp_replace(F.regexp_replace(c, "(?U)(\\(\\d{1,2}\\)\\s)", "\n$1"), "(?U)(?<!\\w)(\\d{1,2}\\)\\s)", "\n$1")).otherwise(c)


def _pieces(c: Column, pattern: str) -> Column:
    """Stripped parts of c, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern, -1), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return _pieces(marked(c), "\n")


def is_heading(p: Column) -> Column:
    """A short numbered line with Hangul and no colon."""
    return (F.length(p) <= 80) & ~p.contains(":") & p.rlike("(?U)" + SECTION) & p.rlike("[가-힣]{2}")


def section_name(p: Column) -> Column:
    """A heading without its number, 30 characters at most."""
    return F.substring(strip(F.regexp_replace(p, "(?U)" + SECTION, "")), 1, 30)


def labelled(p: Column) -> Column:
    """Parts of a paragraph by label, each after the paragraph's title; the paragraph alone if it has no label."""
    flat = F.regexp_replace(p, f"(?U)\\s*-\\s*({'|'.join(DASHED)})", " $1")
    parts = F.split(flat, f"(?U)\\s+(?={'|'.join(LABELS)})", -1)
    first = strip(F.get(parts, F.lit(0)))
    title = f"(?U)^(.+?)\\s+(?:-\\s*)?(?:{'|'.join(TITLED)})"
    has_title = first.rlike(title)
    name = F.when(has_title, strip(F.regexp_extract(first, title, 1))).otherwise(first)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: strip(F.regexp_replace(strip(x), "(?U)^-\\s*", "")))
    rest = F.transform(F.filter(rest, lambda x: F.length(x) >= 10), lambda x: F.concat_ws(" ", name, x))
    split_up = F.filter(F.concat(F.when(has_title, F.array(first)).otherwise(F.array().cast("array<string>")), rest), lambda x: F.length(x) >= LEAST)
    # Most paragraphs have no label; only the others are taken apart. Every label holds Hangul.
    return F.when(~p.rlike(HANGUL), F.array(p)).when(~flat.rlike(f"(?U)\\s(?:{'|'.join(LABELS)})"), F.array(p)).otherwise(F.when(F.size(parts) <= 1, F.array(p)).otherwise(split_up))


def _sentences_of(part: Column) -> Column:
    """Sentences of one labelled part."""
    clauses = F.flatten(F.transform(_pieces(part, NUMBERED), lambda x: F.when(F.length(x) > 60, _pieces(x, CLAUSE)).otherwise(F.array(x))))
    clauses = F.when(part.contains("다"), clauses).otherwise(F.array(part))
    return F.filter(F.flatten(F.transform(clauses, lambda x: _pieces(x, SENTENCE_END))), lambda x: F.length(x) >= LEAST)


def table_sentence(p: Column) -> Column:
    """A table row as a sentence, or null: a concept and its definition, or a number, an English name and its definition."""
    row = F.split(F.regexp_replace(p, "(?U)\\s+", " "), " ")
    subject, n = F.get(row, F.lit(0)), F.size(row)
    after = lambda k: F.array_join(F.slice(row, k + 1, F.greatest(n - k, F.lit(0))), " ")
    fits = lambda rest, s: F.when((F.length(rest) >= 8) & rest.rlike("[가-힣]{3}") & F.length(s).between(20, 150), s)
    name = F.get(row, F.lit(1))
    one = fits(after(1), F.concat(subject, particle(subject), F.lit(" "), after(1), F.lit(".")))
    two = fits(after(2), F.concat(name, F.lit("은(는) "), after(2), F.lit(".")))
    concept = subject.rlike("^[가-힣]{2,6}$") & ~subject.isin(*WEAK_SUBJECTS)
    return F.when(p.rlike("(?U)^(?:[가-힣]{2,6}|[0-9]+)\\s") & (n >= 3), F.when(concept, one).when(subject.rlike("^[0-9]+$") & (n >= 4) & name.rlike("^[A-Za-z]{3,20}$"), two))


def split_sentences(df: DataFrame, text: str = "normal", to: str = "sentences") -> DataFrame:
    """df with the sentences of a normalised text. Circled items get the name of the section they stand in."""
    df = df.withColumn("_m", marked(F.col(text))).withColumn("_p", _pieces(F.col("_m"), "\n")).drop("_m")
    # Forward fill: the number of headings up to a paragraph picks its section's name.
    df = df.withColumn("_h", F.transform("_p", lambda p: F.when(is_heading(p), section_name(p))))
    df = df.withColumn("_names", F.filter("_h", lambda h: h.isNotNull()))
    count = F.aggregate("_h", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda s, h: F.struct((s["n"] + F.when(h.isNotNull(), 1).otherwise(0)).cast("int").alias("n"), F.concat(s["at"], F.array((s["n"] + F.when(h.isNotNull(), 1).otherwise(0)).cast("int"))).alias("at")), lambda s: s["at"])
    df = df.withColumn("_at", F.when(F.size("_names") > 0, count))
    df = df.withColumn("_parts", F.transform("_p", labelled))

    def named(parts: Column, i: Column) -> Column:
        name = F.when(F.get("_at", i) > 0, F.get("_names", F.get("_at", i) - 1))
        return F.transform(F.filter(F.transform(parts, strip), lambda x: x != ""), lambda x: F.when(x.rlike("^" + CIRCLED) & name.isNotNull() & (name != ""), F.concat_ws(" ", name, x)).otherwise(x))

    df = df.withColumn("_parts", F.flatten(F.transform("_parts", named)))
    df = df.withColumn("_body", F.flatten(F.transform("_parts", _sentences_of)))
    df = df.withColumn("_rows", F.filter(F.transform("_p", table_sentence), lambda x: x.isNotNull()))
    df = df.withColumn("_all", F.concat("_body", "_rows"))
    # Of each key the first place; columns of their own keep lambdas from computing them again.
    df = df.withColumn("_keys", F.transform("_all", lambda x: F.substring(x, 1, KEY)))
    df = df.withColumn("_firsts", F.transform(F.array_distinct("_keys"), lambda k: F.array_position("_keys", k).cast("int")))
    return df.withColumn(to, pinned(F.transform("_firsts", lambda i: F.element_at("_all", i)))).drop("_keys", "_firsts", "_p", "_h", "_names", "_at", "_parts", "_body", "_rows", "_all")


def with_sections(lines: DataFrame, doc: str = "doc_id", idx: str = "idx", line: str = "line") -> DataFrame:
    """lines with section, the name of the last heading up to each, and titled: circled items after that name. For texts that lie line by line; split_sentences() does the same in one row."""
    so_far = W.partitionBy(doc).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    named = lines.withColumn("section", F.last(F.when(is_heading(F.col(line)), section_name(F.col(line))), ignorenulls=True).over(so_far))
    item = F.col(line).rlike("^" + CIRCLED) & (F.coalesce("section", F.lit("")) != "")
    return named.withColumn("titled", F.when(item, F.concat_ws(" ", "section", line)).otherwise(F.col(line)))


def with_keywords(sentences: Column, keywords: Column) -> Column:
    """Whether each sentence holds one of the keywords."""
    return F.transform(sentences, lambda s: F.exists(keywords, lambda k: s.contains(k)))


def or_lines(sentences: Column, text: Column) -> Column:
    """The sentences, or the text's non-empty lines where there are none."""
    return F.when(F.size(sentences) > 0, sentences).otherwise(_pieces(text, "\n"))


# Headings of lecture notes, before which a long sentence is split.
HEADINGS = ("학습목표", "핵심개념요약", "상세학습내용", "핵심포인트", "실무적용", "핵심키워드", "개념\\s", "정의\\s", "번호\\s", "학습\\s목표", "학습개요", "학습내용", "핵심내용", "주요내용")
LONG = 150


def refine(sentences: Column, most: int = LONG) -> Column:
    """Sentences with those longer than most split further: by label, by number or clause, before headings, and before numbered items. Key:value rows stay whole."""
    heading = f"(?U)(?<!\\A)\\s+(?={'|'.join(HEADINGS)})"
    item = "(?U)\\s+(?=\\d{1,2}\\s+[가-힣A-Za-z(])"

    def fragments(x: Column) -> Column:
        numbered = F.split(x, NUMBERED, -1)
        clauses = F.flatten(F.transform(numbered, lambda p: F.when(F.length(p) > 60, F.split(p, CLAUSE, -1)).otherwise(F.array(p))))
        headed = F.flatten(F.transform(clauses, lambda p: F.split(p, heading, -1)))
        items = F.flatten(F.transform(headed, lambda p: F.when(F.length(p) > most, F.split(p, item, -1)).otherwise(F.array(p))))
        return F.filter(F.transform(items, strip), lambda p: F.length(p) >= LEAST)

    def part(x: Column) -> Column:
        return F.when((F.length(x) <= most) | x.rlike("(?U)\\w+:\\S"), F.array(x)).otherwise(fragments(x))

    return F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.flatten(F.transform(labelled(s), part)))))
