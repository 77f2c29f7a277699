"""Cloze and true/false questions from sentences and keywords, and grading.

Assignment is greedy (a keyword takes a sentence, which is then used up), so it
is a fold over the keywords of one document, with aggregate(): no Python, one
row a document. Order is fixed by hashes of a seed where chance would choose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import let, pinned, strip

BLANK = "[____]"
LEAST_BLANK, LEAST_OX, MOST_OX, MOST_BLANK, SIDE, CONTEXT, COUNT = 15, 20, 120, 100, 35, 200, 10
# Strings that mark a sentence as unfit.
ANSWER_KEYS = ("정답:", "해설:", "풀이:", "답:", "출제:")
ANSWER_KEYS_SPACED = ("정답 :", "해설 :", "답 :")
CODE_BLANK = ("@startuml", "@enduml", "class ", "def ", "void ", "import ", "```", "startuml", "enduml", "{", "}", "public ", "private ")
CODE_OX = ("@startuml", "@enduml", "```", "startuml", "public ", "private ")
OPENERS = ("당신이", "여러분이", "다음과 같은 대학", "당신은", "다음을 보고")
# Openings that leave open what a sentence is about.
PROPERTIES = (
    "효과는", "정의는", "중요성은", "보안성은", "독립성은", "명확성은", "원칙은", "목적은", "비유는", "특징은", "이점은", "핵심은", "항목은", "내용은", "구현은", "장점은", "예시는",
    "종류는", "역할은", "유형은", "방법은", "방식은", "형태는", "구조는", "개념은", "의미는", "목표는", "단계는", "절차는", "조건은", "결과는", "요소는",
)
# Answers that mean true or false.
TRUE, FALSE = ("O", "맞다", "맞음", "TRUE", "참", "정"), ("X", "틀리다", "틀림", "FALSE", "거짓", "오")


def _any(s: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | s.contains(m)
    return out


def _opens(s: Column) -> Column:
    return _any(F.substring(s, 1, 20), OPENERS) | s.rlike("^(?:" + "|".join(OPENERS) + ")")


def can_be_blank(s: Column) -> Column:
    """Whether a sentence can carry a cloze for some keyword."""
    ends = F.rtrim(s)
    return (
        (F.length(s) >= LEAST_BLANK) & ~_any(s, ANSWER_KEYS) & ~_any(s, CODE_BLANK) & (F.size(F.split(s, " - ")) < 4)
        & ~ends.rlike("(?U)\\s+\\d+\\.?\\s*\\z") & ~ends.rlike("(?U)\\d+[-\\.]\\d+\\.?\\s*\\z") & ~_opens(s)
    )


def fits_keyword(s: Column, keyword: Column) -> Column:
    return s.contains(keyword) & (F.length(keyword) * 2 <= F.length(s))


def fits_blank(s: Column, keyword: Column) -> Column:
    """Whether a sentence can carry a cloze for the keyword."""
    return fits_keyword(s, keyword) & can_be_blank(s)


def _after_space(s: Column, start: Column, key: Column) -> Column:
    """start, moved behind the next space if that stands well before key; all from 0."""
    space = _find(s, " ", start)
    return F.when((start > 0) & (space >= 0) & (space < key - 2), space + 1).otherwise(start)


def _find(s: Column, what: str, start: Column) -> Column:
    """Place of what from start on, from 0; -1 if there is none."""
    tail = F.instr(F.substring(s, start + 1, 1 << 30), what)
    return F.when(tail > 0, tail - 1 + start).otherwise(-1)


def _clip(s: Column, keyword: Column, side: int) -> Column:
    def cut(x: Column) -> Column:
        end = F.least(F.length(s), x["at"] + F.length(keyword) + side)
        text = strip(F.substring(s, x["start"] + 1, end - x["start"]))
        return F.concat(F.when(x["start"] > 0, "…").otherwise(""), text, F.when(end < F.length(s), "…").otherwise(""))

    return let(F.instr(s, keyword) - 1, lambda at: let(F.struct(at.alias("at"), _after_space(s, F.greatest(at - side, F.lit(0)), at).alias("start")), cut))


def trim_blank(s: Column, keyword: Column) -> Column:
    """A long sentence cut around the keyword, at word starts, and again if it is still too long."""

    def again(once: Column) -> Column:
        lost = F.concat(F.substring(once, 1, MOST_BLANK), F.lit("…"))
        return F.when(F.length(once) <= MOST_BLANK, once).when(F.instr(once, keyword) == 0, lost).otherwise(_clip(once, keyword, MOST_BLANK // 2))

    return F.when((F.length(s) <= MOST_BLANK) | (F.instr(s, keyword) == 0), s).otherwise(let(_clip(s, keyword, SIDE), again))


def mask(s: Column, keyword: Column) -> Column:
    """The first occurrence of the keyword as a blank."""
    at = F.instr(s, keyword)
    return F.when(at == 0, s).otherwise(F.concat(F.substring(s, 1, at - 1), F.lit(BLANK), F.substring(s, at + F.length(keyword), 1 << 30)))


def fits_question(q: Column) -> Column:
    """A question with a blank and enough around it."""
    return q.contains(BLANK) & (F.length(strip(F.replace(F.replace(q, F.lit(BLANK), F.lit("")), F.lit("…"), F.lit("")))) >= 12)


def fits_ox(sentence: Column) -> Column:
    """Whether a sentence can be asked as true or false."""
    s = F.regexp_replace(strip(sentence), "^[·\\-•①②③④⑤⑥⑦⑧⑨⑩() \\t]+", "")
    end = F.regexp_replace(s, "(?U)\\s+\\z", "")
    return (
        (F.length(s) >= LEAST_OX) & ~end.rlike("[?？]\\z") & ~s.rlike("^(?:" + "|".join(PROPERTIES) + ")") & ~end.rlike("[\\d\\-]{1,5}[\\.\\)]?\\s*\\z")
        & (F.regexp_count(s, F.lit("[가-힣]")) >= 6) & (F.regexp_count(s, F.lit("(?U)[^가-힣A-Za-z0-9\\s①②③④⑤⑥⑦⑧⑨⑩]")) / F.length(s) <= 0.35)
        & (F.size(F.split(strip(s), "(?U)\\s+")) >= 3) & ~_any(s, ANSWER_KEYS + ANSWER_KEYS_SPACED) & ~_opens(s)
        & ~s.rlike("(?U)(하시오|쓰시오|설명하시오|구하시오|답하시오|나열하시오|서술하시오)[.。]?\\s*\\z") & ~_any(s, CODE_OX)
        & ~s.rlike("(?U)[A-Z][a-z]+[A-Z]\\w*:") & ~s.rlike("(?U)\\w+\\s*:\\s+\\w+,\\s*\\w+") & ~s.rlike("(?U)^\\s*\\d") & ~s.rlike("[가-힣]{12,}")
    )


def trim_ox(s: Column) -> Column:
    """At most 120 characters, cut at a space in the second half, and an ellipsis."""
    cut = F.substring(s, 1, MOST_OX)
    back = F.instr(F.reverse(cut), " ")
    last = F.when(back > 0, F.length(cut) - back).otherwise(-1)
    cut = F.when(last > MOST_OX // 2, F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(s) <= MOST_OX, s).otherwise(F.concat(F.regexp_replace(cut, "[.,;:\\-(]+\\z", ""), F.lit("…")))


def bad_replacement(sentence: Column, original: Column, new: Column) -> Column:
    """Whether new cannot stand for original in a false sentence."""
    return (
        sentence.contains(new) | new.contains(original) | original.contains(new)
        | ((F.length(original) <= 2) & (F.abs(F.length(original) - F.length(new)) <= 1)) | new.rlike("^[a-zA-Z0-9_.]+\\z") | new.rlike("^[가-힣]{8,}\\z")
    )


def swapped(s: Column, keyword: Column, new: Column) -> Column:
    """The first keyword replaced, with the particle 은/는 or 이/가 after it made to fit."""
    at = F.instr(s, keyword)
    behind = F.substring(s, at + F.length(keyword), 1)
    code = F.ascii(F.right(new, F.lit(1))) - 0xAC00
    closed = (code >= 0) & (code % 28 > 0)
    fitted = F.when(behind.isin("은", "는"), F.when(closed, "은").otherwise("는")).when(behind.isin("이", "가"), F.when(closed, "이").otherwise("가"))
    rest = F.substring(s, at + F.length(keyword) + F.when(fitted.isNotNull(), 1).otherwise(0), 1 << 30)
    return F.when(at == 0, s).otherwise(F.concat(F.substring(s, 1, at - 1), new, F.coalesce(fitted, F.lit("")), rest))


def _assigned(docs: DataFrame, doc: str, candidates: Column, count: int, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(doc, k, i, n) of the keywords that got a sentence, with its place i and their turn n.

    candidates: for each keyword in order (k, able array<int>), its sentences' places, best first. A keyword takes
    the first that is not used; it goes without if judge(k, i, turn) says no. Only sentences taken are judged.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<k:string,i:int,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        first = F.get(F.filter(x["able"], lambda i: ~F.array_contains(s["used"], i)), F.lit(0))
        turn = F.size(s["out"])

        def take(i: Column) -> Column:
            good = (turn < count) & i.isNotNull() & F.coalesce(judge(x["k"], i, turn), F.lit(False))
            out = F.struct(x["k"].alias("k"), i.alias("i"), turn.alias("n"))
            return F.when(good, F.struct(F.concat(s["used"], F.array(i)).alias("used"), F.concat(s["out"], F.array(out)).alias("out"))).otherwise(s)

        return F.when(turn < count, let(first, take)).otherwise(s)

    with_able = docs.withColumn("_able", pinned(candidates))
    taken = with_able.withColumn("_taken", pinned(F.aggregate("_able", start, step, lambda s: s["out"])))
    return taken.drop("_able").withColumn("_q", F.explode("_taken")).drop("_taken").select("*", "_q.k", "_q.i", "_q.n").drop("_q")


def blank_quizzes(docs: DataFrame, doc: str = "doc_id", sentences: str = "sentences", keywords: str = "keywords", count: int = COUNT, seed: int = 0) -> DataFrame:
    """(doc, quiz_type, keyword, question, answer, context, place): keywords in order, each with its first fitting sentence not yet used, shorter than 150 if it can."""

    # Sentences are judged once; keywords then look through those that are left.
    rated = F.transform(sentences, lambda s, i: F.when(can_be_blank(s), F.struct((F.length(s) > 150).alias("long"), i.alias("i"), s.alias("s"))))
    rated = docs.select(doc, sentences, keywords).withColumn("_open", pinned(F.array_sort(F.filter(rated, lambda x: x.isNotNull()))))

    def able(k: Column) -> Column:
        return F.struct(k.alias("k"), F.transform(F.filter("_open", lambda x: fits_keyword(x["s"], k)), lambda x: x["i"]).alias("able"))

    judge = lambda k, i, turn: let(F.get(sentences, i), lambda s: fits_question(mask(trim_blank(s, k), k)))
    made = _assigned(rated, doc, F.transform(F.filter(keywords, lambda k: F.length(k) >= 2), able), count, judge).drop("_open")
    said = made.withColumn("s", F.element_at(sentences, F.col("i") + 1))
    question = mask(trim_blank(F.col("s"), F.col("k")), F.col("k"))
    out = said.select(doc, F.lit("blank").alias("quiz_type"), F.col("k").alias("keyword"), question.alias("question"), F.col("k").alias("answer"), F.substring("s", 1, CONTEXT).alias("context"))
    return _shuffled(out, doc, seed)


def ox_quizzes(docs: DataFrame, doc: str = "doc_id", sentences: str = "sentences", keywords: str = "keywords", count: int = COUNT, seed: int = 0) -> DataFrame:
    """(doc, quiz_type, keyword, question, answer, context, place): true and false in turn; false ones swap in the Hangul keyword of most different length, or negate the keyword. Sentences cut off before their keyword make no false question."""
    order = F.transform(F.array_sort(F.transform(keywords, lambda k: F.struct(F.xxhash64(F.lit(seed), F.col(doc), k).alias("h"), k.alias("k")))), lambda x: x["k"])
    rated = docs.select(doc, sentences, keywords).withColumn("_fit", pinned(F.transform(sentences, fits_ox)))

    def able(k: Column) -> Column:
        some = F.transform(sentences, lambda s, i: F.when(F.get("_fit", i) & s.contains(k), F.struct(F.length(s).alias("n"), i.alias("i"))))
        best = F.array_sort(F.filter(some, lambda x: x.isNotNull()))
        return F.struct(k.alias("k"), F.transform(best, lambda x: x["i"]).alias("able"))

    judge = lambda k, i, turn: (turn % 2 == 0) | trim_ox(F.get(sentences, i)).contains(k)
    made = _assigned(rated, doc, F.transform(F.filter(order, lambda k: F.length(k) >= 2), able), count, judge)
    cut = made.withColumn("s", F.element_at(sentences, F.col("i") + 1)).withColumn("cut", trim_ox(F.col("s")))
    k = F.col("k")
    pool = F.filter(keywords, lambda r: r.rlike("[가-힣]") & (F.length(r) >= 2) & (r != k) & ~bad_replacement(F.col("cut"), k, r))
    # Of the words that can stand in, the one of most different length; of equal ones the first.
    best = F.array_sort(F.transform(pool, lambda r: F.struct((-F.abs(F.length(r) - F.length(k))).alias("d"), F.array_position(keywords, r).alias("i"), r.alias("r"))))
    cut = cut.withColumn("new", F.when(F.col("n") % 2 == 1, F.coalesce(F.get(best, F.lit(0))["r"], F.concat(F.lit("비(非)"), k))))
    question = F.when(F.col("new").isNotNull(), swapped(F.col("cut"), k, F.col("new"))).otherwise(F.col("cut"))
    out = cut.select(doc, F.lit("ox").alias("quiz_type"), k.alias("keyword"), question.alias("question"), F.when(F.col("new").isNotNull(), "X").otherwise("O").alias("answer"), F.substring("s", 1, CONTEXT).alias("context"))
    return _shuffled(out, doc, seed)


def _shuffled(made: DataFrame, doc: str, seed: int) -> DataFrame:
    order = W.partitionBy(doc).orderBy(F.xxhash64(F.lit(seed), "question"), "question")
    return made.withColumn("place", F.row_number().over(order))


def generate(docs: DataFrame, kind: str = "all", doc: str = "doc_id", sentences: str = "sentences", keywords: str = "keywords", blank: int = COUNT, ox: int = COUNT, seed: int = 0) -> DataFrame:
    """Questions of one kind (blank, ox) or all."""
    made = {"blank": lambda: blank_quizzes(docs, doc, sentences, keywords, blank, seed), "ox": lambda: ox_quizzes(docs, doc, sentences, keywords, ox, seed)}
    if kind in made:
        return made[kind]()
    return made["blank"]().union(made["ox"]())


def session_order(quizzes: DataFrame, seed: int = 0, kind: str | None = None, doc: str = "doc_id") -> DataFrame:
    """A session's questions: of one kind, if named, in shuffled order."""
    some = quizzes.filter(F.col("quiz_type") == kind) if kind else quizzes
    return _shuffled(some.drop("place"), doc, seed)


def normalize_ox(c: Column) -> Column:
    t = F.upper(strip(c))
    return F.when(t.isin(*TRUE), "O").when(t.isin(*FALSE), "X").otherwise(t)


def is_correct(quiz_type: Column, answer: Column, given: Column) -> Column:
    """Cloze answers match without case and spaces; true/false ones by meaning."""
    plain = lambda c: F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))
    return F.when(quiz_type == "blank", plain(answer) == plain(given)).otherwise(normalize_ox(answer) == normalize_ox(given))


def grade_session(answers: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, total, correct, wrong_count, accuracy, wrong_keywords) of graded answers (session, keyword, is_correct)."""
    wrong = F.array_sort(F.collect_set(F.when(~F.col("is_correct") & (F.col("keyword") != ""), F.col("keyword"))))
    out = answers.groupBy(session).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), wrong.alias("wrong_keywords"))
    return out.withColumn("wrong_count", F.col("total") - F.col("correct")).withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 6))


def feedback(is_right: Column, answer: Column) -> Column:
    return F.concat(F.when(is_right, "✓ 정답: ").otherwise("✗ 오답 — 정답: "), answer)
