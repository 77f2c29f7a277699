"""Scores, grades and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

QUIZ, COVERAGE, DENSITY, PASS = 0.6, 0.3, 0.1, 60.0
WHOLE = "전체"


def average(c: Column) -> Column:
    """One decimal of an average; the ninth comes first, since a sum of doubles may fall short of a half."""
    return F.round(F.round(c, 9), 1)


def score(correct: Column, total: Column, coverage: Column, density: Column) -> Column:
    """struct of quiz, coverage and density scores in percent, their weighted total, pass and grade."""
    quiz = correct / F.greatest(total, F.lit(1)) * 100
    sum_ = QUIZ * quiz + COVERAGE * coverage * 100 + DENSITY * density * 100
    total_score = F.round(F.greatest(F.least(sum_, F.lit(100.0)), F.lit(0.0)), 2)
    return F.struct(F.round(quiz, 2).alias("quiz_score"), F.round(coverage * 100, 2).alias("coverage_score"), F.round(density * 100, 2).alias("keyword_density"), total_score.alias("total_score"), (total_score >= PASS).alias("passed"), grade(total_score).alias("grade"))


def grade(c: Column) -> Column:
    return F.when(c >= 90, "A").when(c >= 80, "B").when(c >= 70, "C").when(c >= 60, "D").otherwise("F")


def band(c: Column) -> Column:
    """Colour band of a chart."""
    return F.when(c >= 60, "ok").when(c >= 40, "warn").otherwise("danger")


def summary(s: Column) -> Column:
    """One line for a struct made by score()."""
    return F.format_string("퀴즈 %.1f점  커버리지 %.1f점  밀도 %.1f점  → 최종 %.1f점 (%s)", s["quiz_score"], s["coverage_score"], s["keyword_density"], s["total_score"], s["grade"])


def subject_stats(documents: DataFrame, quizzes: DataFrame, scores: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(subject, document_count, quiz_count, avg_score): each aggregated by itself, so that joins do not multiply rows."""
    docs = documents.select("doc_id", "subject")
    a = docs.groupBy("subject").agg(F.count(F.lit(1)).alias("document_count"))
    b = quizzes.join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("quiz_count"))
    c = scores.join(docs, "doc_id").groupBy("subject").agg(average(F.avg("total_score")).alias("avg_score"))
    base = subjects if subjects is not None else a.select("subject")
    out = base.join(a, "subject", "left").join(b, "subject", "left").join(c, "subject", "left")
    zero = F.lit(0).cast("long")
    return out.select("subject", F.coalesce("document_count", zero).alias("document_count"), F.coalesce("quiz_count", zero).alias("quiz_count"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"))


def latest(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The newest score of each document; of two at one time, the one with the larger id."""
    newest = W.partitionBy(doc).orderBy(F.desc("measured_at"), F.desc("id"))
    return scores.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def history(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, place, label, total_score, passed, band) in order of time."""
    order = W.partitionBy(doc).orderBy("measured_at", "id")
    return scores.select(doc, F.row_number().over(order).alias("place"), F.coalesce(F.date_format("measured_at", "MM/dd HH:mm"), F.lit("-")).alias("label"), "total_score", (F.col("total_score") >= PASS).alias("passed"), band(F.col("total_score")).alias("band"))


def document_report(documents: DataFrame, scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, title, session_count, best_score, avg_score, latest scores, grade, passed); zeros for documents without scores."""
    sums = scores.groupBy(doc).agg(F.count(F.lit(1)).alias("session_count"), F.max("total_score").alias("best_score"), average(F.avg("total_score")).alias("avg_score"))
    new = latest(scores, doc).select(doc, "quiz_score", "coverage_score", "keyword_density", "total_score", "missing_concepts")
    out = documents.select(doc, "title").join(sums, doc, "left").join(new, doc, "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_score", "avg_score", "quiz_score", "coverage_score", "keyword_density", "total_score")]
    out = out.select(doc, F.coalesce("title", F.lit("알 수 없음")).alias("title"), F.coalesce("session_count", F.lit(0).cast("long")).alias("session_count"), *zero, "missing_concepts")
    return out.withColumn("passed", (F.col("total_score") >= PASS) & (F.col("session_count") > 0)).withColumn("grade", F.when(F.col("session_count") > 0, grade(F.col("total_score"))).otherwise("F"))


def keyword_coverage(report: DataFrame, keywords: DataFrame, doc: str = "doc_id") -> DataFrame:
    """report with covered, missing and partial keyword counts, and coverage and density filled in from them where a document with history has 0."""
    active = keywords.filter(~F.col("is_user_removed")).select(doc, "word")
    missing = report.select(doc, F.array_distinct(F.coalesce("missing_concepts", F.array().cast("array<string>"))).alias("_m"))
    counts = active.join(missing, doc).groupBy(doc).agg(F.count(F.lit(1)).alias("_total"), F.count_if(~F.array_contains("_m", F.col("word"))).alias("covered_count"), F.max(F.size("_m")).cast("long").alias("missing_count"))
    out = report.join(counts, doc, "left").withColumn("partial_count", F.greatest(F.col("_total") - F.col("covered_count") - F.col("missing_count"), F.lit(0)))
    fill = (F.col("session_count") > 0) & (F.col("_total") > 0)
    out = out.withColumn("coverage_score", F.when(fill & (F.col("coverage_score") == 0), F.round(F.col("covered_count") / F.col("_total") * 100, 2)).otherwise(F.col("coverage_score")))
    share = (F.col("covered_count") + 0.5 * F.col("partial_count")) / F.col("_total") * 100
    return out.withColumn("keyword_density", F.when(fill & (F.col("keyword_density") == 0), F.round(F.least(share, F.lit(100.0)), 2)).otherwise(F.col("keyword_density"))).drop("_total")


def chapter_averages(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, chapter, label, avg_score) of documents with two chapters or more."""
    avg = scores.groupBy(doc, F.coalesce("chapter", F.lit(WHOLE)).alias("chapter")).agg(F.round(F.round(F.avg("total_score"), 6), 1).alias("avg_score"))
    several = avg.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(doc))).filter("_n > 1")
    return several.select(doc, "chapter", F.substring("chapter", 1, 12).alias("label"), "avg_score")


def subject_report(report: DataFrame) -> DataFrame:
    """Reports of documents with history."""
    return report.filter("session_count > 0")


def donut(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, part, n, pct) of the parts that are not 0; pct is covered over all."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"{k}_count").alias("n")) for k in ("covered", "partial", "missing")])
    total = F.col("covered_count") + F.col("partial_count") + F.col("missing_count")
    out = counts.select(doc, F.when(total > 0, F.round(F.col("covered_count") / total * 100, 1)).otherwise(0.0).alias("pct"), F.explode(parts).alias("p"))
    return out.select(doc, "p.part", "p.n", "pct").filter("n > 0")


def breakdown(report: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, part, score, band) for the bars of one report."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col(c).alias("score")) for k, c in (("quiz", "quiz_score"), ("coverage", "coverage_score"), ("density", "keyword_density"), ("total", "total_score"))])
    return report.select(doc, F.explode(parts).alias("p")).select(doc, "p.part", "p.score", band(F.col("p.score")).alias("band"))


def session_listing(sessions: DataFrame, documents: DataFrame, doc: str = "document_id") -> DataFrame:
    """(date, title, total_questions, correct_count, score) of sessions, newest first."""
    titled = sessions.join(documents.select(F.col("id").alias(doc), "title"), doc)
    date = F.coalesce(F.date_format("completed_at", "MM-dd HH:mm"), F.lit("-"))
    return titled.orderBy(F.desc("started_at"), F.desc("id")).select(date.alias("date"), "title", "total_questions", "correct_count", F.format_string("%.1f점", "score").alias("score"))


def score_listing(scores: DataFrame, documents: DataFrame, doc: str = "document_id") -> DataFrame:
    """(date, title, score, passed, missing_count) of the score history, newest first."""
    titled = scores.join(documents.select(F.col("id").alias(doc), "title"), doc)
    date = F.coalesce(F.date_format("measured_at", "yyyy-MM-dd HH:mm"), F.lit("-"))
    missing = F.when(F.col("missing_concepts").isNull(), 0).otherwise(F.size("missing_concepts"))
    return titled.orderBy(F.desc("measured_at"), F.desc("id")).select(date.alias("date"), "title", F.format_string("%.1f점", "total_score").alias("score"), F.when(F.col("total_score") >= PASS, "통과").otherwise("미통과").alias("passed"), missing.alias("missing_count"))


def cards(report: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, card, shown, band) of a report's score cards; dashes where a document has no history."""
    has = F.col("session_count") > 0
    points = lambda c: F.when(has, F.format_string("%.0f점", c)).otherwise("--")
    rows = [("최종 점수", F.when(has, F.format_string("%.0f점 (%s)", "total_score", "grade")).otherwise("--"), F.col("total_score"))]
    rows += [(k, points(c), F.col(c)) for k, c in (("퀴즈 점수", "quiz_score"), ("커버리지", "coverage_score"), ("키워드 밀도", "keyword_density"))]
    rows += [("총 세션", F.format_string("%d회", "session_count"), F.lit(100.0)), ("최고 점수", points("best_score"), F.col("best_score"))]
    packed = F.array(*[F.struct(F.lit(k).alias("card"), s.alias("shown"), F.when(v >= PASS, "ok").otherwise("warn" if k in ("커버리지", "키워드 밀도") else "danger").alias("band")) for k, s, v in rows])
    return report.select(doc, F.explode(packed).alias("x")).select(doc, "x.*")


def dashboard(stats: DataFrame) -> DataFrame:
    """(subject, document_count, quiz_count, avg_score, band) of every subject, worst average first."""
    return stats.select("*", band(F.col("avg_score")).alias("band")).orderBy("avg_score", "subject")
