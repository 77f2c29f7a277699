"""A document's questions from the store and back: generate, replace, ask, grade, score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import strip
from ..operators import quiz, scores, sentences
from ..operators.store import Store, cascade


#: Weights of a keyword's TF-IDF and TextRank scores.
COMBINED = (0.6, 0.4)


@dataclass
class Generated:
    """How many questions of each kind were made, and the ids of all that the document then has."""

    blank: int = 0
    ox: int = 0
    saved_ids: list[int] = field(default_factory=list)


def source(store: Store, document_id: int, combined: tuple[float, float] = COMBINED) -> DataFrame:
    """One row (doc_id, sentences, keywords): keywords by their combined score, best first; lines where the text has no sentences. No row where there is no text or no keyword."""
    document = store.read("documents").filter(F.col("id") == document_id).select(F.col("id").alias("doc_id"), F.col("content").alias("normal"))
    split = sentences.split_sentences(document.filter(F.coalesce(strip(F.col("normal")), F.lit("")) != "").withColumn("text", F.col("normal")))
    lines = F.filter(F.transform(F.split("normal", "\n"), strip), lambda x: x != "")
    rows = split.withColumn("sentences", F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(lines))
    weight = F.coalesce("tfidf_score", F.lit(0.0)) * combined[0] + F.coalesce("textrank_score", F.lit(0.0)) * combined[1]
    words = store.keywords_of(document_id).groupBy(F.col("document_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct((-weight).alias("s"), "id", "word"))).alias("k"))
    return rows.join(words, "doc_id").select("doc_id", "sentences", F.transform("k", lambda x: x["word"]).alias("keywords"))


def generate(store: Store, document_id: int, kind: str = "all", save: bool = True, blank: int = quiz.COUNT, ox: int = quiz.COUNT, seed: int = 0) -> Generated:
    """Questions of one kind (blank, ox) or all. Saved ones take the place of the document's earlier ones of that kind, with the results that refer to those; nothing changes where there is no text or no keyword."""
    rows = source(store, document_id)
    if rows.isEmpty():
        return Generated()
    made = quiz.generate(rows, kind, blank=blank, ox=ox, seed=seed)
    new = made.select(F.col("doc_id").alias("document_id"), "quiz_type", "question", "answer", "context", "keyword")
    if save:
        tables = {t: store.read(t) for t in ("quizzes", "quiz_results")}
        gone = tables["quizzes"].filter(F.col("document_id") == document_id)
        gone = (gone if kind == "all" else gone.filter(F.col("quiz_type") == kind)).select("id")
        store.change({t: df for t, df in cascade(tables, "quizzes", gone).items() if df is not tables[t]}, {"quizzes": new})
        # At most the questions of one document.
        now = store.quizzes_of(document_id).select("id", "quiz_type").collect()
        some = [r.quiz_type for r in now if kind in ("all", r.quiz_type)]
        return Generated(some.count("blank"), some.count("ox"), sorted(r.id for r in now))
    counts = {r.quiz_type: r["count"] for r in new.groupBy("quiz_type").count().collect()}
    return Generated(counts.get("blank", 0), counts.get("ox", 0))


def start(store: Store, document_id: int) -> int:
    """A new session's id."""
    store.insert("quiz_sessions", [{"document_id": document_id}])
    return store.read("quiz_sessions").agg(F.max("id")).first()[0]


def evaluate(store: Store, session_id: int, document_id: int, answers: DataFrame, coverage: float = 0.0, density: float = 0.0, missing: list[str] | None = None) -> DataFrame:
    """Grade a session's answers (quiz_id, user_answer). Results, the completed session and the document's new score are saved at once.

    Returns (session_id, total, correct, wrong_keywords, quiz_score, coverage_score, keyword_density, total_score, passed, grade).
    Missing concepts are those given, or else the keywords of wrong answers.
    """
    asked = store.read("quizzes").select(F.col("id").alias("quiz_id"), "quiz_type", "answer", "keyword")
    graded = answers.join(asked, "quiz_id").withColumn("is_correct", F.coalesce(quiz.is_correct(F.col("quiz_type"), F.col("answer"), F.col("user_answer")), F.lit(False)))
    wrong = F.array_sort(F.collect_set(F.when(~F.col("is_correct") & (F.col("keyword") != ""), F.col("keyword"))))
    sums = graded.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), wrong.alias("wrong_keywords"))  # one session
    s = scores.score(F.col("correct"), F.col("total"), F.lit(coverage), F.lit(density))
    out = sums.withColumn("s", s).select(F.lit(session_id).cast("long").alias("session_id"), "total", "correct", "wrong_keywords", "s.*")
    row = out.first()
    concepts = list(missing) if missing else list(row.wrong_keywords)
    result = graded.select(F.lit(session_id).cast("long").alias("session_id"), "quiz_id", "user_answer", "is_correct")
    score = {"document_id": document_id, "chapter": scores.WHOLE, "quiz_score": row.quiz_score, "coverage_score": row.coverage_score, "keyword_density": row.keyword_density, "total_score": row.total_score, "missing_concepts": concepts}
    store.change({"quiz_sessions": store.completed(session_id, row.total, row.correct, row.total_score)}, {"quiz_results": result, "comprehension_scores": [score]})
    return store.spark.createDataFrame([row], out.schema)


def report(store: Store, document_id: int) -> DataFrame:
    """(session_id, place, total_questions, correct_count, score, completed) of a document's sessions, the newest first."""
    order = W.partitionBy("document_id").orderBy(F.desc("started_at"), F.desc("id"))
    return store.of("quiz_sessions", document_id).select(F.col("id").alias("session_id"), F.row_number().over(order).alias("place"), "total_questions", "correct_count", "score", "completed")
