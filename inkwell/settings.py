"""All settings of an analysis in one place; each module's own constants are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

from .operators import chapters, concepts, quiz, scores, sentences, similarity, textrank, tfidf
from .sources import files


@dataclass(frozen=True)
class Settings:
    """Checked when made: shares between 0 and 1, counts positive, weights of one total."""

    max_file_mb: int = files.MAX_MB
    max_typed_chars: int = files.MAX_CHARS
    least_typed_chars: int = files.LEAST_CHARS
    extensions: tuple[str, ...] = files.EXTENSIONS
    max_features: int = tfidf.MAX_FEATURES
    min_df: int = tfidf.MIN_DF
    rank_window: int = textrank.WINDOW
    damping: float = textrank.DAMPING
    rank_rounds: int = textrank.ROUNDS
    rank_close: float = textrank.CLOSE
    top_n: int = textrank.TOP
    max_keywords: int = concepts.MOST
    concept_weights: tuple[float, float] = (concepts.TFIDF_WEIGHT, concepts.RANK_WEIGHT)
    similar: float = similarity.SIMILAR
    heading_size: float = chapters.HEADING_SIZE
    least_sentence: int = sentences.LEAST
    long_sentence: int = sentences.LONG
    questions: int = quiz.COUNT
    score_weights: tuple[float, float, float] = (scores.QUIZ, scores.COVERAGE, scores.DENSITY)
    pass_score: float = scores.PASS

    def __post_init__(self) -> None:
        if not 0 < self.damping < 1 or not 0 <= self.similar <= 1:
            raise ValueError("damping and similar are shares")
        if min(self.max_features, self.min_df, self.rank_window, self.rank_rounds, self.top_n, self.max_keywords, self.questions, self.max_file_mb, self.max_typed_chars) < 1:
            raise ValueError("counts are positive")
        if any(abs(sum(w) - 1) > 1e-9 or min(w) < 0 for w in (self.concept_weights, self.score_weights)):
            raise ValueError("weights are not negative and add up to 1")


DEFAULT = Settings()
