"""Named queries over the sample tables, and SQL that states the same for DuckDB.

Every query reads its whole tables. Tables stand for the application's own:
documents (source is the subject), benchmark (typed notes), labels (results),
events (score history), conversations (answers). Korean rules run on rows of
their own, since the sample documents hold no Hangul.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as t
from .functions.shared import forget, kept, shared_dir, spread
from .functions.words import STOP_CODE, STOP_EN, STOP_KO, WEAK_SUBJECTS
from .operators import chapters, concepts, index, layout, quiz, scores, sentences, similarity, store, textrank, tfidf
from .operators.term_table import TermTable
from .plans import analysis
from .sources import files
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KOREAN = (
    "소프트웨어 공학은 소프트웨어의 개발과 유지보수를 다루는 학문이다. 요구사항 분석은 매우 중요하다!",
    "Ｔｅｓｔ １２３　전각 문자와 half-width 문자를 함께 쓴다",
    "응집력은 모듈 내부 요소들의 연관 정도이다. 결합도는 모듈 사이의 의존 정도이다. 80% 이상 100개 3.5kg",
    "UML 다이어그램 class diagram 은 시스템 구조를 보여준다",
    "only English words here",
    "",
)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def korean(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KOREAN, 1)), "id int, text string")


def tokened(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, normal, language, tokens, other columns) of rows with a text."""
    df = t.normalized(df).withColumn("language", t.detect_language(F.col("normal")))
    return df.withColumn("tokens", t.tokens(F.col("normal"), F.col("language")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tokened(spread(table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("subject"))))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return tokened(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


# SQL fragments.


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate({c}, '{t.WIDE.replace(chr(39), chr(39) * 2)}', '{t.NARROW.replace(chr(39), chr(39) * 2)}'), '[^가-힣A-Za-z0-9\s.,!?;:()\-①-⑩]', ' ', 'g'), '[ \t]+', ' ', 'g'), {_SPACES})"


def _language(c: str) -> str:
    ko, en = f"len(regexp_extract_all({c}, '[가-힣]'))", f"len(regexp_extract_all({c}, '[A-Za-z]'))"
    return f"CASE WHEN {ko} + {en} = 0 THEN 'ko' WHEN {ko}::DOUBLE / ({ko} + {en}) >= 0.7 THEN 'ko' WHEN {ko}::DOUBLE / ({ko} + {en}) <= 0.3 THEN 'en' ELSE 'mixed' END"


def _tokens(c: str, language: str) -> str:
    ko = f"regexp_extract_all({c}, '[가-힣]{{2,}}')"
    return (
        f"(CASE WHEN {language} IN ('ko', 'mixed') THEN list_filter({ko}, lambda x: NOT list_contains({_list(STOP_KO)}, x)) ELSE {ko} END"
        f" || list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_list(STOP_EN | STOP_CODE)}, x))"
        f" || regexp_extract_all({c}, '{t.NUMBER_UNIT}'))"
    )


_BIGRAMS = "list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1])"
_KOREAN = "k(id, text) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(KOREAN, 1)) + ")"
_K = f"{_KOREAN}, kn AS (SELECT id, text, {_normal('text')} AS normal FROM k), kl AS (SELECT *, {_language('normal')} AS language FROM kn), kt AS (SELECT *, {_tokens('normal', 'language')} AS tokens FROM kl)"


def _tok(source: str, key: str, name: str, more: str = "") -> str:
    return f"{name}n AS (SELECT {key} AS doc_id{more}, {_normal('text')} AS normal FROM {source}), {name}l AS (SELECT *, {_language('normal')} AS language FROM {name}n), {name} AS (SELECT *, {_tokens('normal', 'language')} AS tokens FROM {name}l)"


_D = _tok("documents", "doc_id", "d", ", source AS subject")
_N = _tok("benchmark", "item_id", "b")


def _counts(source: str, name: str, grams: bool = True) -> str:
    terms = f"tokens || {_BIGRAMS}" if grams else "tokens"
    return f"{name} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM {source}) GROUP BY ALL)"


_SINGLE = "s AS (SELECT doc_id, term, tf, round(ln(1 + tf) * (ln((sum(tf) OVER (PARTITION BY doc_id) + 1) / (tf + 1)) + 1), 6) AS score FROM c)"
_TOP10 = "top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INTEGER AS rank FROM s QUALIFY rank <= 10)"

# Text.


@query(f"SELECT doc_id, {_normal('text')} AS normal FROM documents")
def normalize_text(spark, d):
    return t.normalized(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "normal")


@query(f"WITH {_K} SELECT id, normal, language, array_to_string(tokens, ' ') AS tokens FROM kt")
def tokenize_ko_inline(spark, d):
    return tokened(korean(spark), "id").select("id", "normal", "language", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_KOREAN} SELECT id, translate(text, '{t.WIDE.replace(chr(39), chr(39) * 2)}', '{t.NARROW.replace(chr(39), chr(39) * 2)}') AS narrow FROM k")
def fullwidth_inline(spark, d):
    return korean(spark).select("id", t.narrow(F.col("text")).alias("narrow"))


@query(f"WITH {_D} SELECT doc_id, language FROM dl")
def detect_language(spark, d):
    return docs(spark, d).select("doc_id", "language")


@query(f"WITH {_D} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM d")
def tokenize_en(spark, d):
    return docs(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_D} SELECT doc_id, array_to_string({_BIGRAMS}, ' ') AS bigrams FROM d")
def bigrams(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(t.bigrams(F.col("tokens")), " ").alias("bigrams"))


@query(f"WITH {_D}, {_counts('d', 'c', False)} SELECT doc_id, term, tf FROM c")
def token_freq(spark, d):
    return tfidf.term_counts(docs(spark, d), with_bigrams=False)


@query(f"WITH {_D} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_unique FROM d")
def doc_token_stats(spark, d):
    return docs(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_unique"))


@query("""SELECT doc_id, (i // 900)::INTEGER AS idx, substr(text, (i + 1)::BIGINT, 1000) AS chunk FROM (
  SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END) AS i FROM documents)""")
def chunk_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("idx", "chunk"))


@query(f"WITH {_D} SELECT doc_id, len(list_filter(regexp_extract_all(normal, '[A-Za-z]+'), lambda x: NOT list_contains({_list(STOP_EN | STOP_KO)}, lower(x)) AND length(x) > 1))::BIGINT AS n FROM d")
def filter_stop_words(spark, d):
    words = F.regexp_extract_all("normal", F.lit("[A-Za-z]+"), F.lit(0))
    return docs(spark, d).select("doc_id", F.size(t.filter_stop_words(words)).cast("long").alias("n"))


@query("""WITH w(word) AS (VALUES ('응집력'), ('결합도'), ('모듈'), ('변화'), ('UML')) SELECT word,
  CASE WHEN unicode(right(word, 1)) < 44032 OR (unicode(right(word, 1)) - 44032) % 28 > 0 THEN '은' ELSE '는' END AS particle FROM w""")
def particle_inline(spark, d):
    words = spark.createDataFrame([(w,) for w in ("응집력", "결합도", "모듈", "변화", "UML")], "word string")
    return words.select("word", t.particle(F.col("word")).alias("particle"))


@query("""SELECT page_id, sha256(html) AS hash, CASE WHEN strlen(html) < 1024 THEN format('{:.1f} B', strlen(html)::DOUBLE) ELSE format('{:.1f} KB', floor(strlen(html) / 102.4 + 0.5) / 10) END AS size,
  trim(translate(url, '\\/:*?"<>|', '_________')) AS name FROM pages""")
def page_files(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", t.content_hash(F.col("html")).alias("hash"), t.human_size(F.octet_length("html")).alias("size"), t.safe_name(F.col("url")).alias("name"))


# Sentences.

_MARK = "chr(1)"
_SENT = rf"""
m AS (SELECT doc_id, tokens, regexp_replace(regexp_replace(regexp_replace(regexp_replace(normal, '([①-⑩])', chr(10) || '\1', 'g'), '(\(\d{{1,2}}\)\s)', chr(10) || '\1', 'g'),
  '(^|[^A-Za-z0-9_가-힣])(\d{{1,2}}\)\s)', '\1' || chr(10) || '\2', 'g'), '\s+(\d+[-.]\d+\.\s+[가-힣A-Z])', chr(10) || '\1', 'g') AS x FROM d),
p AS (SELECT doc_id, tokens, unnest(string_split(x, chr(10))) AS p, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM m),
q AS (SELECT doc_id, i, unnest(string_split(regexp_replace(regexp_replace(trim(p, {_SPACES}), '([^0-9][.!?])\s+', '\1' || {_MARK}, 'g'), '([^0-9][.!?])\s+', '\1' || {_MARK}, 'g'), {_MARK})) AS s, generate_subscripts(string_split(regexp_replace(regexp_replace(trim(p, {_SPACES}), '([^0-9][.!?])\s+', '\1' || {_MARK}, 'g'), '([^0-9][.!?])\s+', '\1' || {_MARK}, 'g'), {_MARK}), 1) AS j FROM p),
r AS (SELECT doc_id, i, j, trim(s, {_SPACES}) AS s FROM q WHERE length(trim(s, {_SPACES})) >= 15),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(s, 1, 60) ORDER BY i, j) AS n FROM r),
sent AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS sid, s FROM f WHERE n = 1)"""


def said(spark, d):
    return sentences.split_sentences(docs(spark, d))


@query(f"WITH {_D}, {_SENT} SELECT doc_id, sid, s AS sentence FROM sent")
def split_sentences(spark, d):
    return said(spark, d).select("doc_id", F.posexplode("sentences").alias("sid", "sentence"))


SECTIONS = (
    "1-1. 자료 흐름도의 개념\n① 외부 실체 - 정의: 시스템 바깥에서 자료를 주고받는 대상이다 - 기호: 사각형으로 그려서 나타낸다\n② 처리 과정은 자료를 변환하는 동작을 나타낸다.",
    "응집력 모듈 내부 요소들의 연관성 정도\n종류 일곱 가지로 나누어 설명한다\n7 Functional 모든 요소가 하나의 기능을 수행",
    "모듈은 독립적으로 컴파일되는 단위이다. 결합도는 낮을수록 좋다고 한다! 응집도는 높을수록 좋은가? 그렇다고 답한다.",
)


@query()
def section_carry_inline(spark, d):
    rows = spark.createDataFrame(list(enumerate(SECTIONS)), "doc_id int, normal string")
    return sentences.split_sentences(rows).select("doc_id", F.posexplode("sentences").alias("sid", "sentence"))


# TF-IDF.


@query(f"WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10} SELECT doc_id, term, tf, score, rank FROM top")
def tfidf_single_topk(spark, d):
    return tfidf.fit_single(docs(spark, d), k=10)


_VOCAB = "v AS (SELECT term, count(*) AS df, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM c, (SELECT count(*)::DOUBLE AS n FROM d) GROUP BY term, n ORDER BY df DESC, term LIMIT 500)"


@query(f"WITH {_D}, {_counts('d', 'c')} SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY df DESC, term LIMIT 500")
def doc_frequency(spark, d):
    return tfidf.fit_vocabulary(docs(spark, d))[0].select("term", "df")


@query(f"WITH {_D}, {_counts('d', 'c')}, {_VOCAB} SELECT term, round(idf, 6) AS idf FROM v")
def idf_smooth(spark, d):
    return tfidf.fit_vocabulary(docs(spark, d))[0].select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_D}, {_counts('d', 'c')}, {_VOCAB} SELECT term, round(ln((SELECT count(*) FROM d)::DOUBLE / greatest(df, 1)) + 1, 6) AS idf FROM v")
def idf_raw(spark, d):
    return tfidf.fit_vocabulary(docs(spark, d), smooth=False)[0].select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_D}, {_counts('d', 'c')}, {_VOCAB} SELECT term, round(sum(ln(1 + tf) * idf) / (SELECT count(*) FROM d), 6) AS score FROM c JOIN v USING (term) GROUP BY term")
def tfidf_corpus_mean(spark, d):
    x = kept(docs(spark, d).select("doc_id", "tokens"))  # read up to three times
    vocab, n = tfidf.fit_vocabulary(x)
    vocab = kept(vocab)
    return tfidf.corpus_scores(tfidf.transform(tfidf.vocabulary_counts(x, vocab), vocab), n)


@query(f"WITH {_D}, {_N}, {_counts('d', 'c')}, {_counts('b', 'e')}, {_VOCAB} SELECT doc_id, term, round(ln(1 + tf) * idf, 6) AS tfidf FROM e JOIN v USING (term)")
def tfidf_transform(spark, d):
    vocab = kept(tfidf.fit_vocabulary(docs(spark, d))[0])
    return tfidf.transform(tfidf.term_counts(notes(spark, d)), vocab).withColumn("tfidf", F.round("tfidf", 6))


# TextRank.


def _edges(source: str, name: str) -> str:
    return f"""{name}x AS (SELECT doc_id, tokens[i] AS a, tokens[i + 1:i + 4] AS w FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM {source})),
{name}y AS (SELECT doc_id, a, b, 1.0::DOUBLE / list_position(w, b) AS w FROM (SELECT doc_id, a, w, unnest(w) AS b FROM {name}x) WHERE a <> b),
{name} AS (SELECT doc_id, src, dst, sum(w) AS w FROM (SELECT doc_id, a AS src, b AS dst, w FROM {name}y UNION ALL SELECT doc_id, b, a, w FROM {name}y) GROUP BY ALL)"""


@query(f"WITH {_D}, {_edges('d', 'g')} SELECT doc_id, src, dst, round(w, 6) AS w FROM g")
def cooccurrence_edges(spark, d):
    return textrank.edges(docs(spark, d), rounded=True)


def _ranks(depth: int = 10) -> str:
    out = "share AS (SELECT doc_id, src, dst, w / sum(w) OVER (PARTITION BY doc_id, src) AS s FROM g), node AS (SELECT doc_id, src AS node, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, src FROM g)), r0 AS (SELECT doc_id, node, 1.0::DOUBLE / n AS score FROM node)"
    for k in range(1, depth + 1):
        out += f", r{k} AS (SELECT node.doc_id, node.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS score FROM node LEFT JOIN (SELECT share.doc_id, dst AS node, sum(s * score) AS got FROM share JOIN r{k - 1} r ON r.doc_id = share.doc_id AND r.node = share.src GROUP BY ALL) x ON x.doc_id = node.doc_id AND x.node = node.node)"
    return out


def ranked_notes(spark, d):
    return textrank.rank_fixed(textrank.edges(notes(spark, d))).select("doc_id", F.col("node").alias("term"), F.round("score", 6).alias("score"))


@query(f"WITH {_N}, {_edges('b', 'g')}, {_ranks()} SELECT doc_id, node AS term, round(score, 6) AS score FROM r10")
def pagerank_fixed10(spark, d):
    return ranked_notes(spark, d)


@query()
def textrank_keywords(spark, d):
    return textrank.keywords(docs(spark, d))


@query(f"WITH {_D} SELECT doc_id, tokens[1] AS term, len(tokens)::DOUBLE AS score FROM d WHERE len(list_distinct(tokens)) = 1")
def textrank_fallback(spark, d):
    return textrank.fallback(docs(spark, d))


_SEDGES = r"""
sw AS (SELECT sent.doc_id, sid, word, count(*) AS c FROM (SELECT doc_id, sid, unnest(string_split_regex(s, '\s+')) AS word FROM sent) sent JOIN d ON d.doc_id = sent.doc_id AND list_contains(tokens, word) GROUP BY ALL),
sn AS (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY doc_id, sid)) AS n FROM sw),
se AS (SELECT a.doc_id, a.sid AS src, b.sid AS dst, sum(a.c * b.c) / (first(a.n) * first(b.n)) AS w FROM sn a JOIN sn b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sid < b.sid GROUP BY ALL HAVING w > 0.001)"""


@query(f"WITH {_D}, {_SENT}, {_SEDGES} SELECT doc_id, src, dst, round(w, 6) AS w FROM se UNION ALL SELECT doc_id, dst, src, round(w, 6) FROM se")
def sentence_edges(spark, d):
    return textrank.sentence_edges(said(spark, d), rounded=True)


@query()
def textrank_sentences(spark, d):
    return textrank.top_sentences(said(spark, d))


@query()
def corpus_rank(spark, d):
    """Words ranked by the co-occurrences of all documents, in one graph."""
    return textrank.words_rank(docs(spark, d))[0].select("node", F.round("score", 6).alias("score"))


@query(f"WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10}, {_SENT} SELECT sent.doc_id, sid, bool_or(contains(s, term)) AS has_keyword FROM sent JOIN top USING (doc_id) GROUP BY ALL")
def keyword_sentences(spark, d):
    """Whether each sentence holds one of its document's keywords."""
    return topped(said(spark, d)).select("doc_id", F.posexplode(sentences.with_keywords(F.col("sentences"), F.col("keywords"))).alias("sid", "has_keyword"))


_LISTS = "ls AS (SELECT d.doc_id, normal, coalesce(c, []::VARCHAR[]) AS c FROM dl d LEFT JOIN (SELECT doc_id, list(s ORDER BY sid) AS c FROM sent GROUP BY doc_id) USING (doc_id))"


@query(rf"""WITH {_D}, {_SENT}, {_LISTS} SELECT doc_id, len(c) = 0 AS fell_back, array_to_string(CASE WHEN len(c) > 0 THEN c
  ELSE list_filter(list_transform(string_split(normal, chr(10)), lambda x: trim(x, {_SPACES})), lambda x: x <> '') END, ' | ') AS lines FROM ls""")
def sentences_or_lines(spark, d):
    """Sentences, or the lines of texts that have none."""
    return said(spark, d).select("doc_id", (F.size("sentences") == 0).alias("fell_back"), F.array_join(sentences.or_lines(F.col("sentences"), F.col("normal")), " | ").alias("lines"))


@query(f"WITH {_D}, {_SENT}, {_LISTS}, x AS (SELECT doc_id, ['첫 문장'] || c[2:] AS c FROM ls), e AS (SELECT doc_id, array_to_string(c[1:1] || c[3:] || ['새 문장'], chr(10)) AS content FROM x) SELECT doc_id, content, length(content)::INTEGER AS char_count FROM e")
def edited_sentences(spark, d):
    """The first sentence replaced, the second deleted, one added; saved as content."""
    content = F.array_join(store.edit_sentences(F.col("sentences"), ["새 문장"], {0: "첫 문장"}, {1}), "\n")
    return said(spark, d).select("doc_id", content.alias("content")).withColumn("char_count", F.length("content"))


@query(f"""WITH x AS (SELECT doc_id, trim(substr(text, 1, 500000), {_SPACES}) AS text, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '  ' END AS label FROM documents)
SELECT doc_id, text, coalesce(nullif(trim(label), ''), '직접 입력') AS label FROM x WHERE length(text) >= 20""")
def typed_texts(spark, d):
    """Documents taken as typed: cut, stripped, with a label; short ones refused."""
    kind = F.col("doc_id") % 3
    x = table(spark, d, "documents").select("doc_id", "text", F.when(kind == 0, F.col("source")).when(kind == 1, "  ").alias("label"))
    return files.typed_text(x).select("doc_id", "text", "label")


# Similarity, coverage, gaps.


@query("""WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id""")
def cosine_embeddings(spark, d):
    """Each vector against the mean of its label."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


def noted(rows, spark, d):
    """Rows of documents with the note that their id falls on."""
    n = notes(spark, d).select(F.col("doc_id").alias("item"), F.col("tokens").alias("note"))
    size = n.count()
    return rows.withColumn("item", F.col("doc_id") % size).join(n, "item")


def paired(spark, d):
    """Documents with the note that their id falls on: (doc_id, tokens, note)."""
    return noted(docs(spark, d), spark, d)


_PAIR = "pr AS (SELECT d.doc_id, d.tokens, b.tokens AS note FROM d JOIN b ON b.doc_id = d.doc_id % (SELECT count(*) FROM b))"


def _cos(a: str, b: str) -> str:
    n = lambda x: f"list_sum(list_transform(list_distinct({x}), lambda w: len(list_filter({x}, lambda y: y = w)) ** 2))"
    both = f"list_sum(list_transform(list_intersect(list_distinct({a}), list_distinct({b})), lambda w: len(list_filter({a}, lambda y: y = w)) * len(list_filter({b}, lambda y: y = w))))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE coalesce({both}, 0) / sqrt({n(a)} * {n(b)}) END"


@query(f"WITH {_D}, {_N}, {_PAIR} SELECT doc_id, round({_cos('tokens', 'note')}, 6)::DOUBLE AS cosine FROM pr")
def cosine_tokens_pairs(spark, d):
    return paired(spark, d).select("doc_id", F.round(similarity.cosine_tokens(F.col("tokens"), F.col("note")), 6).alias("cosine"))


@query(f"""WITH {_N}, {_counts('b', 'e', False)}, u AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS u FROM e)
SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.u * b.u), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, doc_id, 1.0::DOUBLE FROM e""")
def cosine_matrix(spark, d):
    counts = tfidf.term_counts(notes(spark, d), with_bigrams=False)
    return similarity.cosine_pairs(counts, weight="tf").union(similarity.cosine_diagonal(counts, weight="tf")).withColumn("cosine", F.round("cosine", 6))


#: Least cosine of TF-IDF rows that links two documents.
LINKED = 0.5
_LINKED = f"""WITH {_D}, {_counts('d', 'e', False)}, n AS (SELECT count(*)::DOUBLE AS n FROM d), df AS (SELECT term, count(*) AS df FROM e GROUP BY term),
w AS (SELECT doc_id, term, ln(1 + tf) * (ln((n + 1) / (df + 1)) + 1) AS w FROM e JOIN df USING (term), n),
k AS (SELECT doc_id, list(term || ':' || w ORDER BY term) AS k FROM w GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS size FROM k),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w WHERE doc_id IN (SELECT rep FROM m)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.u * b.u), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(sum(a.u * b.u), 6) >= {LINKED})"""


def linked(spark, d):
    x = docs(spark, d)
    counts, n = kept(similarity.counted(x)), x.count()
    units, members = similarity.tfidf_vectors(counts, n)
    forget(counts)  # its vectors are written
    return similarity.vectors_join(units, members, LINKED)


@query(f"{_LINKED} SELECT a, b, cosine, x.size AS a_size, y.size AS b_size FROM pairs JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b")
def similar_documents(spark, d):
    return linked(spark, d)[0]


@query(f"""{_LINKED}, l AS (SELECT a AS rep, size AS n FROM pairs JOIN m ON doc_id = b UNION ALL SELECT b, size FROM pairs JOIN m ON doc_id = a)
SELECT doc_id, rep, coalesce(n, 0)::BIGINT + size - 1 AS n_links FROM m LEFT JOIN (SELECT rep, sum(n) AS n FROM l GROUP BY rep) USING (rep)""")
def similar_links(spark, d):
    return similarity.links(*linked(spark, d))


def ten_best(df, tokens_too=True):
    """df with its ten keywords, counted in each document's row, and what ranks them (top)."""
    return tfidf.with_top(df, 10, tokens_too=tokens_too).withColumn("keywords", F.transform("top", lambda x: x["term"])).filter(F.size("top") > 0)


def topped(df):
    """df with its ten keywords."""
    return ten_best(df).drop("top")


def covered(spark, d, tokens_too=False):
    """Each document's ten keywords against its note."""
    return noted(ten_best(docs(spark, d).select("doc_id", "tokens"), tokens_too), spark, d)


_NEAR = "list_aggregate(list_transform(list_filter(note, lambda t: length(t) >= 2), lambda t: contains(t, term) OR contains(term, t)), 'bool_or')"
_STATUS = f"st AS (SELECT doc_id, term, rank, score, CASE WHEN list_contains(note, term) THEN 'covered' WHEN coalesce({_NEAR}, false) THEN 'partial' ELSE 'missing' END AS status FROM top JOIN pr USING (doc_id))"
_COV = f"WITH {_D}, {_N}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10}, {_PAIR}, {_STATUS}"


@query(f"""{_COV} SELECT doc_id, round((count(*) FILTER (status = 'covered') + 0.5 * count(*) FILTER (status = 'partial')) / count(*), 4)::DOUBLE AS coverage_rate,
  coalesce(string_agg(term, ' ' ORDER BY rank) FILTER (status = 'covered'), '') AS covered, coalesce(string_agg(term, ' ' ORDER BY rank) FILTER (status = 'partial'), '') AS partial, coalesce(string_agg(term, ' ' ORDER BY rank) FILTER (status = 'missing'), '') AS missing FROM st GROUP BY doc_id""")
def coverage(spark, d):
    out = covered(spark, d).select("doc_id", t.pinned(similarity.coverage(F.col("keywords"), F.col("note"))).alias("c"))
    return out.select("doc_id", "c.coverage_rate", *[F.array_join(f"c.{x}", " ").alias(x) for x in ("covered", "partial", "missing")])


@query(f"{_COV}, kw AS (SELECT doc_id, list(term) AS k FROM top GROUP BY doc_id) SELECT doc_id, CASE WHEN len(note) = 0 THEN 0.0 ELSE round(len(list_filter(note, lambda t: list_contains(k, t))) / len(note), 6) END::DOUBLE AS density FROM pr JOIN kw USING (doc_id)")
def keyword_density(spark, d):
    return covered(spark, d).select("doc_id", F.round(similarity.keyword_density(F.col("keywords"), F.col("note")), 6).alias("density"))


@query(f"""WITH {_D}, {_N}, {_PAIR} SELECT doc_id, round({_cos('tokens', 'note')}, 4)::DOUBLE AS similarity, ({_cos('tokens', 'note')}) >= 0.3 AS is_similar,
  array_to_string(list_sort(list_intersect(list_distinct(tokens), list_distinct(note))), ' ') AS common, len(list_filter(list_distinct(tokens), lambda x: NOT list_contains(note, x)))::INTEGER AS n_a, len(list_filter(list_distinct(note), lambda x: NOT list_contains(tokens, x)))::INTEGER AS n_b FROM pr""")
def compare_docs(spark, d):
    out = paired(spark, d).select("doc_id", t.pinned(similarity.compare(F.col("tokens"), F.col("note"))).alias("x"))
    return out.select("doc_id", "x.similarity", "x.is_similar", F.array_join("x.common_words", " ").alias("common"), F.size("x.only_a").alias("n_a"), F.size("x.only_b").alias("n_b"))


@query(f"""{_COV}, {_counts('b', 'nc', False)}, {_counts('d', 'dc', False)}, size AS (SELECT count(*) AS n FROM b), item AS (SELECT d.doc_id, b.doc_id AS item FROM d JOIN b ON b.doc_id = d.doc_id % (SELECT n FROM size)),
cs AS (SELECT dc.doc_id, sum(dc.tf * nc.tf) AS dot FROM dc JOIN item ON item.doc_id = dc.doc_id JOIN nc ON nc.doc_id = item AND nc.term = dc.term GROUP BY dc.doc_id),
dsq AS (SELECT doc_id, sum(tf * tf) AS sq FROM dc GROUP BY doc_id), nsq AS (SELECT doc_id AS item, sum(tf * tf) AS sq FROM nc GROUP BY doc_id),
sim AS (SELECT item.doc_id, coalesce(dot / sqrt(dsq.sq * nsq.sq), 0)::DOUBLE AS cosine FROM item LEFT JOIN cs USING (doc_id) LEFT JOIN dsq USING (doc_id) LEFT JOIN nsq USING (item)),
kw AS (SELECT doc_id, list(term ORDER BY rank) AS k FROM top GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, round((count(*) FILTER (status = 'covered') + 0.5 * count(*) FILTER (status = 'partial')) / count(*), 4)::DOUBLE AS rate, coalesce(list(term ORDER BY rank) FILTER (status = 'missing'), []::VARCHAR[]) AS missing FROM st GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(note) = 0 THEN 0.0 ELSE rate END AS coverage_rate, CASE WHEN len(note) = 0 THEN 0.0 ELSE round(rate * 100, 1) END AS coverage_pct,
  CASE WHEN len(note) = 0 THEN 0.0 ELSE round(len(list_filter(note, lambda t: list_contains(k, t))) / len(note), 4) END::DOUBLE AS keyword_density,
  CASE WHEN len(note) = 0 THEN 0.0 ELSE round(cosine, 4) END::DOUBLE AS similarity, len(k)::INTEGER AS total_keywords, CASE WHEN len(note) = 0 THEN k ELSE missing END AS missing
FROM pr JOIN kw USING (doc_id) JOIN n USING (doc_id) JOIN sim USING (doc_id)""")
def coverage_report(spark, d):
    return similarity.coverage_report(covered(spark, d, tokens_too=True).withColumnsRenamed({"tokens": "source_tokens", "note": "target_tokens"})).select("doc_id", "coverage_rate", "coverage_pct", "keyword_density", "similarity", "total_keywords", "missing")


@query(f"""{_COV}, nf AS (SELECT doc_id, w AS term, count(*) AS f FROM (SELECT doc_id, unnest(note) AS w FROM pr) GROUP BY ALL)
SELECT doc_id, term AS word, score AS tfidf_score, f IS NOT NULL AS in_target, coalesce(f, 0)::BIGINT AS frequency, row_number() OVER (PARTITION BY doc_id ORDER BY f IS NOT NULL DESC, score DESC, term)::INTEGER AS rank FROM top LEFT JOIN nf USING (doc_id, term)""")
def rank_by_coverage(spark, d):
    top = tfidf.fit_single(docs(spark, d), k=10).withColumnRenamed("term", "word")
    words = paired(spark, d).select("doc_id", F.explode("note").alias("token"))
    return similarity.rank_by_coverage(top, words)


@query(f"""{_COV}, w AS (SELECT *, CASE status WHEN 'missing' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS w FROM st)
SELECT * FROM (SELECT doc_id, term AS word, status, round(w * score + 1e-9, 6) AS importance, round(avg(w) OVER (PARTITION BY doc_id), 4) AS gap_rate FROM w) WHERE status <> 'covered'""")
def gap_detect(spark, d):
    """Each document's keywords that its note lacks: texts are tokenised once, and only the notes are sent to them."""
    words = F.transform("top", lambda x: F.struct(x["term"].alias("word"), (-x["minus"]).alias("score")))
    found = covered(spark, d).select("doc_id", t.pinned(similarity.gaps_of(words, F.col("note"))).alias("gaps"))
    return found.select("doc_id", F.explode("gaps").alias("x")).select("doc_id", "x.*")


# Concepts.

_COMB = """{name} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY combined_score DESC, word)::INTEGER AS rank FROM (
  SELECT coalesce(a.doc_id, r.doc_id) AS doc_id, coalesce(a.term, r.term) AS word, coalesce(a.score, 0) AS tfidf_score, coalesce(r.score, 0) AS textrank_score,
    round(0.6::DOUBLE * coalesce(a.score, 0) + 0.4::DOUBLE * coalesce(r.score, 0), 6) AS combined_score
  FROM {a} a FULL JOIN (SELECT doc_id, node AS term, round(score, 6) AS score FROM r10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, node) <= 100) r ON a.doc_id = r.doc_id AND a.term = r.term) QUALIFY rank <= 50)"""
_CONCEPT = f"WITH {_N}, {_edges('b', 'g')}, {_ranks()}, {_counts('b', 'c')}, {_counts('b', 'one', False)}, {_SINGLE}, s150 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 150)"


@query(f"{_CONCEPT}, {_COMB.format(name='x', a='s150')} SELECT x.doc_id, word, tfidf_score, textrank_score, coalesce(tf, 1)::BIGINT AS frequency, combined_score, rank FROM x LEFT JOIN one ON one.doc_id = x.doc_id AND one.term = x.word")
def concept_extract(spark, d):
    return concepts.extract(notes(spark, d), ranked=ranked_notes(spark, d))


_CORPUS = """v AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM c, (SELECT count(*)::DOUBLE AS n FROM b) GROUP BY term, n ORDER BY count(*) DESC, term LIMIT 150),
cs AS (SELECT b.doc_id, v.term, coalesce(round(ln(1 + tf) * idf, 6), 0) AS score FROM b JOIN v ON len(tokens) > 0 LEFT JOIN c ON c.doc_id = b.doc_id AND c.term = v.term QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY score DESC, v.term) <= 50)"""


@query(f"{_CONCEPT}, {_CORPUS}, {_COMB.format(name='x', a='cs')} SELECT x.doc_id, word, tfidf_score, textrank_score, coalesce(tf, 1)::BIGINT AS frequency, combined_score, rank FROM x LEFT JOIN one ON one.doc_id = x.doc_id AND one.term = x.word")
def concept_extract_multi(spark, d):
    return concepts.extract_corpus(notes(spark, d), ranked=ranked_notes(spark, d))


# Over documents, with ranks that have converged; the two above are notes with 10 rounds, as far as SQL can state them.


@query()
def concept_extract_docs(spark, d):
    return concepts.extract(docs(spark, d))


@query()
def concept_extract_multi_docs(spark, d):
    return concepts.extract_corpus(docs(spark, d))


@query()
def leading_sentences(spark, d):
    return concepts.leading_sentences(said(spark, d))


# Index.

_INDEX = "p0 AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM d), ix AS (SELECT term, doc_id, count(*) AS frequency, list(pos ORDER BY pos) AS positions FROM p0 GROUP BY ALL)"


def indexed(spark, d):
    return index.build(docs(spark, d))


#: Saved tables of this session: what they were made of, and where they lie.
_saved: dict[tuple, str] = {}


def _table_of(spark, d, name, make, schema, again=False):
    """A TermTable of what make(spark, d) gives, saved in the shared folder once for each state of the documents; again: a new one."""
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source).getModificationTime()
    key = (spark.sparkContext.applicationId, name, d, changed)
    if again or key not in _saved:
        root = f"{shared_dir(spark)}/inkwell-{name}-{uuid.uuid4().hex}"
        TermTable(spark, root, schema).replace(make(spark, d))
        if again:
            return TermTable(spark, root, schema)
        _saved[key] = root
    return TermTable(spark, _saved[key], schema)


_POSTING = "term string, doc_id long, frequency long, positions array<int>"


def saved(spark, d) -> TermTable:
    """The saved index of the documents."""
    return _table_of(spark, d, "index", indexed, _POSTING)


@query(f"WITH {_D}, {_INDEX} SELECT term, doc_id, frequency, array_to_string(positions, ' ') AS positions FROM ix")
def index_build(spark, d):
    return indexed(spark, d).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(f"WITH {_D}, {_INDEX} SELECT term, doc_id, frequency, array_to_string(positions[1:10], ' ') AS positions, round(ln(1 + frequency), 6) AS score FROM ix WHERE contains(lower(term), 'tion') ORDER BY frequency DESC, term, doc_id LIMIT 50")
def search_substring(spark, d):
    return index.search_saved(saved(spark, d), " TION ").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(f"WITH {_D}, {_INDEX} SELECT term, doc_id, frequency FROM ix WHERE term = 'thtion'")
def search_exact(spark, d):
    return index.exact(saved(spark, d).words(["thtion"]), "thtion").select("term", "doc_id", "frequency")


@query(f"WITH {_D}, {_INDEX} SELECT doc_id FROM ix WHERE term IN ('tion', 'ing') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def search_and(spark, d):
    return index.all_of(saved(spark, d).words(["tion", "ing"]), ["tion", "ing"])


@query(f"WITH {_D}, {_INDEX} SELECT DISTINCT doc_id FROM ix WHERE term IN ('tion', 'ing', 'ment')")
def search_or(spark, d):
    return index.any_of(saved(spark, d).words(["tion", "ing", "ment"]), ["tion", "ing", "ment"])


@query(f"WITH {_D}, {_INDEX} SELECT term, doc_id, frequency, round(frequency / sum(frequency) OVER (PARTITION BY doc_id), 6) AS tf FROM ix")
def index_tf(spark, d):
    return index.term_frequency(indexed(spark, d))


@query(f"WITH {_D}, {_INDEX} SELECT DISTINCT term FROM ix")
def index_vocab(spark, d):
    return index.vocabulary(indexed(spark, d))


@query(f"WITH {_D}, {_INDEX} SELECT count(DISTINCT doc_id) AS doc_count, count(DISTINCT term) AS word_count FROM ix")
def index_counts(spark, d):
    return index.counts(indexed(spark, d))


@query(f"WITH {_D}, {_INDEX} SELECT doc_id, sum(frequency)::BIGINT AS n_tokens FROM ix GROUP BY doc_id")
def index_lengths(spark, d):
    return index.lengths(indexed(spark, d))


@query(f"WITH {_D}, {_INDEX} SELECT doc_id, term, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term)::INTEGER AS rank FROM ix QUALIFY rank <= 10")
def index_top_words(spark, d):
    return index.top_words(indexed(spark, d))


@query(f"{_COV}, {_INDEX}, nx AS (SELECT pr.doc_id, w AS term, count(*) AS f FROM (SELECT doc_id, unnest(note) AS w FROM pr) pr GROUP BY ALL) SELECT doc_id, term, coalesce(f, 0)::BIGINT AS frequency FROM top LEFT JOIN nx USING (doc_id, term)")
def keywords_coverage(spark, d):
    notes_index = index.build(paired(spark, d).select("doc_id", "note"), tokens="note")
    return index.keyword_counts(notes_index, tfidf.fit_single(docs(spark, d), k=10).select("doc_id", "term"))


@query(f"WITH {_D}, {_INDEX} SELECT term, ix.doc_id, 'doc ' || ix.doc_id AS title, subject, frequency FROM ix JOIN d USING (doc_id) WHERE term ILIKE '%ment%' ORDER BY frequency DESC, term, doc_id LIMIT 50")
def search_join_title(spark, d):
    titles = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("source").alias("subject"))
    return index.search_titles(saved(spark, d).like("MENT"), titles, "MENT")


def keyword_rows(spark, d):
    """Keywords as stored: the third best of each document removed by its user, the fifth added by them."""
    top = tfidf.fit_single(docs(spark, d), k=10)
    return top.select("doc_id", F.col("term").alias("word"), F.col("tf").alias("frequency"), (F.col("rank") == 3).alias("is_user_removed"), (F.col("rank") == 5).alias("is_user_added"))


def saved_keywords(spark, d) -> TermTable:
    """Saved keywords, searched by their words."""
    make = lambda spark, d: keyword_rows(spark, d).withColumnRenamed("word", "term")
    return _table_of(spark, d, "keywords", make, "term string, doc_id long, frequency long, is_user_removed boolean, is_user_added boolean")


@query(f"WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10} SELECT term AS word, doc_id, 'doc ' || doc_id AS title, subject, max(tf)::BIGINT AS frequency FROM top JOIN d USING (doc_id) WHERE rank <> 3 AND contains(lower(term), 'an') GROUP BY ALL")
def keyword_search(spark, d):
    titles = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("source").alias("subject"))
    return index.search_keywords(saved_keywords(spark, d).containing(" AN ").withColumnRenamed("term", "word"), titles, " AN ")


@query(f"WITH {_D}, {_INDEX} SELECT doc_id, min(abs(x - y))::INTEGER AS distance FROM (SELECT a.doc_id, x, unnest(b.positions) AS y FROM (SELECT doc_id, unnest(positions) AS x FROM ix WHERE term = 'ing') a JOIN ix b ON a.doc_id = b.doc_id AND b.term = 'tion') GROUP BY doc_id HAVING distance <= 5")
def index_near(spark, d):
    return index.near(saved(spark, d).words(["ing", "tion"]), "ing", "tion")


@query(f"WITH {_D}, {_INDEX}, {_N}, new AS (SELECT doc_id, unnest(tokens) AS term FROM b) SELECT term, doc_id, frequency FROM ix WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT term, doc_id, count(*) FROM new GROUP BY ALL")
def upsert_postings(spark, d):
    return index.upsert(indexed(spark, d), index.build(notes(spark, d))).select("term", "doc_id", "frequency")


@query(f"WITH {_D}, {_INDEX}, {_N}, new AS (SELECT doc_id, unnest(tokens) AS term FROM b) SELECT term, doc_id, frequency FROM ix WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT term, doc_id, count(*) FROM new GROUP BY ALL")
def upsert_saved(spark, d):
    """The same in a saved index: the notes' postings in place of those of the documents with their ids, whose parts alone are written."""
    table = _table_of(spark, d, "upsert", indexed, _POSTING, again=True)
    table.replace(index.build(notes(spark, d)), notes(spark, d).select("doc_id"))
    return table.rows().select("term", "doc_id", "frequency")


# Quizzes.


@query(f"WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10}, {_SENT} SELECT sent.doc_id, sid, term AS keyword, substr(s, 1, instr(s, term) - 1) || '[____]' || substr(s, instr(s, term) + length(term)) AS question FROM sent JOIN top ON top.doc_id = sent.doc_id AND contains(s, term)")
def mask_keyword(spark, d):
    x = quizzed(spark, d).select("doc_id", F.posexplode("sentences").alias("sid", "s"), "keywords").select("doc_id", "sid", "s", F.explode("keywords").alias("keyword"))
    return x.filter(F.col("s").contains(F.col("keyword"))).select("doc_id", "sid", "keyword", quiz.mask(F.col("s"), F.col("keyword")).alias("question"))


def quizzed(spark, d):
    return topped(said(spark, d))


def _contains(c: str, marks) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"


@query(rf"""WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10}, {_SENT} SELECT sent.doc_id, sid, term AS keyword FROM sent JOIN top ON top.doc_id = sent.doc_id AND contains(s, term)
WHERE length(s) >= 15 AND length(term) * 2 <= length(s) AND NOT {_contains('s', quiz.ANSWER_KEYS)} AND NOT {_contains('s', quiz.CODE_BLANK)} AND len(string_split(s, ' - ')) < 4
AND NOT regexp_matches(s, '\s+\d+\.?\s*$') AND NOT regexp_matches(s, '\d+[-.]\d+\.?\s*$') AND NOT {_contains('substr(s, 1, 20)', quiz.OPENERS)}""")
def blank_candidates(spark, d):
    x = quizzed(spark, d).select("doc_id", F.posexplode("sentences").alias("sid", "s"), "keywords").select("doc_id", "sid", "s", F.explode("keywords").alias("keyword"))
    return x.filter(quiz.fits_blank(F.col("s"), F.col("keyword"))).select("doc_id", "sid", "keyword")


@query()
def blank_quiz(spark, d):
    return quiz.blank_quizzes(quizzed(spark, d))


LECTURE = (
    "응집력은 모듈 내부 요소들이 서로 관련된 정도를 나타내는 개념이다.", "결합도는 모듈 사이의 상호 의존 정도를 나타내는 개념이다.", "정보 은닉은 모듈 내부의 세부 내용을 숨기는 설계 원리이다.",
    "소프트웨어 공학은 품질 좋은 소프트웨어를 경제적으로 만드는 학문이다.", "추상화는 복잡한 문제에서 중요한 부분만 드러내는 방법이다.", "효과는 유지보수가 쉬워지고 비용이 줄어드는 것이다.", "다음을 보고 알맞은 답을 고르시오.",
)
LECTURE_WORDS = ("응집력", "결합도", "정보 은닉", "소프트웨어", "추상화", "모듈")


@query()
def ox_quiz_inline(spark, d):
    rows = spark.createDataFrame([(i, list(LECTURE), list(LECTURE_WORDS)) for i in range(1, 4)], "doc_id long, sentences array<string>, keywords array<string>")
    return quiz.ox_quizzes(rows)


#: A sentence that can be asked, and one for each rule that it may break.
OX_SAMPLES = (*LECTURE, "① 모듈화는 시스템을 작은 단위로 나누어 관리하는 방법이다.", "짧은 문장은 묻지 못한다.", "모듈화는 시스템을 작은 단위로 나누는 방법인가요?  ", "정의는 모듈 내부 요소들이 서로 관련된 정도를 말한다.", "모듈화는 시스템을 작은 단위로 나누는 방법이다 12-3", "Cohesion is the degree of relation 정도이다 okay then.",
    "모듈화는 ★★★ ♥♥♥ ♦♦♦ ♣♣♣ ◆◆◆ ●●● 방법이다", "모듈화는시스템을작은 단위로나누어관리하는방법이다.", "정답 : 모듈화는 시스템을 작은 단위로 나누는 방법이다.", "당신이 모듈화를 시스템에 적용하는 방법을 생각해 보자.", "모듈화가 시스템에 주는 영향을 두 가지 이상 서술하시오.", "모듈화는 public 접근자와 함께 시스템을 작게 나누는 방법이다.",
    "모듈화는 myClassName 아니라 MyClass: 형태로 시스템을 나눈다.", "모듈화는 시스템: 단위, 크기 등으로 나누어 관리하는 방법이다.", "3 모듈화는 시스템을 작은 단위로 나누어 관리하는 방법이다.", "모듈화는 가나다라마바사아자차카타파 단위로 나누는 방법이다.")


_FITS_OX = rf"""s AS (SELECT {{KEYS}}r, regexp_replace(trim(r, {_SPACES}), '^[·\-•①②③④⑤⑥⑦⑧⑨⑩() \t]+', '') AS s FROM r), e AS (SELECT *, regexp_replace(s, '\s+\z', '') AS e FROM s)
SELECT {{KEYS}}r AS sentence, length(s) >= 20 AND NOT regexp_matches(e, '[?？]\z') AND NOT regexp_matches(s, '^({'|'.join(quiz.PROPERTIES)})') AND NOT regexp_matches(e, '[\d\-]{{1,5}}[\.\)]?\s*\z')
  AND len(regexp_extract_all(s, '[가-힣]')) >= 6 AND len(regexp_extract_all(s, '[^가-힣A-Za-z0-9\s①②③④⑤⑥⑦⑧⑨⑩]')) / length(s) <= 0.35 AND len(string_split_regex(trim(s, {_SPACES}), '\s+')) >= 3
  AND NOT {_contains('s', quiz.ANSWER_KEYS + quiz.ANSWER_KEYS_SPACED)} AND NOT {_contains('substr(s, 1, 20)', quiz.OPENERS)} AND NOT regexp_matches(s, '^({'|'.join(quiz.OPENERS)})')
  AND NOT regexp_matches(s, '(하시오|쓰시오|설명하시오|구하시오|답하시오|나열하시오|서술하시오)[.。]?\s*\z') AND NOT {_contains('s', quiz.CODE_OX)} AND NOT regexp_matches(s, '[A-Z][a-z]+[A-Z][\w가-힣]*:')
  AND NOT regexp_matches(s, '[\w가-힣]+\s*:\s+[\w가-힣]+,\s*[\w가-힣]+') AND NOT regexp_matches(s, '^\s*\d') AND NOT regexp_matches(s, '[가-힣]{{12,}}') AS fits"""


@query("WITH r(r) AS (VALUES " + ", ".join(f"('{x}')" for x in OX_SAMPLES) + f"), {_FITS_OX.replace('{KEYS}', '')} FROM e")
def ox_candidates_inline(spark, d):
    return spark.createDataFrame([(s,) for s in OX_SAMPLES], "sentence string").select("sentence", quiz.fits_ox(F.col("sentence")).alias("fits"))


_ANSWERS = "SELECT a.conv_id, a.turn, a.text AS given, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(f"SELECT conv_id, turn, replace(lower(trim(given, {_SPACES})), ' ', '') = replace(lower(trim(answer, {_SPACES})), ' ', '') AS is_correct FROM ({_ANSWERS})")
def grade_answers(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", quiz.is_correct(F.lit("blank"), F.col("answer"), F.col("text")).alias("is_correct"))


@query("SELECT source AS session_id, count(*) AS total, count(*) FILTER (quality = 1) AS correct, count(*) - count(*) FILTER (quality = 1) AS wrong_count, round(count(*) FILTER (quality = 1) / count(*), 6) AS accuracy, coalesce(len(list(DISTINCT lang) FILTER (quality <> 1)), 0)::INTEGER AS n_wrong FROM labels JOIN documents USING (doc_id) GROUP BY source")
def session_score(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    graded = quiz.grade_session(x.select(F.col("source").alias("session_id"), F.col("lang").alias("keyword"), (F.col("quality") == 1).alias("is_correct")))
    return graded.select("session_id", "total", "correct", "wrong_count", "accuracy", F.greatest(F.size("wrong_keywords"), F.lit(0)).alias("n_wrong"))


# Korean: the documents' own texts, each small letter written as a syllable. Capitals stay, so that texts are mixed.

SYLLABLES = "가넌다림마반사은재차칸타팔하거녹더련머벗서엄저청커튼"
_KOREAN_DOCS = f"(SELECT doc_id, source, translate(text, 'abcdefghijklmnopqrstuvwxyz', '{SYLLABLES}') AS text FROM documents)"
_KD = _tok(_KOREAN_DOCS, "doc_id", "d", ", source AS subject")


def korean_docs(spark, d):
    texts = spread(table(spark, d, "documents").select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", SYLLABLES).alias("text"), F.col("source").alias("subject")))
    return tokened(texts)


@query(f"SELECT doc_id, translate(translate(text, '{t.NARROW.replace(chr(39), chr(39) * 2)}', '{t.WIDE.replace(chr(39), chr(39) * 2)}'), '{t.WIDE.replace(chr(39), chr(39) * 2)}', '{t.NARROW.replace(chr(39), chr(39) * 2)}') AS narrow FROM documents")
def fullwidth_docs(spark, d):
    """Texts written in full-width characters, made narrow again."""
    return table(spark, d, "documents").select("doc_id", t.narrow(F.translate("text", t.NARROW, t.WIDE)).alias("narrow"))


@query(f"WITH {_KD} SELECT doc_id, normal, language, array_to_string(tokens, ' ') AS tokens FROM d")
def tokenize_ko(spark, d):
    return korean_docs(spark, d).select("doc_id", "normal", "language", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {_KD}, w AS (SELECT DISTINCT unnest(tokens) AS word FROM d)
SELECT word, CASE WHEN unicode(right(word, 1)) < 44032 OR (unicode(right(word, 1)) - 44032) % 28 > 0 THEN '은' ELSE '는' END AS particle FROM w""")
def particles_ko(spark, d):
    words = tfidf.distinct_words(korean_docs(spark, d))
    return words.select("word", t.particle(F.col("word")).alias("particle"))


#: Sentences of these texts, numbered.
_KS = rf"ks AS (SELECT doc_id, (generate_subscripts(x, 1) - 1)::INTEGER AS idx, unnest(x) AS r FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(normal, '[.]\s|\n'), lambda p: trim(p, {_SPACES})), lambda p: p <> '') AS x FROM dl))"


def korean_sentences(spark, d):
    parts = F.filter(F.transform(F.split("normal", r"[.]\s|\n", -1), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r"))), lambda p: p != "")
    return korean_docs(spark, d).select("doc_id", F.posexplode(parts).alias("idx", "r"))


@query(f"WITH {_KD}, {_KS}, r AS (SELECT * FROM ks), {_FITS_OX.replace('{KEYS}', 'doc_id, idx, ')} FROM e")
def ox_candidates(spark, d):
    return korean_sentences(spark, d).select("doc_id", "idx", F.col("r").alias("sentence"), quiz.fits_ox(F.col("r")).alias("fits"))


@query()
def ox_quiz(spark, d):
    """True or false questions over these texts and their own keywords."""
    rows = korean_docs(spark, d)
    parts = F.filter(F.transform(F.split("normal", r"[.]\s|\n", -1), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r"))), lambda p: p != "")
    return quiz.ox_quizzes(topped(rows.withColumn("sentences", t.pinned(parts))))


#: Every third of them as a row of a table: a number, an English name and what it means.
_ROWS = "CASE WHEN idx % 3 = 1 THEN idx || ' Term ' || r ELSE r END"


@query(rf"""WITH {_KD}, {_KS}, p AS (SELECT doc_id, idx, {_ROWS} AS p FROM ks), w AS (SELECT *, string_split(regexp_replace(p, '\s+', ' ', 'g'), ' ') AS w FROM p),
s AS (SELECT doc_id, idx, p, len(w) AS n, w[1] AS a, w[2] AS b, array_to_string(w[2:], ' ') AS one, array_to_string(w[3:], ' ') AS two FROM w WHERE regexp_matches(p, '^(?:[가-힣]{{2,6}}|[0-9]+)\s') AND len(w) >= 3),
x AS (SELECT doc_id, idx, CASE WHEN regexp_matches(a, '^[가-힣]{{2,6}}$') AND NOT list_contains({_list(WEAK_SUBJECTS)}, a)
    THEN CASE WHEN length(one) >= 8 AND regexp_matches(one, '[가-힣]{{3}}') THEN a || CASE WHEN (unicode(right(a, 1)) - 44032) % 28 > 0 THEN '은' ELSE '는' END || ' ' || one || '.' END
  WHEN regexp_matches(a, '^[0-9]+$') AND n >= 4 AND regexp_matches(b, '^[A-Za-z]{{3,20}}$') THEN CASE WHEN length(two) >= 8 AND regexp_matches(two, '[가-힣]{{3}}') THEN b || '은(는) ' || two || '.' END END AS sentence FROM s)
SELECT doc_id, idx, sentence FROM x WHERE length(sentence) BETWEEN 20 AND 150""")
def table_rows_ko(spark, d):
    row = F.when(F.col("idx") % 3 == 1, F.concat("idx", F.lit(" Term "), "r")).otherwise(F.col("r"))
    return korean_sentences(spark, d).select("doc_id", "idx", sentences.table_sentence(row).alias("sentence")).filter("sentence IS NOT NULL")


#: Some of them as headings and as circled items.
_OUTLINE = "CASE idx % 5 WHEN 0 THEN (idx + 1) || '. ' || substr(r, 1, 40) WHEN 1 THEN r WHEN 2 THEN '① ' || r ELSE '② ' || r END"


@query(rf"""WITH {_KD}, {_KS}, l AS (SELECT doc_id, idx, {_OUTLINE} AS line FROM ks),
h AS (SELECT *, CASE WHEN length(line) <= 80 AND NOT contains(line, ':') AND regexp_matches(line, '^\d[\d\-\.]*[\.\s]+') AND regexp_matches(line, '[가-힣]{{2}}') THEN substr(trim(regexp_replace(line, '^\d[\d\-\.]*[\.\s]+', ''), {_SPACES}), 1, 30) END AS h FROM l),
s AS (SELECT doc_id, idx, line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM h)
SELECT doc_id, idx, section, CASE WHEN regexp_matches(line, '^[①-⑩]') AND coalesce(section, '') <> '' THEN section || ' ' || line ELSE line END AS titled FROM s""")
def sections_ko(spark, d):
    """Headings carried to the items below them."""
    r, kind = F.col("r"), F.col("idx") % 5
    line = F.when(kind == 0, F.concat(F.col("idx") + 1, F.lit(". "), F.substring(r, 1, 40))).when(kind == 1, r).when(kind == 2, F.concat(F.lit("① "), r)).otherwise(F.concat(F.lit("② "), r))
    return sentences.with_sections(korean_sentences(spark, d).select("doc_id", "idx", line.alias("line"))).select("doc_id", "idx", "section", "titled")


# Scores and reports.


def history_rows(spark, d):
    """Events as score history: a user is a document, an event type a chapter."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("chapter"), F.round(F.least("value", F.lit(100.0)), 2).alias("total_score"), F.col("ts").alias("measured_at"))


_H = "h AS (SELECT event_id AS id, user_id AS doc_id, event_type AS chapter, round(least(value, 100.0), 2) AS total_score, ts AS measured_at FROM events)"
_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query(f"""WITH x AS (SELECT source, count(*) FILTER (quality = 1) AS c, count(*) AS n, avg(toxic) AS t FROM labels JOIN documents USING (doc_id) GROUP BY source),
y AS (SELECT source, round(c / n * 100, 2) AS quiz_score, round(t * 100, 2) AS coverage_score, round(greatest(least(0.6::DOUBLE * (c / n * 100) + 0.3::DOUBLE * t * 100 + 0.1::DOUBLE * 0.5::DOUBLE * 100, 100), 0), 2) AS total_score FROM x)
SELECT *, total_score >= 60 AS passed, {_GRADE.format('total_score')} AS grade FROM y""")
def score_total(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    x = x.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("c"), F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("t"))
    return x.select("source", scores.score(F.col("c"), F.col("n"), F.col("t"), F.lit(0.5)).alias("s")).select("source", "s.quiz_score", "s.coverage_score", "s.total_score", "s.passed", "s.grade")


@query(f"WITH {_H} SELECT id, {_GRADE.format('total_score')} AS grade, CASE WHEN total_score >= 60 THEN 'ok' WHEN total_score >= 40 THEN 'warn' ELSE 'danger' END AS band FROM h")
def grade_band(spark, d):
    return history_rows(spark, d).select("id", scores.grade(F.col("total_score")).alias("grade"), scores.band(F.col("total_score")).alias("band"))


_STATS = f"""WITH {_H}, a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
s AS (SELECT source, round(avg(total_score), 1) AS avg_score FROM h JOIN documents USING (doc_id) GROUP BY source)
SELECT source AS subject, a.n AS document_count, coalesce(q.n, 0) AS quiz_count, coalesce(avg_score, 0.0) AS avg_score FROM a LEFT JOIN q USING (source) LEFT JOIN s USING (source)"""


@query(_STATS)
def subject_stats(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("subject"))
    return scores.subject_stats(x, table(spark, d, "labels").select("doc_id"), history_rows(spark, d))


@query(f"WITH {_H} SELECT id, doc_id, chapter, total_score, measured_at FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY measured_at DESC, id DESC) = 1")
def latest_score(spark, d):
    return scores.latest(history_rows(spark, d))


@query(f"WITH {_H} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY measured_at, id)::INTEGER AS place, strftime(measured_at, '%m/%d %H:%M') AS label, total_score, total_score >= 60 AS passed, CASE WHEN total_score >= 60 THEN 'ok' WHEN total_score >= 40 THEN 'warn' ELSE 'danger' END AS band FROM h")
def score_history(spark, d):
    return scores.history(history_rows(spark, d))


@query(f"WITH {_H}, a AS (SELECT doc_id, chapter, round(round(avg(total_score), 6), 1) AS avg_score FROM h GROUP BY ALL) SELECT doc_id, chapter, substr(chapter, 1, 12) AS label, avg_score FROM a QUALIFY count(*) OVER (PARTITION BY doc_id) > 1")
def chapter_avg(spark, d):
    return scores.chapter_averages(history_rows(spark, d))


def reported(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"))
    h = history_rows(spark, d).select("*", F.col("total_score").alias("quiz_score"), F.lit(0.0).alias("coverage_score"), F.lit(0.0).alias("keyword_density"), F.array("chapter").alias("missing_concepts"))
    return scores.document_report(x, h)


@query(f"""WITH {_H}, s AS (SELECT doc_id, count(*) AS n, max(total_score) AS best, round(avg(total_score), 1) AS av FROM h GROUP BY doc_id), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY measured_at DESC, id DESC) = 1)
SELECT d.doc_id, 'doc ' || d.doc_id AS title, coalesce(n, 0) AS session_count, coalesce(best, 0.0) AS best_score, coalesce(av, 0.0) AS avg_score, coalesce(total_score, 0.0) AS total_score, coalesce(total_score >= 60, false) AS passed,
CASE WHEN n IS NULL THEN 'F' ELSE {_GRADE.format('total_score')} END AS grade FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)""")
def doc_report(spark, d):
    return reported(spark, d).select("doc_id", "title", "session_count", "best_score", "avg_score", "total_score", "passed", "grade")


@query(f"""WITH {_H}, s AS (SELECT doc_id, count(*) AS n, max(total_score) AS best, round(avg(total_score), 1) AS av FROM h GROUP BY doc_id), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY measured_at DESC, id DESC) = 1)
SELECT d.doc_id, 'doc ' || d.doc_id AS title, coalesce(n, 0) AS session_count, coalesce(best, 0.0) AS best_score, coalesce(av, 0.0) AS avg_score, coalesce(total_score, 0.0) AS total_score, coalesce(total_score >= 60, false) AS passed,
CASE WHEN n IS NULL THEN 'F' ELSE {_GRADE.format('total_score')} END AS grade FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)""")
def live_report(spark, d):
    """doc_report from a stream of the same events, by state."""
    path = f"{d}/events.parque[t]"  # a pattern: a stream takes a folder or a pattern, and the table may be one file
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(path)
    stream = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.round(F.least("value", F.lit(100.0)), 2).alias("total_score"), F.col("ts").alias("measured_at"))
    root = f"{shared_dir(spark)}/inkwell-live-{uuid.uuid4().hex}"
    live.keep_live(stream, f"{root}/rows", f"{root}/state").awaitTermination()
    titles = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"))
    out = titles.join(live.read_live(spark, f"{root}/rows"), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_score", "avg_score", "total_score")]
    return out.select("doc_id", "title", F.coalesce("session_count", F.lit(0).cast("long")).alias("session_count"), *zero, F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("grade", F.lit("F")).alias("grade"))


@query(f"""WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10}, {_H}, l AS (SELECT doc_id, chapter FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY measured_at DESC, id DESC) = 1),
k AS (SELECT top.doc_id, count(*) AS n, count(*) FILTER (l.chapter IS NULL OR term <> l.chapter) AS covered_count, max(CASE WHEN l.chapter IS NULL THEN 0 ELSE 1 END)::BIGINT AS missing_count FROM top LEFT JOIN l USING (doc_id) WHERE rank <> 3 GROUP BY top.doc_id)
SELECT doc_id, covered_count, missing_count, greatest(n - covered_count - missing_count, 0)::BIGINT AS partial_count, CASE WHEN missing_count > 0 THEN round(covered_count / n * 100, 2) ELSE 0.0 END AS coverage_score FROM k""")
def report_coverage(spark, d):
    out = scores.keyword_coverage(reported(spark, d), keyword_rows(spark, d))
    return out.filter("covered_count IS NOT NULL").select("doc_id", "covered_count", "missing_count", "partial_count", "coverage_score")


@query(f"{_COV}, g AS (SELECT doc_id, status AS part, count(*) AS n FROM st GROUP BY ALL) SELECT doc_id, part, n, round(coalesce(sum(n) FILTER (part = 'covered') OVER (PARTITION BY doc_id), 0) / sum(n) OVER (PARTITION BY doc_id) * 100, 1) AS pct FROM g")
def donut(spark, d):
    c = covered(spark, d).select("doc_id", t.pinned(similarity.coverage(F.col("keywords"), F.col("note"))).alias("c"))
    return scores.donut(c.select("doc_id", *[F.size(f"c.{k}").cast("long").alias(f"{k}_count") for k in ("covered", "partial", "missing")]))


@query(f"""WITH {_H}, s AS (SELECT doc_id, count(*) AS n, max(total_score) AS best FROM h GROUP BY doc_id), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY measured_at DESC, id DESC) = 1),
r AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(best, 0.0) AS best, coalesce(total_score, 0.0) AS total FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)),
c AS (SELECT doc_id, unnest([
  {{'card': '최종 점수', 'shown': CASE WHEN n > 0 THEN round(total::DECIMAL(18, 2), 0)::BIGINT || '점 (' || {_GRADE.format('total')} || ')' ELSE '--' END, 'v': total, 'low': 'danger'}},
  {{'card': '퀴즈 점수', 'shown': CASE WHEN n > 0 THEN round(total::DECIMAL(18, 2), 0)::BIGINT || '점' ELSE '--' END, 'v': total, 'low': 'danger'}},
  {{'card': '커버리지', 'shown': CASE WHEN n > 0 THEN '0점' ELSE '--' END, 'v': 0.0::DOUBLE, 'low': 'warn'}},
  {{'card': '키워드 밀도', 'shown': CASE WHEN n > 0 THEN '0점' ELSE '--' END, 'v': 0.0::DOUBLE, 'low': 'warn'}},
  {{'card': '총 세션', 'shown': n || '회', 'v': 100.0::DOUBLE, 'low': 'danger'}},
  {{'card': '최고 점수', 'shown': CASE WHEN n > 0 THEN round(best::DECIMAL(18, 2), 0)::BIGINT || '점' ELSE '--' END, 'v': best, 'low': 'danger'}}]) AS x FROM r)
SELECT doc_id, x.card AS card, x.shown AS shown, CASE WHEN x.v >= 60 THEN 'ok' ELSE x.low END AS band FROM c""")
def score_cards(spark, d):
    return scores.cards(reported(spark, d))


@query(f"WITH {_H} SELECT coalesce(strftime(measured_at, '%Y-%m-%d %H:%M'), '-') AS date, 'doc ' || doc_id AS title, round(total_score::DECIMAL(18, 2), 1) || '점' AS score, CASE WHEN total_score >= 60 THEN '통과' ELSE '미통과' END AS passed, 1 AS missing_count FROM h JOIN documents USING (doc_id)")
def score_listing(spark, d):
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"))
    return scores.score_listing(history_rows(spark, d).select("*", F.col("doc_id").alias("document_id"), F.array("chapter").alias("missing_concepts")), titles)


@query(f"SELECT *, CASE WHEN avg_score >= 60 THEN 'ok' WHEN avg_score >= 40 THEN 'warn' ELSE 'danger' END AS band FROM ({_STATS})")
def subject_dashboard(spark, d):
    return scores.dashboard(subject_stats(spark, d))


@query()
def refined_sentences(spark, d):
    x = said(spark, d)
    return x.select("doc_id", F.posexplode_outer(t.pinned(sentences.refine(F.col("sentences")))).alias("sid", "sentence"))


# Store.


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def delete_cascade(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    refers = {"orders": [("customer", "o_custkey")], "lineitem": [("orders", "l_orderkey")]}
    gone = tables["customer"].filter("c_acctbal < 0").select("c_custkey")
    after = store.cascade(tables, "customer", gone, keys, refers)
    out = None
    for n, df in after.items():
        one = df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_D}, {_counts('d', 'c')}, {_SINGLE}, {_TOP10} SELECT doc_id, term AS word FROM top WHERE rank = 5")
def clear_auto_keywords(spark, d):
    return keyword_rows(spark, d).filter("is_user_added").select("doc_id", "word")


# Pages.

def line_pages(spark, d):
    """Lines of documents as pages: (doc_id, page_num, text, font_sizes), short ones in large letters."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    large = F.array(F.lit(15.0), F.lit(13.0))
    return lines.select("doc_id", (F.col("pos") + 1).alias("page_num"), "text", F.when(F.length("text") <= 30, large).otherwise(F.array(F.lit(10.0))).alias("font_sizes"))


_PAGES = rf"""p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS page_num FROM documents),
hp AS (SELECT *, list_avg(CASE WHEN length(text) <= 30 THEN [15.0::DOUBLE, 13.0] ELSE [10.0::DOUBLE] END) >= {chapters.HEADING_SIZE} AS heading, trim(text, {_SPACES}) AS first FROM p),
tp AS (SELECT *, CASE WHEN first <> '' AND (length(first) <= 80 AND ({" OR ".join(f"regexp_matches(first, '{x}')" for x in chapters.TITLES)}) OR heading AND length(first) <= 50) THEN first END AS title FROM hp),
np AS (SELECT *, title IS NOT NULL AND page_num > 1 AS starts FROM tp),
cp AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_num)::INTEGER AS chapter_idx FROM np)"""


@query(f"WITH {_PAGES} SELECT doc_id, chapter_idx, coalesce(max(title) FILTER (starts), '서론') AS title, min(page_num) AS start_page, max(page_num) AS end_page, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM cp GROUP BY doc_id, chapter_idx")
def chapter_split(spark, d):
    return chapters.chapters(line_pages(spark, d)).withColumn("chapter_idx", F.col("chapter_idx").cast("int"))


_CHAPTERS = _tok("(SELECT doc_id, chapter_idx, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM cp GROUP BY doc_id, chapter_idx)", "doc_id", "c", ", chapter_idx")


@query(f"WITH {_PAGES}, {_CHAPTERS} SELECT doc_id, chapter_idx, language, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS token_count, len(list_distinct(tokens))::INTEGER AS unique_token_count FROM c")
def chapter_tokens(spark, d):
    """Each chapter processed by itself."""
    done = analysis.process_chapters(line_pages(spark, d))
    return done.select("doc_id", F.col("chapter_idx").cast("int").alias("chapter_idx"), "language", F.array_join("tokens", " ").alias("tokens"), "token_count", "unique_token_count")


@query(f"WITH {_PAGES} SELECT doc_id, page_num, heading, title FROM tp")
def heading_flag(spark, d):
    p = line_pages(spark, d)
    return p.select("doc_id", "page_num", chapters.is_heading(F.col("font_sizes")).alias("heading"), chapters.title(F.col("text"), chapters.is_heading(F.col("font_sizes"))).alias("title"))


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id")
def full_text(spark, d):
    return chapters.full_text(line_pages(spark, d))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)\f|^\s*\d+\s*$|^\s*[-–—]{{3,}}\s*$', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '-\n(\S)', '\1', 'g'), {_SPACES}) AS text FROM documents")
def clean_page(spark, d):
    return table(spark, d, "documents").select("doc_id", chapters.clean_page(F.col("text")).alias("text"))


LAYOUT = ("1. 응집력(Cohesion)", "등급 이름 설명 예시 평가", "7  Functional  모든 요소가 하나의 기능을 수행  계산기  최상", "6  Sequential  출력이 다음 입력이 됨  변환기  좋음", "연속된 흐름", "", "결합도  모듈 사이의 상호 의존 정도")


@query()
def table_sentences_inline(spark, d):
    rows = [(k, 1, i, s) for k in (1, 2) for i, s in enumerate(LAYOUT)]
    return layout.table_sentences(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
