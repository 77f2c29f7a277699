"""The relational store: eight tables as Parquet folders, and one list of the folders that count.

A change writes its rows to folders of their own, then swaps in a new list that
names them: all tables of a change turn over at once, and a failed change
leaves everything as it was. New rows are appended as a folder; changed and
deleted ones make a new version of their table. Deletes cascade along the
foreign keys. One writer at a time is assumed; readers need no lock.

Postings are not among these folders: they are a TermTable, changed by document
and searched by term. They follow a change once it has turned over; postings of
a document that has gone are not found by searches that name documents.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .term_table import TermTable

# Tables and their columns.
SCHEMAS = {
    "subjects": "id long, name string, description string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "documents": "id long, subject_id long, title string, source_type string, language string, file_path string, content string, page_count int, char_count int, created_at timestamp_ntz",
    "keywords": "id long, document_id long, word string, tfidf_score double, textrank_score double, frequency int, is_user_added boolean, is_user_removed boolean, created_at timestamp_ntz",
    "inverted_index": "id long, word string, document_id long, frequency int, positions array<int>",
    "quizzes": "id long, document_id long, quiz_type string, question string, answer string, context string, keyword string, created_at timestamp_ntz",
    "quiz_sessions": "id long, document_id long, total_questions int, correct_count int, score double, completed boolean, started_at timestamp_ntz, completed_at timestamp_ntz",
    "quiz_results": "id long, session_id long, quiz_id long, user_answer string, is_correct boolean, answered_at timestamp_ntz",
    "comprehension_scores": "id long, document_id long, chapter string, quiz_score double, coverage_score double, keyword_density double, total_score double, missing_concepts array<string>, measured_at timestamp_ntz",
}
#: Table: (table it refers to, column). A row goes with the row it refers to.
REFERS = {
    "documents": [("subjects", "subject_id")],
    "keywords": [("documents", "document_id")],
    "inverted_index": [("documents", "document_id")],
    "quizzes": [("documents", "document_id")],
    "quiz_sessions": [("documents", "document_id")],
    "quiz_results": [("quiz_sessions", "session_id"), ("quizzes", "quiz_id")],
    "comprehension_scores": [("documents", "document_id")],
}
#: The table that is kept as a TermTable.
POSTINGS = "inverted_index"
DOMAINS = {("documents", "source_type"): ("pdf", "txt", "text"), ("documents", "language"): ("ko", "en"), ("quizzes", "quiz_type"): ("blank", "ox")}
DEFAULTS = {"description": "", "language": "ko", "char_count": 0, "frequency": 1, "is_user_added": False, "is_user_removed": False, "total_questions": 0, "correct_count": 0, "score": 0.0, "completed": False, "chapter": "전체", "tfidf_score": 0.0, "textrank_score": 0.0}
STAMPS = ("created_at", "updated_at", "started_at", "answered_at", "measured_at")


def parse_time(c: Column) -> Column:
    """ISO text as a timestamp; null if blank or malformed."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def decode(table: str, rows: DataFrame) -> DataFrame:
    """Rows of text, as they lie outside, in a table's types: 0 and 1 as booleans, ISO times, JSON lists, numbers.

    What cannot be read, and a value outside its column's domain, becomes null; columns that are missing are null, others are left out.
    """
    out = []
    for f in T._parse_datatype_string(SCHEMAS[table]).fields:
        kind = f.dataType
        c = F.col(f.name).cast("string") if f.name in rows.columns else F.lit(None).cast("string")
        if isinstance(kind, T.BooleanType):
            c = F.when(F.trim(c).isin("1", "true"), True).when(F.trim(c).isin("0", "false"), False)
        elif isinstance(kind, T.TimestampNTZType):
            c = parse_time(c)
        elif isinstance(kind, T.ArrayType):
            c = F.from_json(c, kind)
        elif not isinstance(kind, T.StringType):
            c = c.try_cast(kind)
        elif (table, f.name) in DOMAINS:
            c = F.when(c.isin(*DOMAINS[table, f.name]), c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def cascade(tables: dict[str, DataFrame], table: str, gone: DataFrame, key: dict[str, str] | None = None, refers: dict | None = None) -> dict[str, DataFrame]:
    """tables without the rows of table whose key is in gone, and without all rows that refer to them, by anti joins down the references."""
    refers = REFERS if refers is None else refers
    key = key or {}
    out, left = dict(tables), {}
    out[table] = tables[table].join(gone, key.get(table, "id"), "left_anti")
    left[table] = gone
    for child, parents in refers.items():
        if child not in tables:
            continue
        rows = tables[child]
        for parent, column in parents:
            if parent in left:
                ids = left[parent].toDF(column)
                lost = rows.join(ids, column, "left_semi").select(key.get(child, "id"))
                left[child] = left[child].union(lost) if child in left else lost
        if child in left:
            out[child] = rows.join(left[child].distinct(), key.get(child, "id"), "left_anti").select(*rows.columns)
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):  # a second start finds the tables and changes nothing
            self._publish({table: [] for table in SCHEMAS if table != POSTINGS}, {})
        self.index = TermTable(spark, f"{self.root}/{POSTINGS}")

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _folders(self) -> dict[str, list[str]]:
        source = self._fs.open(self._path(f"{self.root}/CURRENT"))
        text = bytes(source.readAllBytes()).decode()
        source.close()
        return json.loads(text)

    def _publish(self, changes: dict[str, list[str]], before: dict[str, list[str]]) -> None:
        """The folders of some tables, in place of those that before names, by one rename."""
        new, current = self._path(f"{self.root}/{uuid.uuid4().hex}.new"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(new, True)
        out.write(json.dumps(before | changes).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        replace = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, current, replace)

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMAS[table])]).write.parquet(f"{self.root}/{folder}")
        return folder

    def read(self, table: str) -> DataFrame:
        if table == POSTINGS:  # ids follow from what they name
            rows = self.index.rows()
            return rows.select(F.xxhash64("doc_id", "term").alias("id"), F.col("term").alias("word"), F.col("doc_id").alias("document_id"), F.col("frequency").cast("int").alias("frequency"), "positions")
        folders = self._folders()[table]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{x}" for x in folders])

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """New versions of several tables, which turn over together."""
        before = self._folders()
        self._publish({table: [self._write(table, df)] for table, df in tables.items()}, before)

    def compact(self, table: str) -> None:
        """One folder in place of those that inserts have left."""
        self.write_all({table: self.read(table)})

    def _check(self, table: str, df: DataFrame) -> None:
        for (t, column), domain in DOMAINS.items():
            if t == table and column in df.columns and not df.filter(~F.col(column).isin(*domain)).isEmpty():
                raise ValueError(f"{table}.{column} must be one of {domain}")
        if table == "subjects" and not df.filter(F.coalesce(F.trim("name"), F.lit("")) == "").isEmpty():
            raise ValueError("a subject needs a name")

    def _frame(self, table: str, rows: DataFrame | list[dict], ids: Column | None = None) -> DataFrame:
        """rows with defaults and times, without ids unless they have them."""
        fields = T._parse_datatype_string(SCHEMAS[table]).fields
        if isinstance(rows, list):
            given = set().union(*rows)
            if unknown := given - {f.name for f in fields}:
                raise ValueError(f"{table} has no {', '.join(sorted(unknown))}")
            names = [f for f in fields if f.name in given]
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in names) for r in rows], T.StructType(names))
        self._check(table, rows)
        now = F.lit(datetime.now().replace(microsecond=0)).cast("timestamp_ntz")
        for f in fields:
            if f.name == "id":
                continue
            if f.name not in rows.columns:
                default = now if f.name in STAMPS else F.lit(DEFAULTS.get(f.name))
                rows = rows.withColumn(f.name, default.cast(f.dataType))
            elif f.name in STAMPS:
                rows = rows.withColumn(f.name, F.coalesce(f.name, now))
            elif f.name in DEFAULTS:
                rows = rows.withColumn(f.name, F.coalesce(f.name, F.lit(DEFAULTS[f.name])))
        if table == "documents":
            rows = rows.withColumn("char_count", F.length(F.coalesce("content", F.lit(""))))
        for name in ("name", "word"):
            if name in rows.columns:
                rows = rows.withColumn(name, F.trim(name))
        return rows if ids is not None else rows.drop("id")

    def _numbered(self, table: str, rows: DataFrame) -> tuple[str, int]:
        """The folder of new rows with ids, and how many they are. Rows are written before they are numbered, so that numbers and rows cannot part."""
        numbered, n, stage = self._with_ids(table, rows)
        folder = self._write(table, numbered)
        self._fs.delete(self._path(stage), True)
        return folder, n

    def with_ids(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with the ids that an insert would give them, and all their columns; change(numbered=...) appends them."""
        return self._with_ids(table, rows)[0]

    def _with_ids(self, table: str, rows: DataFrame) -> tuple[DataFrame, int, str]:
        top = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        stage = f"{self.root}/stage-{uuid.uuid4().hex}"
        # Ids follow the order of rows within partitions: no row leaves its partition to be numbered.
        rows.withColumn("_m", F.monotonically_increasing_id()).write.parquet(stage)
        staged = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_m", T.LongType())])).parquet(stage)
        part = F.shiftright("_m", 33).alias("_p")
        counts = {r[0]: r[1] for r in staged.groupBy(part).count().collect()}  # one row a partition of the insert
        n, starts = 0, []
        for p in sorted(counts):
            starts.append((p, n))
            n += counts[p]
        offsets = F.broadcast(self.spark.createDataFrame(starts, "_p long, _from long"))
        numbered = staged.withColumn("_p", part).join(offsets, "_p").withColumn("id", F.lit(top) + F.col("_from") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1)
        return numbered.drop("_p", "_from", "_m"), n, stage

    def change(self, versions: dict[str, DataFrame] | None = None, added: dict[str, DataFrame | list[dict]] | None = None, numbered: dict[str, DataFrame] | None = None) -> dict[str, int]:
        """New versions of tables and rows to append, of one table or several; all turn over at once. numbered rows have their ids, from with_ids. How many rows each added table got."""
        if POSTINGS in {**(versions or {}), **(added or {})}:
            raise ValueError("postings are changed by replace_postings")
        before, changes, n = self._folders(), {}, {}
        for table, df in (versions or {}).items():
            changes[table] = [self._write(table, df)]
        for table, rows in (added or {}).items():
            n[table] = 0
            if not isinstance(rows, list) or rows:
                folder, n[table] = self._numbered(table, self._frame(table, rows))
                changes[table] = changes.get(table, before[table]) + [folder]
        for table, df in (numbered or {}).items():
            changes[table] = changes.get(table, before[table]) + [self._write(table, self._frame(table, df, df["id"]))]
        self._publish(changes, before)
        return n

    def insert(self, table: str, rows: DataFrame | list[dict]) -> int:
        """Append rows with new ids, defaults and times; how many."""
        return self.change(added={table: rows})[table]

    def changed(self, table: str, where: Column, **values: object) -> DataFrame:
        """The table with columns of some rows set; a changed subject is stamped. where and columns among the values are taken from the rows as they were."""
        df = self.read(table)
        if table == "subjects":
            values.setdefault("updated_at", datetime.now().replace(microsecond=0))
        new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
        return df.select(*[F.when(where, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in df.schema.fields])

    def update(self, table: str, where: Column, **values: object) -> None:
        df = self.changed(table, where, **values)
        self._check(table, df)
        self.write_all({table: df})

    def delete(self, table: str, where: Column) -> None:
        """Delete rows and all that refer to them."""
        tables = {t: self.read(t) for t in SCHEMAS}
        gone = tables[table].filter(where).select("id")
        after = cascade(tables, table, gone)
        lost = None
        if after[POSTINGS] is not tables[POSTINGS]:
            # Documents that lose postings, and what they have left.
            lost = tables[POSTINGS].join(after[POSTINGS].select("id"), "id", "left_anti").select(F.col("document_id").alias("doc_id")).distinct()
            left = _as_postings(after[POSTINGS]).join(lost, "doc_id", "left_semi")
        self.write_all({t: df for t, df in after.items() if df is not tables[t] and t != POSTINGS})
        if lost is not None:
            self.index.replace(left, lost)

    def of(self, table: str, parent_id: int, newest_first: bool = True) -> DataFrame:
        """Rows that refer to one row of their parent (the first in REFERS), as listings show them."""
        rows = self.read(table).filter(F.col(REFERS[table][0][1]) == parent_id)
        stamp = next((c for c in STAMPS if c in rows.columns), None)
        return rows.orderBy(F.desc(stamp), F.desc("id")) if stamp and newest_first else rows.orderBy("id")

    def subjects(self) -> DataFrame:
        """All subjects, the newest first."""
        return self.read("subjects").orderBy(F.desc("created_at"), F.desc("id"))

    def quizzes_of(self, document_id: int, kind: str | None = None) -> DataFrame:
        rows = self.of("quizzes", document_id)
        return rows.filter(F.col("quiz_type") == kind) if kind else rows

    def delete_quizzes(self, document_id: int, kind: str | None = None) -> None:
        """A document's questions, of one kind if named, with the results that refer to them."""
        where = F.col("document_id") == document_id
        self.delete("quizzes", where & (F.col("quiz_type") == kind) if kind else where)

    # What the application does with the tables.

    def replace_keywords(self, document_id: int, rows: DataFrame) -> int:
        """New automatic keywords of a document; those a user added stay. Old and new ones change places at once."""
        old = self.read("keywords").filter((F.col("document_id") != document_id) | F.col("is_user_added"))
        return self.change({"keywords": old}, {"keywords": rows.withColumn("document_id", F.lit(document_id))})["keywords"]

    def add_user_keyword(self, document_id: int, word: str) -> int:
        return self.insert("keywords", [{"document_id": document_id, "word": word, "is_user_added": True}])

    def remove_keyword(self, keyword_id: int, removed: bool = True) -> None:
        self.update("keywords", F.col("id") == keyword_id, is_user_removed=removed)

    def keywords_of(self, document_id: int, exclude_removed: bool = True) -> DataFrame:
        df = self.read("keywords").filter(F.col("document_id") == document_id)
        return (df.filter(~F.col("is_user_removed")) if exclude_removed else df).orderBy(F.desc("tfidf_score"), "id")

    def replace_postings(self, rows: DataFrame, documents: DataFrame | None = None) -> int:
        """Postings (word, document_id, frequency, positions) in place of all that their documents had; how many. documents (doc_id) names others that have none any more.

        Only the parts of these documents are written.
        """
        self.index.replace(_as_postings(rows), documents)
        return rows.count()

    def postings(self) -> DataFrame:
        """The saved index as the search operators take it; index.containing(), like() and words() read parts of it."""
        return self.index.rows()

    def complete_session(self, session_id: int, total: int, correct: int, score: float) -> None:
        self.write_all({"quiz_sessions": self.completed(session_id, total, correct, score)})

    def completed(self, session_id: int, total: int, correct: int, score: float) -> DataFrame:
        """The sessions with one of them completed."""
        return self.changed("quiz_sessions", F.col("id") == session_id, total_questions=total, correct_count=correct, score=round(score, 2), completed=True, completed_at=datetime.now().replace(microsecond=0))

    def update_document_content(self, document_id: int, sentences: list[str]) -> None:
        """A document's sentences, edited, as its content."""
        text = "\n".join(sentences)
        self.update("documents", F.col("id") == document_id, content=text, char_count=len(text))


def _as_postings(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("word").alias("term"), F.col("document_id").alias("doc_id"), "frequency", "positions")


def edit_sentences(c: Column, add: list[str] = (), replace: dict[int, str] | None = None, delete: set[int] = frozenset()) -> Column:
    """Sentences with some replaced, deleted (places from 0) and added at the end."""
    for i, s in (replace or {}).items():
        c = F.concat(F.slice(c, 1, i), F.array(F.lit(s)), F.slice(c, i + 2, 1 << 30))
    for i in sorted(delete, reverse=True):
        c = F.concat(F.slice(c, 1, i), F.slice(c, i + 2, 1 << 30))
    return F.concat(c, F.array(*map(F.lit, add)).cast("array<string>")) if add else c
