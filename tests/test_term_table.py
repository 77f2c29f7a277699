"""Saved postings: searches against all rows, and what a change and a search touch."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from inkwell.functions.shared import kept
from inkwell.operators import index
from inkwell.operators.term_table import TermTable

SCHEMA = "term string, doc_id long, frequency long, positions array<int>"


@pytest.fixture
def rows():
    rng = random.Random(8)
    part = lambda: rng.choice(["co", "hes", "ION", "응집", "력", "%", "a_b", "é", "1", "x"])
    terms = {"".join(part() for _ in range(rng.randint(1, 4))) for _ in range(120)}
    return [(t, d, f := rng.randint(1, 9), list(range(f))) for d in range(40) for t in rng.sample(sorted(terms), 12)]


@pytest.fixture
def table(spark, tmp_path, rows):
    t = TermTable(spark, str(tmp_path / "t"), parts=5, buckets=7)
    t.replace(spark.createDataFrame(rows, SCHEMA))
    return t


def files(table):
    return {str(p): p.stat().st_mtime_ns for p in Path(table.root, "rows").rglob("*.parquet")}


def as_set(df):
    return sorted((r.term, r.doc_id, r.frequency, tuple(r.positions)) for r in df.collect())


def plain(rows):
    return sorted((t, d, f, tuple(p)) for t, d, f, p in rows)


def like(term, query):
    """term ILIKE %query%, in which _ stands for any character and % for any number of them."""
    term, query = term.lower(), query.lower()
    reach = set(range(len(term) + 1))
    for c in query:
        reach = {j for i in reach for j in range(i, len(term) + 1)} if c == "%" else {i + 1 for i in reach if i < len(term) and c in ("_", term[i])}
    return bool(reach)


def test_searches_equal_all_rows(spark, table, rows):
    assert as_set(table.rows()) == plain(rows)
    for q in ("cohes", "HES", "ion", "응집력", "co", "a", "é", "nothing", " Ion ", "%a_", "집력응집"):
        assert as_set(table.containing(q)) == plain(r for r in rows if q.strip().lower() in r[0].lower()), q
    assert table.containing("  ").count() == 0
    for q in ("hes%ion", "co_", "a_b", "%", "응집", "h_s", "onco"):
        assert as_set(table.like(q)) == plain(r for r in rows if like(r[0], q)), q
    words = [rows[0][0], rows[50][0], "nothing"]
    assert as_set(table.words(words)) == plain(r for r in rows if r[0] in words)
    assert as_set(table.of_documents([3, 7])) == plain(r for r in rows if r[1] in (3, 7))
    found = index.search_saved(table, "hes", limit=5).collect()
    best = sorted((r for r in rows if "hes" in r[0].lower()), key=lambda r: (-r[2], r[0], r[1]))[:5]
    assert [(r.term, r.doc_id, r.frequency) for r in found] == [r[:3] for r in best]


def test_many_terms_are_joined(spark, table, rows, monkeypatch):
    monkeypatch.setattr("inkwell.operators.term_table.NAMED", 2)
    assert as_set(table.containing("co")) == plain(r for r in rows if "co" in r[0].lower())


def test_a_search_reads_its_buckets_alone(spark, table, rows):
    word = rows[0][0]
    for found in (table.words([word]), table.containing(word)):
        plan = found._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_one_document_changes_one_part(spark, table, rows):
    before = files(table)
    new = [("neu", 3, 1, [0]), ("Cohesion", 3, 2, [1, 2])]
    table.replace(spark.createDataFrame(new, SCHEMA))
    after = files(table)
    touched = {p.split("part=")[1].split("/")[0] for p in before.keys() ^ after.keys()}
    assert len(touched) == 1 and all(after[p] == before[p] for p in before.keys() & after.keys())
    assert as_set(table.rows()) == plain([r for r in rows if r[1] != 3] + new)
    assert as_set(table.containing("NEU")) == plain(new[:1])
    # An emptied document leaves no rows, and neither do buckets in which its terms stood alone.
    table.remove(spark.createDataFrame([(3,), (4,), (99,)], "doc_id long"))
    assert as_set(table.rows()) == plain(r for r in rows if r[1] not in (3, 4))
    assert table.containing("neu").count() == 0
    table.remove(table.rows().select("doc_id"))
    assert table.rows().count() == 0
    table.clear()
    assert table.containing("co").count() == table.rows().count() == 0
    table.replace(spark.createDataFrame(new + [(None, 5, 1, [0]), ("t", None, 1, [0])], SCHEMA))
    again = TermTable(spark, table.root, parts=2, buckets=2)  # the layout is the table's own
    assert (again.parts, again.buckets) == (5, 7) and as_set(again.rows()) == plain(new)


def test_stream_replaces_files(spark, tmp_path):
    from inkwell.streaming import ingest

    folder, root, state = tmp_path / "in", str(tmp_path / "ix"), str(tmp_path / "cp")
    folder.mkdir()

    def run():
        ingest.index_stream(ingest.read_texts(spark, str(folder)), root, state).awaitTermination(120)
        return sorted((r.term, r.frequency) for r in ingest.read_index(spark, root).collect())

    (folder / "a.txt").write_text("cohesion coupling cohesion")
    (folder / "b.txt").write_text("한글 한글")  # decomposed, as a batch composes it
    assert run() == [("cohesion", 2), ("coupling", 1), ("한글", 2)]
    (folder / "c.txt").write_text("module")
    assert run() == [("cohesion", 2), ("coupling", 1), ("module", 1), ("한글", 2)]
    emptied = spark.createDataFrame([(r.doc_id,) for r in ingest.read_index(spark, root).filter("term = '한글'").collect()], "doc_id long")
    TermTable(spark, root).replace(ingest.read_index(spark, root).limit(0), emptied)
    assert run() == [("cohesion", 2), ("coupling", 1), ("module", 1)]


def test_many_terms_are_found_without_a_join_and_first_rows_written_once(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("inkwell.operators.term_table.NAMED", 2)
    written = []
    monkeypatch.setattr("inkwell.operators.term_table.kept", lambda df, f=kept: written.append(df.columns) or f(df))
    table = TermTable(spark, str(tmp_path / "once"), parts=5, buckets=7)
    table.replace(spark.createDataFrame(rows, SCHEMA))
    assert written == [["term", "bucket"]]  # the terms, not the rows
    for found in (table.containing("co"), table.like("co")):
        assert as_set(found) == plain(r for r in rows if "co" in r[0].lower())
        assert "Join" not in found._jdf.queryExecution().toString()
