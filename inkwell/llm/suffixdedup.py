"""Suffix-array dedup: bytes under strings of 400 bytes that also start elsewhere, and passages shared between documents.

Only suffixes that may repeat are sorted. A cover of positions (see anchors)
has the property that difference covers are used for: two equal strings hold a
covered position at the same distance. A suffix bucket holds all windows around
one covered string of GRAM bytes; buckets with one member go at once. Equal
contexts (all bytes that decide about an anchor's windows) are counted by hash,
so copies never meet as pairs; of each context one stands for all in its
bucket. A bucket is sorted alone: its members are ranked by the bytes right of
the anchor and by those left of it, and the lengths that neighbours in rank
share decide all windows without comparing bytes again. Buckets with very many
different contexts are dealt anew by the strings that 16 neighbouring windows
share, and at last by single windows.

Two lengths are decided on in one pass: LENGTH bytes that start anywhere else
(they are removed), and SHORT bytes that stand in another document too. Where
the latter cover 50 whole words or more, the document shares a passage; such
passages are often shorter than LENGTH and are reported, not removed.

A cover modulo v, as in textbooks, takes 8 to 12 of 100 positions; rows for so
many would not fit the shuffle this operator may use. This one takes 1.2 of 100.

Hashes of contexts have 64 bits and count only within a bucket, itself known
by 64 bits; the sort compares bytes.

Defined results: a null or empty text has no bytes; identical rows are copies
of each other; rows of one id are one document; a null id is an id of its own;
an empty table gives an empty table. Very long texts are cut into overlapping
parts while anchors are sought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .anchors import GRAM, LENGTH, PART, SHORT, anchors
from .common import cut, finished, remove, small_batches

#: Different contexts in a bucket that is sorted at once; larger ones are dealt anew.
LIMIT = 256
#: Neighbouring windows in a bucket of the second kind.
WIDTH = 16
#: Kinds of marks: bytes under a repeated string of LENGTH, and under one of SHORT that another document holds.
AGAIN, SHARED = 0, 1
LENGTHS = {AGAIN: LENGTH, SHARED: SHORT}
#: Whole words in a shared passage, at least.
PASSAGE_WORDS = 50
SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null id.
NO_ID = -(2**63)


def _parts(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in blocks: data, starts, ends, number of the text and offset in it; long texts in overlapping parts."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def block():
        lengths = np.array([len(x) for x, _, _ in held])
        ends = np.cumsum(lengths)
        return b"".join(x for x, _, _ in held), ends - lengths, ends, np.array([i for _, i, _ in held]), np.array([o for _, _, o in held])

    for i, t in enumerate(texts):
        for o in range(0, max(len(t) - SHORT + 1, 0), PART):
            held.append((t[o : o + PART + LENGTH - 1], i, o))
            size += len(held[-1][0])
            if size >= PART:
                yield block()
                held, size = [], 0
    if held:
        yield block()


_ANCHORED = "id long, th long, first long, last long, stop long, at long, ah long, ch long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def anchored(rows: DataFrame) -> DataFrame:
    """Every anchor in rows (id, th, text)."""

    def run(batches):
        for batch in batches:
            ids, ths = batch.column("id"), batch.column("th")
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for data, starts, ends, number, offset in _parts(texts):
                text, *places, ah, ch = anchors(data, starts, ends)
                take, add = pa.array(number[text]), offset[text]
                yield pa.RecordBatch.from_arrays([ids.take(take), ths.take(take), *[pa.array(x + add, pa.int64()) for x in places], pa.array(ah, pa.int64()), pa.array(ch, pa.int64())], _names(_ANCHORED))

    return rows.select("id", "th", "text").mapInArrow(run, _ANCHORED)


def shared(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    a, b = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    return int((a != b).argmax())


def _ranked(strings: list[bytes]) -> np.ndarray:
    """Lengths that strings share with one another: the least of those that neighbours between them in order share."""
    m = len(strings)
    order = np.array(sorted(range(m), key=strings.__getitem__))
    lcp = np.array([shared(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    out = np.zeros((m, m), np.int64)
    for i in range(m - 1):
        out[order[i], order[i + 1 :]] = np.minimum.accumulate(lcp[i:])
    return np.maximum(out, out.T)


Member = tuple[int, int, bytes, int, int]


def resolve(members: list[Member], kinds: tuple[int, ...] = (AGAIN, SHARED)) -> dict[int, list[list[tuple[int, int]]]]:
    """For each kind, runs (least, most) of distances, from window start to anchor, of each member's windows that another member has too.

    Members are (least distance, most distance, bytes from the first window's
    start to the context's end, least id, greatest id); at most LIMIT of them.
    """
    least, most, lo, hi = (np.array([x[i] for x in members]) for i in (0, 1, 3, 4))
    left = _ranked([x[2][: x[1]][::-1] for x in members])
    right = _ranked([x[2][x[1] + GRAM :] for x in members])
    upper = np.minimum(np.minimum(most[:, None], most), left)
    lower = np.maximum(least[:, None], least)
    other = ~np.eye(len(members), dtype=bool)
    apart = other & ((lo[:, None] != lo) | (hi[:, None] != hi) | (lo != hi)[:, None])
    out = {}
    for kind in kinds:
        begin = np.maximum(lower, LENGTHS[kind] - GRAM - right)
        one, two = np.nonzero((begin <= upper) & (apart if kind == SHARED else other))
        found: list[list[tuple[int, int]]] = [[] for _ in members]
        if len(one):
            edges = np.zeros((len(members), int(most.max()) + 2), np.int32)
            np.add.at(edges, (one, begin[one, two]), 1)
            np.add.at(edges, (one, upper[one, two] + 1), -1)
            covered = np.pad(np.cumsum(edges, 1) > 0, ((0, 0), (1, 0)))
            row, at = np.nonzero(covered[:, 1:] != covered[:, :-1])
            for r, a, b in zip(row[::2].tolist(), at[::2].tolist(), at[1::2].tolist(), strict=True):
                found[r].append((a, b - 1))
        out[kind] = found
    return out


_MARKS = "id long, th long, kind int, start long, end long"
_ITEMS = "key long, id long, th long, lo long, hi long, first long, last long, at long, n long, blob binary"


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], _names(schema))


def _rows(batch: pa.RecordBatch, schema: str) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in _names(schema)], strict=True)


def _sorted(items: DataFrame, kinds: tuple[int, ...] = (AGAIN, SHARED)) -> DataFrame:
    """Marks from buckets (key) of items, one bucket after another."""
    dealt = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def run(batches):
        out: list[list[int]] = [[] for _ in _names(_MARKS)]
        key, held = None, []

        def finish():
            if len(held) < 2:
                return
            for kind, runs in resolve([(at - last, at - first, blob, lo, hi) for _, _, _, lo, hi, first, last, at, _, blob in held], kinds).items():
                for (_, i, th, lo, hi, _, _, at, n, _), found in zip(held, runs, strict=True):
                    # Else all windows of its context are marked already.
                    if n == 1 if kind == AGAIN else lo == hi:
                        for a, b in found:
                            for c, v in zip(out, (i, th, kind, at - b, at - a + LENGTHS[kind]), strict=True):
                                c.append(v)

        for batch in batches:
            for row in _rows(batch, _ITEMS):
                if row[0] != key:
                    finish()
                    key, held = row[0], []
                held.append(row)
            yield _batch(out, _MARKS)
            out[:] = [[] for _ in out]
        finish()
        yield _batch(out, _MARKS)

    return dealt.select(*_names(_ITEMS)).mapInArrow(run, _MARKS)


def _classes(items: DataFrame, key: str, context: str) -> DataFrame:
    """(key, context, n, lo, hi, rep, contexts) of keys with two members at least; rep is one item of n equal ones, lo and hi their least and greatest id."""
    fields = [c for c in items.columns if c not in (key, context, "lo", "hi")]
    lo, hi = ("lo", "hi") if "lo" in items.columns else ("id", "id")
    equal = cut(items.groupBy(key, context).agg(F.count(F.lit(1)).alias("n"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(F.struct(*fields)).alias("rep")))
    many = cut(equal.groupBy(key).agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("total")).filter("total > 1").select(key, "contexts"))
    return cut(equal.join(many, key))


def _full(items: DataFrame, classes: DataFrame, key: str, context: str, stop: Column, kinds: tuple[int, ...] = (AGAIN, SHARED)) -> DataFrame:
    """Marks of items whose context occurs twice, and in two documents. Written out: its join then stands alone, and Spark can split a hot context."""
    twice = classes.filter("n > 1").select(key, context, (F.col("lo") != F.col("hi")).alias("apart"))
    met = items.join(twice, [key, context])
    ends = {AGAIN: F.when(stop - F.col("first") >= LENGTH, stop), SHARED: F.when(F.col("apart"), F.col("last") + SHORT)}
    marks = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("first").alias("start"), ends[k].alias("end")) for k in kinds])
    return cut(met.select("id", "th", F.inline(F.filter(marks, lambda x: x["end"].isNotNull()))))


def _dealt_anew(items: DataFrame, width: int, kind: int) -> DataFrame:
    """Items of width neighbouring windows each, with the hash of the bytes that such windows share as key."""
    import xxhash

    length = LENGTHS[kind]
    schema = "key long, ch long, id long, th long, lo long, hi long, first long, last long, at long, blob binary"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _names(schema)]
            for key, i, th, low, high, first, last, at, n, blob in _rows(batch, _ITEMS):
                least, most = at - min(last, first + len(blob) - length), at - first
                # Equal copies count as two at most, so that they are known to repeat.
                for r in range(least // width, most // width + 1) if least <= most else ():
                    lo, hi = max(least, r * width), min(most, r * width + width - 1)
                    core = blob[most - r * width : most - r * width - width + 1 + length]
                    part = blob[most - hi : most - lo + length]
                    tag = key.to_bytes(8, "little", signed=True) + r.to_bytes(8, "little")
                    row = (xxhash.xxh3_64_intdigest(tag + core) - 2**63, xxhash.xxh3_64_intdigest(tag + bytes([hi - r * width, lo - r * width]) + part) - 2**63, i, th, low, high, at - hi, at - lo, at, part)
                    for _ in range(min(n, 2)):
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            yield _batch(out, schema)

    return items.select(*_names(_ITEMS)).mapInArrow(run, schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents that may hold repeats, (id, th, text), and marks on them, (id, th, kind, start, end) in bytes; marks may overlap."""
    small_batches(docs.sparkSession)
    rows = docs.select(_id(doc_id).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    every = cut(anchored(rows))
    often = cut(every.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("ah"))
    items = cut(every.join(often, "ah"))
    remove(every)
    where = items.select("id", "th").distinct()
    texts = cut(rows.join(where, ["id", "th"]).dropDuplicates(["id", "th"]))
    classes = _classes(items, "ah", "ch")
    marks = [_full(items, classes, "ah", "ch", F.col("stop"))]
    # The contexts that differ within a bucket, with their bytes.
    want = classes.filter("contexts > 1").select("rep.id", "rep.th", F.struct(F.col("ah").alias("key"), "lo", "hi", "rep.first", "rep.last", "rep.stop", "rep.at", "n", "contexts").alias("w"))
    held = texts.join(want.groupBy("id", "th").agg(F.collect_list("w").alias("w")), ["id", "th"])
    schema = f"{_ITEMS}, contexts long"

    def fetch(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _names(schema)]
            for i, th, t, wants in zip(*[batch.column(c).to_pylist() for c in ("id", "th")], batch.column("text").cast(pa.binary()).to_pylist(), batch.column("w").to_pylist(), strict=True):
                for w in wants:
                    row = (w["key"], i, th, w["lo"], w["hi"], w["first"], w["last"], w["at"], w["n"], t[w["first"] : w["stop"]], w["contexts"])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield _batch(out, schema)

    blobs = cut(held.select("id", "th", "text", "w").mapInArrow(fetch, schema))
    marks.append(_sorted(blobs.filter(F.col("contexts") <= LIMIT)))
    larger = blobs.filter(F.col("contexts") > LIMIT)
    for kind in () if larger.isEmpty() else (AGAIN, SHARED):
        large = larger
        for width in (WIDTH, 1):
            parts = cut(_dealt_anew(large, width, kind))
            groups = _classes(parts, "key", "ch")
            marks.append(_full(parts, groups, "key", "ch", F.col("last") + LENGTHS[kind], (kind,)))
            blobs = groups.filter("contexts > 1").select("key", "lo", "hi", "rep.*", "n", "contexts")
            marks.append(_sorted(blobs.filter(F.col("contexts") <= LIMIT), (kind,)))
            large = blobs.filter(F.col("contexts") > LIMIT)
            if large.isEmpty():
                break
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return texts, out


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))


def runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans; spans that touch are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words of text[start:end] that are not cut at its ends."""
    joined = lambda k: 0 < k < len(text) and text[k - 1] not in SPACE and text[k] not in SPACE
    return len(text[start:end].split()) - joined(start) - joined(end)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, n_removed, n_spans, spans array<struct<start,end>>, kept binary, shares_passage) of the documents that lose bytes or share a passage; th is xxhash64 of the text, id NO_ID where there is none."""
    texts, marks = repeats(docs, doc_id, text)
    grouped = marks.groupBy("id", "th").agg(F.collect_list(F.struct("kind", "start", "end")).alias("m"))
    met = texts.join(grouped, ["id", "th"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            removed, spans, kept, passage = [], [], [], []
            column = batch.column("m")
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            kinds, starts, ends = (x.to_numpy() for x in column.flatten().flatten())
            for t, a, b in zip(batch.column("text").cast(pa.binary()).to_pylist(), offsets, offsets[1:], strict=False):
                of = {k: runs(starts[a:b][kinds[a:b] == k], ends[a:b][kinds[a:b] == k]) for k in (AGAIN, SHARED)}
                bounds = [0, *[x for s in of[AGAIN] for x in s], len(t)]
                kept.append(b"".join(t[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True)))
                removed.append(len(t) - len(kept[-1]))
                spans.append([{"start": x, "end": y} for x, y in of[AGAIN]])
                passage.append(any(whole_words(t, x, y) >= PASSAGE_WORDS for x, y in of[SHARED]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(passage, pa.bool_())], ["id", "th", "n_removed", "n_spans", "spans", "kept", "shares_passage"])

    return met.select("id", "th", "text", "m").mapInArrow(run, "id long, th long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, shares_passage boolean")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_removed and n_spans are of bytes under repeated strings of 400; shares_passage tells of passages of 50 words and 256 bytes or more that another document holds too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lost = finished(lambda: cut_repeats(docs).select("id", "th", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"), "shares_passage"))
    t = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", _id("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"))
    out = every.join(lost, ["id", "th"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
