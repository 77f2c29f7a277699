"""Secret scans (native).

Three formats (assign, access, hex) are matched by pattern. Other candidate
strings are judged by the Shannon entropy of a sliding window, per character
class: the window's sum of c*log2(c) changes by two table look-ups a step, as
one character enters and one leaves. The part of a candidate where windows reach
the entropy is a span, unless it has no digit. The allow list is held against
the first window of greatest entropy: a harmless word elsewhere in a long
candidate, as in a path before a key, hides nothing.

Spans are code points, end exclusive. Defined results: a null or empty text has
no spans; repeated rows are scanned one by one; an empty table gives an empty
table. An array holds the spans of one document alone. Very long candidates take
time in proportion to their length, and n matches n times the root of n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Class, its characters (the index in this string counts them), and the least entropy in bits of a window.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", 2.9),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
WINDOW = 20
#: Harmless candidates (identifiers), and harmless windows: placeholders, runs of the alphabet.
IDENTIFIER = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED = r"(?i)example|sample|dummy|placeholder|xxxx|0000000|abcdefg|1234567"
#: c*log2(c) in millionths, so that sums are exact.
LOGS = tuple(round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 1))


def most(bits: float) -> int:
    """A window has at least these bits of entropy if its sum of LOGS is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def _class_pattern(chars: str) -> str:
    return "[" + chars.replace("-", "") + ("-" if "-" in chars else "") + "]{%d,}" % WINDOW


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, kind: str, move, say) -> Column:
    """array<kind> of say(state, x) for each x in order; the state is a number that begins at 0 and becomes move(state, x).

    Results gather in blocks, since appending to an array copies it.
    """

    def fold(part: Column, state: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, zero, lambda s, x: F.struct(move(s["state"], x).cast("int").alias("state"), F.concat(s["out"], F.array(say(s["state"], x).cast(kind))).alias("out")))

    def blocks(z: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(z))).cast("int"), F.lit(16))
        return let(width, lambda w: F.flatten(F.aggregate(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(z) / w).cast("int") - 1, F.lit(0))),
            F.struct(F.lit(0).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda s, b: let(fold(F.slice(z, b * w + 1, w), s["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out"))),
            lambda s: s["out"],
        )))

    return let(items, blocks)


_SPAN = "struct<start:int,end:int,match:string>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches: gaps and matches alternate, so their lengths add up to positions."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = let(found, lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("match")))
    after = lambda at, x: at + F.length(x["gap"]) + F.length(x["match"])
    return running(both, _SPAN, after, lambda at, x: F.struct((at + F.length(x["gap"])).alias("start"), after(at, x).alias("end"), x["match"].alias("match")))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def hot_parts(index: Column, letters: Column, size: int, bits: float) -> Column:
    """array<struct(first, last)>: the places, from 0 and end exclusive, that hot windows cover. letters: the candidate's characters; index: their places in a class of so many characters; columns or a lambda's variables."""
    limit, logs = most(bits), F.array(*map(F.lit, LOGS))
    moves = F.transform(index, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.coalesce(F.get(index, i - WINDOW), F.lit(-1)).alias("out")))
    none = F.lit(None).cast("int")
    state = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))
    put = lambda counts, k, v: F.concat(F.slice(counts, 1, k), F.array(v), F.slice(counts, k + 2, size))
    span = lambda s: F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))

    def step(s, m):
        # The one that leaves goes first; then the one that enters.
        gone = F.when(m["out"] >= 0, F.get(s["counts"], m["out"])).otherwise(F.lit(0))
        after = F.when(m["out"] >= 0, put(s["counts"], m["out"], gone - 1)).otherwise(s["counts"])
        less = F.when(gone > 0, F.get(logs, gone - 1) - F.get(logs, gone)).otherwise(F.lit(0))
        return let(F.struct(after.alias("counts"), (s["sum"] + less).cast("long").alias("sum")), lambda t: enter(s, m, t, F.get(t["counts"], m["x"])))

    def enter(s, m, t, here):
        total = (t["sum"] + F.get(logs, here + 1) - F.get(logs, here)).cast("long")
        begin = m["i"] - (WINDOW - 1)
        window = F.array_join(F.slice(letters, begin + 1, F.lit(WINDOW)), "")
        hot = F.when((begin >= 0) & (total <= limit), ~window.rlike(ALLOWED)).otherwise(F.lit(False))
        return let(hot, lambda h: F.struct(
            put(t["counts"], m["x"], here + 1).alias("counts"),
            total.alias("sum"),
            F.when(h & (s["first"].isNull() | (begin > s["last"])), begin).otherwise(s["first"]).cast("int").alias("first"),
            F.when(h, m["i"] + 1).otherwise(s["last"]).cast("int").alias("last"),
            F.when(h & (begin > s["last"]), F.concat(s["done"], span(s))).otherwise(s["done"]).alias("done"),
        ))

    return F.aggregate(moves, state, step, lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], span(s))))


def _named(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["end"].alias("end")))


def _judged(found: Column, kind: str, chars: str, bits: float) -> Column:
    """The parts of each candidate that hot windows cover, with their text as match."""

    def secret(x):
        # Hexadecimal strings have a class of their own.
        return x["match"].rlike("[0-9]") & x["match"].rlike("[g-zG-Z]") if kind == "entropy_base64" else x["match"].rlike("[0-9]")

    letters = lambda m: F.filter(F.split(m, ""), lambda c: c != "")
    split = F.transform(F.filter(found, lambda x: secret(x) & ~x["match"].rlike(IDENTIFIER)), lambda x: F.struct(x["start"].alias("start"), letters(x["match"]).alias("letters")))
    places = F.transform(split, lambda x: F.struct(x["start"].alias("start"), x["letters"].alias("letters"), F.transform(x["letters"], lambda c: F.instr(F.lit(chars), c) - 1).alias("index")))
    parts = F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["letters"].alias("letters"), hot_parts(x["index"], x["letters"], len(chars), bits).alias("hot")))
    spans = F.flatten(F.transform(parts, lambda x: F.transform(x["hot"], lambda h: F.struct((x["start"] + h["first"]).alias("start"), (x["start"] + h["last"]).alias("end"), F.array_join(F.slice(x["letters"], h["first"] + 1, h["last"] - h["first"]), "").alias("match")))))
    return F.filter(spans, secret)


def _outside(base: Column, extra: Column, fields: str) -> Column:
    """The structs of extra that lie inside none of base: in order of their starts, none of base so far reaches their end."""
    tagged = lambda spans, new: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(new).alias("new"), x["end"].alias("end"), (x if new else F.lit(None)).cast(f"struct<{fields}>").alias("span")))
    order = F.array_sort(F.concat(tagged(base, 0), tagged(extra, 1)))
    said = running(order, f"struct<{fields}>", lambda far, x: F.when(x["new"] == 0, F.greatest(far, x["end"])).otherwise(far), lambda far, x: F.when((x["new"] == 1) & (far < x["end"]), x["span"]))
    return F.filter(said, lambda x: x.isNotNull())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and spans: array<struct<start,rank,kind,end>> in order; rank is the kind's place in KINDS. Columns of docs with these two names give way."""
    keep = [c for c in docs.columns if c not in ("base_spans", "spans")]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    df = df.withColumn("_assign", F.when(F.col("_t").rlike("[:=]"), located(F.col("_t"), ASSIGN)).otherwise(_none()))
    df = df.withColumn("_access", F.when(F.col("_t").contains("AKIA"), located(F.col("_t"), ACCESS)).otherwise(_none()))
    df = df.withColumn("_hex", F.when(F.col("_t").rlike(HEX), located(F.col("_t"), HEX)).otherwise(_none()))
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 6))
    df = df.withColumn("base_spans", F.array_sort(F.concat(*[_named(F.col(c), i) for i, c in enumerate(("_assign", "_access", "_hex"))])))
    for i, (kind, chars, bits) in enumerate(CLASSES, start=3):
        c, pattern = f"_{kind}", _class_pattern(chars)
        df = df.withColumn(c, F.when(F.col("_t").rlike(pattern), located(F.col("_t"), pattern)).otherwise(_none()))
        # What is inside a span already found says nothing new, and need not be judged.
        df = df.withColumn(c, F.when((F.size(c) > 0) & (F.size("base_spans") > 0), _outside(F.col("base_spans"), F.col(c), "start:int,end:int,match:string")).otherwise(F.col(c)))
        df = df.withColumn(c, _named(_judged(F.col(c), kind, chars, bits), i))
    extra = F.concat(*[F.col(f"_{k}") for k, _, _ in CLASSES])
    df = df.withColumn("_extra", F.when(F.size(extra) > 0, _outside(F.col("base_spans"), extra, "start:int,rank:int,kind:string,end:int")).otherwise(_named(_none(), 0)))
    df = df.withColumn("spans", F.array_sort(F.concat("base_spans", "_extra")))
    return df.select(*[F.col("_row")[c].alias(c) for c in keep], "base_spans", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
