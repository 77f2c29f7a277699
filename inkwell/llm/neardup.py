"""MinHash near-dedup with HyperMinHash registers.

A document's set holds its distinct five-word shingles. Each of 128 buckets has
a hash function of its own and keeps, of its least value, the count of leading
zeros (6 bits) and the next 10 bits (mantissa): 16 bits a register. Four
registers make a band; two sets meet where a band is equal. Similarity is
estimated from equal registers, corrected for the collisions that compressed
registers have by chance, and what passes is verified on the full sets.

Groups of copies are never expanded into pairs. Equal sets collapse into one
representative first. In a bucket of equal bands all members are compared with
one pivot; where a bucket still falls into several components, members of the
others are compared with a further pivot from the largest one. What is then left
outside the largest components is compared in blocks, on full sets, with all that
shares a bucket with it; a block returns one confirmed link for each two
components. So every two sets that share a band end up in one component or have
been compared, and no link between two sets that meet is lost. Sets at
similarity 0.75 share none of the 32 bands with probability 5e-6.

A set is known by the least id that holds it and the hash of that text.

Links and components stay in tables of the shared folder; components come from
least labels with pointer jumping.

Defined results: a null or empty text has an empty set and is linked with
nothing; rows with equal id are one document (their links count together); a
row without id is linked with nothing and has no component, and is kept; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, finished, remove, small_batches

WORDS, PERCENT = 5, 75
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Estimates this far below the threshold are not verified: over 5 standard deviations of an estimate from 128 registers.
MARGIN = 0.22
#: Rounds of comparing with further pivots before what is left is compared in blocks.
ROUNDS = 1
#: Bytes of text in a chunk of a block, about.
CHUNK = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, REGISTERS, np.uint64)


_A, _B = _constants()


def split(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased; bytes.split() splits at exactly [\\x20\\x09-\\x0D]."""
    return text.lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    import xxhash

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(WORDS, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : n - k + 1 + j]) * _MUL
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def exact(words: list[bytes]) -> set[bytes]:
    """The distinct shingles themselves."""
    if not words:
        return set()
    k = min(WORDS, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def registers(h: np.ndarray) -> np.ndarray:
    """BANDS keys of four 16-bit registers each."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, ((h[i : i + 4096, None] ^ _B) * _A).min(0))
    # Leading zeros from the exponent of the top 53 bits; a register for 0 or so small a value does not matter.
    top = (least >> np.uint64(11)).astype(np.float64)
    zeros = 53 - np.frexp(np.maximum(top, 1))[1]
    rest = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    r = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | rest
    r = r.reshape(BANDS, ROWS)
    return ((r[:, 0] << np.uint64(48)) | (r[:, 1] << np.uint64(32)) | (r[:, 2] << np.uint64(16)) | r[:, 3]).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, th, n, s1, s2, bands) of rows (id, th, text): set size, 128 bits of the set's hash, band keys (null for an empty set)."""
    import xxhash

    def run(batches):
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                h = shingles(split(t or b""))
                n.append(len(h))
                digest = xxhash.xxh3_128_digest(h.tobytes())
                s1.append(int.from_bytes(digest[:8], "big", signed=True))
                s2.append(int.from_bytes(digest[8:], "big", signed=True))
                bands.append(registers(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "n", "s1", "s2", "bands"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n long, s1 long, s2 long, bands array<bigint>")


def chance(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets are equal: for each count of leading zeros the share of both, over its mantissas."""
    levels = np.arange(64)
    at = lambda n: np.exp(n[:, None] * np.log1p(-(2.0 ** -(levels + 1)))) - np.where(levels == 0, 0.0, np.exp(n[:, None] * np.log1p(-(2.0 ** -np.maximum(levels, 1)))))
    return (at(n1) * at(n2)).sum(1) / 2**MANTISSA


PAIR = ("a", "ta", "b", "tb")
_PAIRS = "a long, ta long, b long, tb long"


def _both(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pairs with columns of sets (rep, th, ...) for either side. Each side has a join of its own, which Spark can split where one pivot has many partners."""
    for side in ("b", "a"):
        one = sets.select(F.col("rep").alias(side), F.col("th").alias(f"t{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(one, [side, f"t{side}"])
    return pairs.select(*PAIR, *[f"{c}_{x}" for c in columns for x in ("a", "b")])


def _estimated(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose corrected estimate comes near the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.array(batch.column(c).flatten()).reshape(-1, BANDS).view(np.uint64) for c in ("bands_a", "bands_b"))
            same, x = np.zeros(len(a)), a ^ b
            for s in range(0, 64, 16):
                same += ((x >> np.uint64(s)) & np.uint64(0xFFFF) == 0).sum(1)
            na, nb = (np.array(batch.column(c), float) for c in ("n_a", "n_b"))
            c = chance(na, nb)
            j = (same / REGISTERS - c) / (1 - c)
            fits = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
            near = pa.array((j >= PERCENT / 100 - MARGIN) & fits)
            yield batch.select(PAIR).filter(near)

    return _both(pairs, sizes, ("n", "bands")).mapInArrow(run, _PAIRS)


def _linked(x: set[bytes], y: set[bytes]) -> bool:
    common = len(x & y)
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of pairs whose full sets are linked."""

    def run(batches):
        last, held = None, set()
        for batch in batches:
            keep = []
            for ta, tb in zip(*[batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")], strict=True):
                if ta != last:
                    last, held = ta, exact(split(ta))
                keep.append(_linked(held, exact(split(tb))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, texts, ("text",)).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, c): the least id reachable, for every id in links (a, b)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = cut(both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m")))
        step = cut(labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = cut(step.join(jump, "c").select("v", "old", F.least("c", "j").alias("c")))
        done = new.filter("c <> old").isEmpty()
        for x in (near, step, labels):
            remove(x)
        if done:
            remove(both)
            return new.select("v", "c")
        labels = new.select("v", "c")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    sig = cut(signatures(rows))
    full = sig.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    # One representative for each distinct set.
    sets = cut(full.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min_by("th", "id").alias("th")))
    chosen = sets.select("s1", "s2", F.col("rep").alias("id"), "th")
    reps = cut(full.join(chosen, ["s1", "s2", "id", "th"]).select(F.col("id").alias("rep"), "th", "n", "bands").dropDuplicates(["rep", "th"]))
    bands = reps.select("rep", "th", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot"), F.min_by("th", "rep").alias("tp"))
    buckets = cut(buckets.filter("size > 1").select("band", "key", "pivot", "tp"))
    met = cut(bands.join(buckets, ["band", "key"]))
    # Texts of all that may be compared move once.
    wanted = met.select(F.col("rep").alias("id"), "th").distinct()
    texts = cut(rows.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select(F.col("id").alias("rep"), "th", "text"))
    # Sets of one id are one document from the start.
    whole = full.select("id", "s1", "s2").distinct()
    several = whole.groupBy("id").count().filter("count > 1").select("id")
    links = cut(whole.join(several, "id", "left_semi").join(sets, ["s1", "s2"]).select(F.col("rep").alias("a"), F.col("id").alias("b")))
    comp = components(links)
    pairs = met.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("tp").alias("ta"), F.col("rep").alias("b"), F.col("th").alias("tb")).distinct()
    tried = None
    for k in range(ROUNDS + 2):
        if k:
            met = _open(met, comp)
            if met is None:
                break
        if k > ROUNDS:
            new = cut(_blocks(met, texts).distinct())
        else:
            pairs = cut(_between(met, tried, k) if k else pairs)
            tried = pairs if tried is None else tried.union(pairs)
            near = cut(_estimated(pairs, reps).distinct())
            new = cut(_verified(near, texts).distinct())
            remove(near)
        if not new.isEmpty():
            links = links.union(new)
            comp = components(links)
    least = cut(sets.drop("th").join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left").select("s1", "s2", F.coalesce("c", "rep").alias("least")))
    out = sig.select("id", "n", "s1", "s2").join(least, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open(met: DataFrame, comp: DataFrame) -> DataFrame | None:
    """Rows of buckets that still have several components, with their component c and the bucket's largest, main; None if there are none."""
    at = cut(met.drop("c", "main").join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")))
    parts = at.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("n"))
    best = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c")).alias("best"))
    several = cut(best.filter("parts > 1").select("band", "key", F.col("best.c").alias("main")))
    return None if several.isEmpty() else cut(at.join(several, ["band", "key"]))


def _between(met: DataFrame, tried: DataFrame, k: int) -> DataFrame:
    """Pairs not yet tried of one pivot in a bucket's largest component, another each round, and the members of its other components."""
    # By a hash, so that one pivot serves a component in many of its buckets.
    main = met.filter("c = main AND rep <> pivot").groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("rep", "th", F.lit(k)).alias("h"), "rep", "th")).alias("p"))
    pairs = met.filter("c <> main").join(cut(main.select("band", "key", F.col("p.rep").alias("a"), F.col("p.th").alias("ta"))), ["band", "key"])
    pairs = _ordered(pairs.select("a", "ta", F.col("rep").alias("b"), F.col("th").alias("tb"))).distinct()
    return pairs.join(_ordered(tried), list(PAIR), "left_anti")


def _ordered(pairs: DataFrame) -> DataFrame:
    """pairs with the lesser id first; the ids of a pair differ."""
    up = F.col("a") < F.col("b")
    return pairs.select(*[F.when(up, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("ta", "tb"), ("b", "a"), ("tb", "ta"))])


def _blocks(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Linked pairs (a, b) between components, by comparing in blocks the sets outside a largest component with all that meet it.

    A family is a largest component with all sets that share an open bucket with
    it. Sets outside the component are dealt to chunks of about CHUNK bytes, and
    so are all sets of the family; every two chunks meet in one task. Hashes of
    shingles find linked pairs; for every two components the first pair that full
    sets confirm is returned.
    """
    family = cut(met.groupBy("main", "rep", "th", "c").agg(F.first(F.lit(True)).alias("_")).drop("_").withColumn("other", F.col("c") != F.col("main")).join(texts, ["rep", "th"]))
    bytes_of = lambda c: F.sum(F.when(c, F.octet_length("text")).otherwise(0))
    size = cut(family.groupBy("main").agg(bytes_of(F.lit(True)).alias("n"), bytes_of(F.col("other")).alias("k")))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int")
    dealt = family.join(size, "main").select("main", "rep", "c", "other", parts("n").alias("ns"), parts("k").alias("ks"), F.xxhash64("rep", "th").alias("h"), "text")
    left = dealt.filter("other").select("main", F.expr("cast(pmod(h, ks) AS int)").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j"), "rep", "c", "text").toDF("main2", "i2", "j2", "rep2", "c2", "text2")
    right = dealt.select("main", F.explode(F.sequence(F.lit(0), F.col("ks") - 1)).alias("i"), F.expr("cast(pmod(h, ns) AS int)").alias("j"), "rep", "c", "text")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], []]
        if a.num_rows and b.num_rows:
            texts = [x.column(n).cast(pa.binary()) for x, n in ((a, "text2"), (b, "text"))]
            sets = [[shingles(split(t.as_py())) for t in x] for x in texts]
            values, places = np.unique(np.concatenate(sets[1]), return_inverse=True)
            sizes = np.array([len(s) for s in sets[1]])
            starts = np.cumsum(sizes) - sizes
            reps, cs = (b.column(x).to_numpy() for x in ("rep", "c"))
            met: set[tuple[int, int]] = set()
            for i, (rep, c, s) in enumerate(zip(a.column("rep2").to_pylist(), a.column("c2").to_pylist(), sets[0], strict=True)):
                held = np.zeros(len(values), np.int32)
                at = np.searchsorted(values, s)
                inside = at < len(values)
                at = at[inside]
                held[at[values[at] == s[inside]]] = 1
                common = np.add.reduceat(held[places], starts)
                for j in np.flatnonzero((100 * common >= PERCENT * (len(s) + sizes - common)) & (cs != c)).tolist():
                    two = (min(c, int(cs[j])), max(c, int(cs[j])))
                    if two not in met and _linked(*(exact(split(x[k].as_py())) for x, k in ((texts[0], i), (texts[1], j)))):
                        met.add(two)
                        out[0].append(min(rep, int(reps[j])))
                        out[1].append(max(rep, int(reps[j])))
        return pa.table({x: pa.array(y, pa.int64()) for x, y in zip("ab", out, strict=True)})

    return left.groupBy("main2", "i2", "j2").cogroup(right.groupBy("main", "i", "j")).applyInArrow(compare, "a long, b long")


def _comparable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of this type."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    return _comparable(kind.elementType) if isinstance(kind, T.ArrayType) else kind.typeName() not in ("map", "variant")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns of docs. Rows without id stay. Of rows with one id one stays, chosen by hashes of all columns but maps."""
    kept = finished(lambda: link(docs, doc_id, text).filter(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct())
    order = F.xxhash64(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in docs.columns if c != text and _comparable(docs.schema[c].dataType)])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), order.alias("_order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    one = rows.join(kept, "_id", "left_semi").groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"))
    both = one.select("_row").union(rows.filter(F.col("_id").isNull()).select("_row"))
    return both.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
