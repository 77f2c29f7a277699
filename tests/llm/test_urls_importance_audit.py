"""URL filters, importance resampling and the filter audit against brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import threading
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from inkwell.llm import audit, importance, urlfilter
from inkwell.llm.common import cut, finished

RULE = "host string, path string, verdict string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.S)
        host, path = lower(m[1]), m[2]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_against_every_rule(spark):
    rng = random.Random(3)
    label, step = lambda: rng.choice(["a", "b", "org", "com", "ä", "ab"]), lambda: rng.choice(["/", "a", "/a", "b/", "é", "/a/b"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 3))), "".join(step() for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p if p.startswith("/") or not p else "/" + p, v) for (h, p), v in rules.items()]
    # Of equal rules, block wins.
    urls = [None, "", "org/a", "://", "http://", "http://A.ORG", "x://org#a", "http://org:80/a", "http://u@org/a", "http://org./a", "http://.org/a", "http://a..org/", "http://org/" + "a/" * 50_000]
    urls += [f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{'/' if rng.random() < 0.9 else ''}{''.join(step() for _ in range(rng.randint(0, 4)))}{rng.choice(['', '?q=/a', '#/a'])}" for _ in range(500)]
    urls += ["http://a.org/a/b"] * 300  # a hot url
    rows = list(enumerate(urls)) + [(None, "http://b.com/a"), (0, None), (0, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("row", F.lit("r")).withColumn("rule", F.lit("own")).repartition(5)
    got = urlfilter.judge(df, spark.createDataFrame([*rules, (None, "/", "block")], RULE), carry=("page_id", "key", "row", "rule"))
    assert got.columns == ["page_id", "key", "row", "host", "path", "rule", "verdict"]
    want = Counter((i, *judged(u, rules)) for i, u in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    assert {r[3] for r in want} != {None}


def test_urls_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "block")], RULE)
    assert urlfilter.judge(none, rules).count() == 0
    some = spark.createDataFrame([(1, "http://org/")], none.schema)
    assert [r.verdict for r in urlfilter.judge(some, rules.limit(0), default="block").collect()] == ["block"]
    both = spark.createDataFrame([("ORG", None, "allow"), ("org", "", "block")], RULE)
    assert [(r.rule, r.verdict) for r in urlfilter.judge(some, both).collect()] == [("org", "block")]


def test_a_rule_reaches_all_parts(spark):
    """One host fills many parts; its rule goes to each of them."""
    urls = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.example.org/"), F.col("id")).alias("url"))
    got = urlfilter.judge(urls, spark.createDataFrame(list(urlfilter.RULES), RULE))
    assert [tuple(r) for r in got.groupBy("rule").count().collect()] == [("org/", 4000)]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def drawn(rows, target, how=importance.DRAW):
    """Rows (id, n_features, weight, score) and the ids that rank, in order."""
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words_of(t)] for n in range(how.min_n, how.max_n + 1) for i in range(len(w) - n + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % how.buckets
    s, t = Counter(bucket(x) for _, d in rows for x in grams(d)), Counter(bucket(x) for d in target for x in grams(d))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (S + how.buckets)) / ((s[b] + 1) * (T + how.buckets))))
    out = []
    for i, d in rows:
        w = sum(gain(bucket(x)) for x in grams(d))
        h = int(hashlib.sha256(f"{how.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams(d)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [r for r, (_, d) in zip(out, rows, strict=True) if len(words_of(d)) >= how.min_words]
    best = sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: len(able) * how.percent // 100]
    return out, best


@pytest.mark.parametrize("how", [importance.DRAW, importance.Draw(buckets=50, max_n=3, percent=35, min_words=3)])
def test_importance_against_brute_force(spark, how):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Of", "data", "spark", "ÄRGER", "Äpfel", "x1", "99"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 30_000), (None, "spark data " * 15), (None, "spark data " * 15), (303, "-- \x00 __")]
    rows += [(9, rows[9][1])] * 40 + [(7, "spark data data " * 20)] * 60  # a hot id, its rows tie
    target = ["spark data"] * 5 + [None, "spark " * 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("a")).withColumn("n", F.lit(1)).withColumn("row", F.lit(0)).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), carry=("id", "n", "row", "rank"), how=how)
    assert got.columns == ["id", "n", "row", "doc_id", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want, best = drawn(rows, target, how)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r.rank, r.doc_id, r.n_features, r.weight, r.score) for r in got if r.rank is not None)
    assert ranked == [(k, *r) for k, r in enumerate(best, 1)]
    assert {r.id for r in got} == {"a"}


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], none.schema)
    assert importance.resample(none, some).count() == 0
    rows = sorted(tuple(r) for r in importance.resample(some, none, how=importance.Draw(percent=100)).collect())
    assert [(r[0], r[1], r[4]) for r in rows] == [(1, 40, 1), (2, 0, None)]


def test_importance_prefers_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 10 else "stuvwxyz") for _ in range(80))) for i in range(400)]
    target = spark.createDataFrame([("s t u v w x y z " * 50,)], "text string")
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).filter("rank IS NOT NULL").collect()
    assert {r.doc_id for r in got} == {i for i in range(400) if i % 10 == 0}


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    masks = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        masks.append((part or "", {k for k, x in fails.items() if x}, i in good, i in toxic))
    out = set()
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        removed = lambda order, i: [m for m in here if order[i] in m[1] and not m[1] & set(order[:i])]
        total = Counter(f for order in permutations("ABCDE") for i, f in enumerate(order) for _ in removed(order, i))
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                gone = removed(order, i)
                kept = sum(not m[1] & set(order[: i + 1]) for m in here)
                late = sum(f in m[1] for m in here) - len(gone)
                out.add((part, "".join(order), i + 1, kept, len(gone), late, sum(m[1] == {f} for m in here), sum(m[2] for m in gone), sum(m[3] for m in gone), total[f]))
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Aa", "b", "CC", "d", "e$", *map(str, range(rng.choice([5, 400])))]) for _ in range(rng.choice([3, 210, 260]))) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (3, rows[3][1], "fr"), (3, rows[3][1], "fr"), (200, None, "en"), (201, "", None), (202, "x y " * 20_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.lit(1)).withColumn("mask", F.lit("m")).withColumn("n", F.lit(2)).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(0))
    got = audit.audit(audit.cells(docs, marks))
    assert {tuple(r) for r in got.collect()} == audited(rows, labels)
    assert got.count() == 600 * 4


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.cells(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert audit.audit(audit.cells(one, labels)).filter("removed = 1").count() == 120


def test_threads_keep_their_own_tables(spark):
    """finished() in two threads: the one that ends first leaves the other's tables alone; a failure leaves none."""
    first_in, go = threading.Event(), threading.Event()
    out, lost = {}, {}

    def slow():
        def make():
            df = cut(spark.range(10))
            first_in.set()
            assert go.wait(60)
            return df

        try:
            out["slow"] = finished(make).count()
        except Exception as e:  # noqa: BLE001
            lost["slow"] = e

    t = threading.Thread(target=slow)
    t.start()
    assert first_in.wait(60)
    out["fast"] = finished(lambda: cut(spark.range(5))).count()
    go.set()
    t.join()
    assert not lost and out == {"slow": 10, "fast": 5}
    written = []
    with pytest.raises(RuntimeError):
        finished(lambda: (written.append(cut(spark.range(3)).inputFiles()[0]), (_ for _ in ()).throw(RuntimeError))[0])
    path = spark._jvm.org.apache.hadoop.fs.Path(written[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
