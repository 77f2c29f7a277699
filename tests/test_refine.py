"""Long sentences split further, and leading sentences, against plain forms over the documents' own texts and lecture lines."""

from __future__ import annotations

import random
import re

from inkwell.operators import sentences as s
from inkwell.plans import analysis


def labelled(p):
    labels, flat = "|".join(s.LABELS), re.sub(rf"\s*-\s*({'|'.join(s.DASHED)})", r" \1", p)
    parts = re.split(rf"\s+(?={labels})", flat)
    if len(parts) < 2:
        return [p]
    first = parts[0].strip()
    title = re.match(rf"(.+?)\s+(?:-\s*)?(?:{'|'.join(s.TITLED)})", first)
    rest = [re.sub(r"^-\s*", "", x.strip()).strip() for x in parts[1:]]
    name = title[1].strip() if title else first
    return [x for x in ([first] if title else []) + [f"{name} {x}" for x in rest if len(x) >= 10] if len(x) >= 15]


def refined(sentences, most=150):
    out = []
    for x in sentences:
        if len(x) <= most:
            out.append(x)
            continue
        for p in labelled(x):
            if len(p) <= most or re.search(r"\w+:\S", p):
                out.append(p)
                continue
            pieces = re.split(r"(?<=다)\s+(?=\d{1,2}[.)]\s*[가-힣A-Z])", p)
            pieces = [y for z in pieces for y in (re.split(r"(?<=다)\s+(?=[가-힣A-Z(])", z) if len(z) > 60 else [z])]
            pieces = [y for z in pieces for y in re.split(rf"(?<!\A)\s+(?={'|'.join(s.HEADINGS)})", z)]
            pieces = [y for z in pieces for y in (re.split(r"\s+(?=\d{1,2}\s+[가-힣A-Za-z(])", z) if len(z) > most else [z])]
            out += [y.strip() for y in pieces if len(y.strip()) >= 15]
    return out


def test_refining_against_a_plain_form(spark):
    rng = random.Random(17)
    piece = ["모듈은 독립적으로 컴파일되는 단위이다", "2. 결합도는 낮을수록 좋다", "정의: 시스템 바깥의 대상", "- 기호: 사각형으로 그려서 나타낸다", "핵심키워드 응집력", "7 Functional 모든 요소가 기능을 수행", "개념 설명", "key:value row", "(괄호) 안의 말", "plain words here", "3) 항목이다", "종류: 일곱 가지로 나누어 설명한다"]
    rows = [(i, [" ".join(rng.choice(piece) for _ in range(rng.choice([1, 3, 6, 10, 14]))) for _ in range(rng.randint(0, 5))]) for i in range(150)]
    got = spark.createDataFrame(rows, "doc_id long, sentences array<string>").select("doc_id", s.refine(s.F.col("sentences")).alias("r"), "sentences")
    split = 0
    for r in got.collect():
        assert r.r == refined(r.sentences), r.doc_id
        split += len(r.r) > len(r.sentences)
    assert split > 60


def test_summaries_are_the_leading_sentences(spark):
    text = "Cohesion binds the parts of a module. Coupling binds several modules together. Hiding keeps the details of a module away. Nothing else is said here at all."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "One sentence about modules only.")], "doc_id long, text string")
    got = analysis.summary(docs, keywords=4, shown=2).orderBy("doc_id", "sid").collect()
    assert [(r.doc_id, r.sid) for r in got] == [(1, 0), (1, 1), (3, 0)] and got[-1].score == 1.0
    assert [r.sentence for r in got] == ["Cohesion binds the parts of a module.", "Coupling binds several modules together.", "One sentence about modules only."]
