"""Personal data by weak supervision.

Four formats (email, ip, card, phone) are base spans, found as such. Candidates
beyond them (spelled-out addresses, numbers without an international prefix,
grouped identity numbers, credentials) are voted on by labelers: a format
labeler, a checksum and digit-count labeler, a gazetteer labeler and two context
labelers in four languages, each for, against or silent. Expectation-
maximisation over the counts of vote patterns estimates how reliable each
labeler is and how common each kind is; base spans are known to be right. Its
posteriors train a logistic span classifier over the votes, the kind and the
span's shape and neighbours, which decides on the candidates.

All documents are read once; candidates with their votes go to a table in the
shared folder. Votes, kind, shape and neighbours are one number below CODES, so
counts of such numbers, and the model, fit anywhere however large the corpus.

Spans are code points, end exclusive. Defined results: a null or empty text has
no spans; repeated rows are scanned one by one (and count as evidence each); an
empty table gives an empty table; very long texts are scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, small_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("spelled_email", "local_phone", "identity", "credential")
KINDS = BASE + MORE
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its digits do; to try each digit of a long run would take the square of its length.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{2,64}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,24}){1,3}(?![\w.])")
_NUMBER = re.compile(r"(?<![\w+.,/-])(?:\([0-9]{2,4}\)\x20?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![\w/]|[.,-][0-9])")
_IDENTITY = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-.\x20])[0-9]{3,4}[-.\x20][0-9]{3,4}")
_DATE = re.compile(r"[0-9]{4}[-.][0-9]{2}[-.][0-9]{2}|[0-9]{2}[-.][0-9]{2}[-.][0-9]{2,4}")
_CREDENTIAL = re.compile(r"""(?i:password|passwd|pwd|secret|token|api[_-]?key|passwort|kennwort|contraseña|clave|mot\x20de\x20passe)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
#: Endings of mail domains; values that stand for a credential without being one.
DOMAINS = frozenset("com org net edu gov mil int io info biz dev app ai me tv eu us ca mx br ar cl co pe uk ie de at ch fr be nl lu es pt it pl cz se no dk fi gr ru ua tr in cn jp kr tw au nz za".split())
PLACEHOLDERS = frozenset("changeme password example placeholder undefined required optional string default".split())
#: Words near which personal data stands or does not stand, in English, German, French and Spanish, lower case.
FOR = re.compile(
    r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|reach|email|mail|e-mail|write|ssn|social security|identity|passport|my number|login|credentials"
    r"|telefon|handy|rufnummer|anrufen|kontakt|schreiben|ausweis|reisepass|sozialversicherung"
    r"|téléphone|portable|appelez|courriel|joindre|écrire|carte d'identité|passeport|sécurité sociale"
    r"|teléfono|móvil|llame|llamar|correo|contacto|escribir|dni|nif|pasaporte|seguridad social)\b"
)
AGAINST = re.compile(
    r"\b(?:isbn|issn|doi|version|page|pages|chapter|fig|figure|table|section|item|order|invoice|price|total|score|lines?|years?"
    r"|seiten?|kapitel|abbildung|tabelle|abschnitt|bestellung|rechnung|preis|summe|zeilen?|jahre?"
    r"|chapitre|tableau|article|commande|facture|prix|somme|lignes?|années?"
    r"|páginas?|capítulo|figura|tabla|artículo|pedido|factura|precio|suma|líneas?|años?)\b"
)
LABELERS = 5
NEAR = 40
VOTES = 3**LABELERS
#: Buckets of a span's length, separators and left neighbour.
LENGTHS, MARKS, BEFORE = 4, 3, 4
SHAPES = LENGTHS * MARKS * BEFORE
CODES = len(KINDS) * VOTES * SHAPES


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over its local part, instead of from each word on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = _ADDRESS.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of BASE."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if re.search("[0-9]", text):
        out[1] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
        out[2] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of base spans, with kind below len(BASE), and of candidates outside them."""
    found = [(k, a, b) for k, spans in enumerate(base) for a, b in spans]
    more = []
    if " at " in text or "at)" in text or "at]" in text:
        more += [(4, *m.span()) for m in _SPELLED.finditer(text)]
    if re.search("[0-9]", text):
        for m in _NUMBER.finditer(text):
            if 7 <= len(_digits(m.group())) <= 12:
                more.append((6 if _IDENTITY.fullmatch(m.group()) else 5, *m.span()))
    if ":" in text or "=" in text:
        more += [(7, *m.span(1)) for m in _CREDENTIAL.finditer(text)]
    # Both in order of their starts: the base spans that reach furthest so far decide.
    far, taken = 0, iter(sorted((a, b) for _, a, b in found))
    spans = [(a, b, k) for k, a, b in more]
    ahead = next(taken, None)
    for a, b, k in sorted(spans):
        while ahead and ahead[0] < b:
            far, ahead = max(far, ahead[1]), next(taken, None)
        if far <= a:
            found.append((k, a, b))
    return [(k, a, b, (k * VOTES + votes(text, k, a, b)) * SHAPES + shape(text, a, b)) for k, a, b in found]


def votes(text: str, kind: int, a: int, b: int) -> int:
    """The labelers' votes in base 3: 0 against, 1 silent, 2 for."""
    s, before = text[a:b], text[max(0, a - NEAR) : a].lower()
    near = before + " " + text[b : b + NEAR].lower()
    d = _digits(s)
    if kind in (0, 4):
        ending = re.split(r"[\s.\])]+", s.lower())[-1]
        form = 2 if kind == 0 or "dot" in s.lower() and re.search(r"[\[(]", s) else 1
        check = 2 if re.search(r"[0-9._]", re.split(r"@|\s|[\[(]", s)[0]) else 1
        gazetteer = 2 if ending in DOMAINS else 0
    elif kind == 7:
        form = 2 if len(s) >= 8 else 1
        check = 0 if len(set(s)) <= 3 else 2 if d and len(d) < len(s) else 1
        gazetteer = 0 if s.lower().strip("._=-") in PLACEHOLDERS else 1
    else:
        form = 0 if _DATE.fullmatch(s) else 2 if kind < 4 or kind == 6 or _LOCAL_PHONE.fullmatch(s) else 1
        check = 0 if len(set(d)) <= 2 else 2 if kind < 4 or len(d) in (9, 10, 11) else 1
        gazetteer = 2 if kind == 2 and d[:1] in "3456" or kind == 6 and d[:3] not in ("000", "666") and d[0] != "9" else 1
    pattern = 0
    for v in (form, check, gazetteer, 2 if FOR.search(near) else 1, 0 if AGAINST.search(near) else 1):
        pattern = pattern * 3 + v
    return pattern


def shape(text: str, a: int, b: int) -> int:
    """The span's length, separators in it, and what stands before it, in buckets."""
    s = text[a:b]
    marks = sum(not c.isalnum() for c in s)
    before = text[max(0, a - 3) : a].rstrip(" ")[-1:]
    left = 0 if before in ("", "\n") else 1 if before in ":=\"'" else 2 if before in "([<" else 3
    return (min(len(s).bit_length() - 3 if len(s) >= 8 else 0, LENGTHS - 1) * MARKS + min(marks, MARKS - 1)) * BEFORE + left


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, found array<struct<kind,start,end,code>>) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("t"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = []
            for t in batch.column("t").to_pylist():
                t = t or ""
                found.append([dict(zip(("kind", "start", "end", "code"), x, strict=True)) for x in candidates(t, base_spans(t))])
            kept = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], [*[f"c{i}" for i in range(len(carry))], "found"])

    fields = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    return rows.mapInArrow(run, f"{fields}, found array<struct<kind:int,start:int,end:int,code:int>>").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "found")


def unpack(patterns: np.ndarray) -> np.ndarray:
    """Votes -1, 0, 1 by labeler."""
    return np.stack([patterns // 3 ** (LABELERS - 1 - j) % 3 - 1 for j in range(LABELERS)], 1)


#: What EM expects of each labeler before it sees votes, as counts: (against, silent, for) in wrong and in right spans. Formats say less than words near by.
EXPECTED = np.array([
    [[6, 8, 6], [2, 6, 12]],
    [[6, 8, 6], [2, 8, 10]],
    [[8, 10, 2], [2, 10, 8]],
    [[0.1, 19, 1], [0.1, 10, 10]],
    [[10, 10, 0.1], [1, 19, 0.1]],
])


def expect(v: np.ndarray, counts: np.ndarray, kinds: np.ndarray | None = None, known: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each pattern, and P(vote | class) by labeler, class and vote, from EM started at the majority vote; each kind has a prior of its own, and known patterns are right."""
    kinds = np.zeros(len(v), int) if kinds is None else kinds
    known = np.zeros(len(v), bool) if known is None else known
    post = np.where(known, 1.0, 1 / (1 + np.exp(-2.0 * v.sum(1))))
    table = np.full((v.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weights = np.stack([1 - post, post]) * counts
        for j in range(v.shape[1]):
            for x in (-1, 0, 1):
                table[j, :, x + 1] = (weights[:, v[:, j] == x].sum(1) + EXPECTED[j, :, x + 1]) / (weights.sum(1) + EXPECTED[j].sum(1))
        prior = np.ones((2, len(v)))
        for k in np.unique(kinds):
            prior[:, kinds == k] = ((weights[:, kinds == k].sum(1) + 1) / (weights[:, kinds == k].sum() + 2))[:, None]
        logs = np.log(prior) + sum(np.log(table[j][:, v[:, j] + 1]) for j in range(v.shape[1]))
        new = np.where(known, 1.0, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def features(codes: np.ndarray) -> np.ndarray:
    """One row a code: votes for and against, kind, and the buckets of shape."""
    kinds, v, shapes = codes // (VOTES * SHAPES), unpack(codes // SHAPES % VOTES), codes % SHAPES
    hot = lambda x, n: x[:, None] == np.arange(n)
    return np.hstack([np.ones((len(v), 1)), v == 1, v == -1, hot(kinds, len(KINDS)), hot(shapes // (MARKS * BEFORE), LENGTHS), hot(shapes // BEFORE % MARKS, MARKS), hot(shapes % BEFORE, BEFORE)]).astype(float)


def train(x: np.ndarray, post: np.ndarray, counts: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of a logistic classifier over features, fitted to the posteriors."""
    w, share = np.zeros(x.shape[1]), counts / max(counts.sum(), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 1.0 * (x.T @ (share * (p - post)) + 1e-5 * w)
    return w


def accepted(found: DataFrame, least: float = 0.5) -> list[int]:
    """Codes of the candidates that the classifier keeps."""
    rows = sorted((r[0], r[1]) for r in found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect())  # at most CODES
    if not rows:
        return []
    codes, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    kinds, x = codes // (VOTES * SHAPES), features(codes)
    base = kinds < len(BASE)
    post, _ = expect(unpack(codes // SHAPES % VOTES), counts, kinds, base)
    # Base spans and candidates weigh alike: else the many that are right anyway teach that all are.
    weights = counts * np.where(base, min(1.0, counts[~base].sum() / max(counts[base].sum(), 1)), 1.0)
    p = 1 / (1 + np.exp(-x @ train(x, post, weights)))
    return codes[(p >= least) & ~base].tolist()


def detect(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, base_spans, spans): arrays of structs (kind, start, end) in order of kind, then start."""
    found = cut(scan(docs, text, carry))
    keep = accepted(found)
    bare = lambda x: F.struct(x["kind"], x["start"], x["end"])
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["kind"] < len(BASE)), bare))
    # A list this long becomes a hash set in the plan; an array would be searched from its start for each span.
    both = F.array_sort(F.transform(F.filter("found", lambda x: (x["kind"] < len(BASE)) | x["code"].isin(*keep)), bare))
    return found.select(*carry, base.alias("base_spans"), both.alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_spans counts all spans, those of the method included."""
    df = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _is(kind: int):
    return lambda x: x["kind"] == kind
