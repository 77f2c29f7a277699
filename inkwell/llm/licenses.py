"""License scans: fuzzy search for short notices.

A notice with k allowed edits is split into k+1 seeds, one of which stands
unchanged in every place that is within k edits (pigeonhole). An Aho-Corasick
automaton finds all seeds; around each, the regex library's bounded-error
matching verifies the edits and reports the span. Places without edits are the
base places; names and numbers that tell licenses apart must stand unchanged in
every place.

Texts are searched as their words (letters, digits and everything beyond
ASCII; A-Z lower-cased) joined by one space.

Defined results: a null or empty text has no words and no places, score 0;
repeated rows are scanned one by one; an empty table gives an empty table.
Rows are scanned where they lie; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    #: Words that tell this license from others, and so must stand unchanged.
    names: tuple[str, ...]
    #: Whether its unchanged places are base places.
    base: bool = False


NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",), True),
    Notice("apache license version 2", "apache-2", 2, ("2",), True),
    Notice("cc by nc", "cc-by-nc", 0, (), True),
    Notice("gnu general public license", "gpl", 2, ("gnu",)),
    Notice("mozilla public license", "mpl", 2, ("mozilla",)),
    Notice("bsd 3 clause license", "bsd-3-clause", 1, ("bsd", "3")),
)

#: Bytes that are no part of a word become spaces.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal(text: bytes) -> tuple[str, int]:
    """The words of a text, A-Z lower-cased, each between single spaces, and how many they are."""
    words = text.lower().translate(_TABLE).split()  # bytes.lower() changes A-Z alone
    return " " + b" ".join(words).decode("utf-8", "replace") + " ", len(words)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """The pieces of a notice with their offsets; one more than its edits."""
    n, k = len(notice.phrase), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.find = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, seed in seeds(n):
                of.setdefault(seed, []).append((i, offset))
        for seed, uses in of.items():
            self.find.add_word(seed, (len(seed), uses))
        self.find.make_automaton()
        self.match = [regex.compile(rf"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}") for n in notices]

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of every place in a normalised text. Of overlapping edited places of one notice the one with fewest edits counts, then the leftmost, then the shortest; none that overlaps an unchanged place does."""
        starts: list[set[int]] = [set() for _ in self.notices]
        for end, (n, uses) in self.find.iter(text):
            for i, offset in uses:
                starts[i].add(end + 1 - n - offset)
        out = []
        for i, found in enumerate(starts):
            notice = self.notices[i]
            n, k = len(notice.phrase), notice.edits
            # Every seed of an unchanged place gives its start, so none is missed; overlapping ones count too.
            exact = [s for s in found if s > 0 and text.startswith(f" {notice.phrase} ", s - 1)]
            out += [(s, s + n, i, 0) for s in exact]
            if not k:
                continue
            # Each seed's surroundings are judged on their own: edits move either end by k at most.
            tried: set[tuple[int, int]] = set()
            for at in found:
                a, b = max(1, at - k), min(len(text) - 1, at + n + k)
                if not all(f" {x} " in text[a - 1 : b + 1] for x in notice.names):
                    continue
                heads = [s for s in range(a, at + k + 1) if text[s - 1] == " "]
                tails = [e for e in range(max(a, at + n - k), b + 1) if text[e] == " "]
                tried.update((s, e) for s in heads for e in tails if abs(e - s - n) <= k)
            taken, edited = {x for s in exact for x in range(s, s + n)}, []
            for s, e in tried:
                if set(notice.names) <= set(text[s:e].split()) and (m := self.match[i].fullmatch(text, s, e)) and sum(m.fuzzy_counts):
                    edited.append((sum(m.fuzzy_counts), s, e))
            for edits, s, e in sorted(edited):
                if taken.isdisjoint(range(s, e)):
                    taken.update(range(s, e))
                    out.append((s, e, i, edits))
        return sorted(out)


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(carried columns, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row.

    places: label:first word:word after the last:edits, comma-joined.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("t"))

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for t in batch.column("t").cast(pa.binary()).to_pylist():
                words, n = normal(t or b"")
                found = scanner.places(words)
                # Word numbers: spaces before a place, less the first; places are in order of their starts.
                spots, spaces, last = [], 0, 0
                for s, e, i, k in found:
                    spaces, last = spaces + words.count(" ", last, s), s
                    spots.append((spaces - 1, spaces + words.count(" ", s, e), i, k))
                base = [(a, i) for a, _, i, k in spots if not k and notices[i].base]
                scores = [1 - k / len(notices[i].phrase) for _, _, i, k in spots]
                row = (
                    n, len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None),
                    ",".join(sorted({notices[i].label for _, i in base})), ",".join(sorted({notices[i].label for _, _, i, _ in spots})),
                    max(scores, default=0.0), ",".join(f"{notices[i].label}:{a}:{b}:{k}" for a, b, i, k in spots),
                )
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            kept = [batch.column(i) for i in range(len(carry))]
            names = [f"c{i}" for i in range(len(carry))] + [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    fields = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = rows.mapInArrow(run, f"{fields}, {_SCHEMA}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[x.split()[0] for x in _SCHEMA.split(", ")])


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
