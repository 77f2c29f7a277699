"""Arrow helpers for functions over the tokens of one document, where the document's row lies."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens in order of their code points, and each token's number. No token is null."""
    coded = tokens.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def each(lists: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Row, distinct tokens and numbered tokens of each row that has tokens; nulls among them do not count."""
    for i in range(len(lists)):
        tokens = lists[i].values
        if tokens is not None and len(tokens := tokens.drop_null()):
            yield i, *numbered(tokens)


def lists_of(parts: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
    """One list for each part."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.concat_arrays([x.cast(kind) for x in parts]) if parts else pa.array([], kind))


def ngrams(words: pa.Array, codes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and neighbouring pairs joined by _, in order of their code points, how often each stands there, and the place of each word."""
    n = len(words)
    pairs, times = np.unique(codes[:-1] * n + codes[1:], return_counts=True)
    joined = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), "_")
    terms, counts = pa.concat_arrays([words, joined]), np.concatenate([np.bincount(codes, minlength=n), times])
    order = pc.array_sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms, counts = terms.take(pa.array(order)), counts[order]
    if pc.any(pc.match_substring(words, "_")).as_py():  # then a pair may read like a word or another pair
        terms, codes_of = numbered(terms)
        counts, place = np.bincount(codes_of, counts).astype(np.int64), codes_of[place]
    return terms, counts, place[:n]


def round6(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero, as the decimal form of each number says: Spark's round()."""
    scaled = np.abs(x) * 1e6
    whole = np.floor(scaled)
    whole += scaled - whole >= 0.5
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-9 * np.maximum(scaled, 1)):
        whole[i] = float(Decimal(repr(float(abs(x[i])))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6))
    return np.copysign(whole / 1e6, x)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first ones among equals, in order."""
    return np.argsort(-scores, kind="stable")[:k]


#: Rows in an Arrow batch of results.
ROWS = 10_000


def gathered(parts: Iterator[list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of many small results as batches of ROWS rows and more: a batch for each result would cost more than the result."""
    held: list[list[pa.Array]] = []
    n = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield batch()
            held, n = [], 0
    if n:
        yield batch()
