"""A cover of positions such that equal strings share a covered position.

In every SHORT-byte window, the GRAM-byte substring with the least hash is the
window's anchor (the last one, if several are least). It depends on the
window's bytes alone, so two equal windows have their anchors at the same
distance. About one position in (SHORT - GRAM) / 2 becomes an anchor. A longer
string goes by the anchor of the window that it begins with.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest strings that are decided on, of the shortest ones, and of an anchor.
LENGTH = 400
SHORT = 256
GRAM = 96
#: Windows of a text that are handled as one.
PART = 1 << 19
#: Bytes handled at once.
BLOCK = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_MASK = 2**64 - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_B**i and its inverse's powers, modulo 2**64."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _POWERS:
        both = []
        for base in (_B, pow(_B, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima of blocks of w from both ends."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], forward[w - 1 : w - 1 + n])


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first, last, stop, at, gram hash, context hash) of each run of windows with one anchor.

    Texts are data[starts[i]:ends[i]]; windows that begin PART bytes or more
    from a text's start are left to its next part. first and last are the starts
    of the run's windows and at the anchor's, from the text's start. The
    context, up to stop, is LENGTH bytes from the last window's start, or fewer
    at the text's end; it holds all that decides about the run.
    """
    a = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(a) < SHORT:
        return (none,) * 7
    power, inverse = _powers(len(a) + 1)
    h = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * power[: len(a)], out=h[1:])
    g = _mix((h[GRAM:] - h[: len(a) - GRAM + 1]) * inverse[: len(a) - GRAM + 1])
    low = np.uint64(2 * BLOCK - 1)
    order = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
    least = sliding_least(order, SHORT - GRAM + 1)
    at = (low - (least & low)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    end = ends[text]
    s = np.arange(len(at))
    good = (s + SHORT <= end) & (s < starts[text] + PART)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
    firsts = np.flatnonzero(new & good)
    change = np.append(np.flatnonzero(new | ~good), len(at))
    lasts = change[np.searchsorted(change, firsts, "right")] - 1
    p = at[firsts]
    stops = np.minimum(lasts + LENGTH, end[firsts])
    context = (h[stops] - h[firsts]) * inverse[firsts]
    for x, by in ((lasts - firsts, 0x632BE59BD9B4E019), (p - firsts, 0x8CB92BA72F3D8DD7), (stops - firsts, 0xD6E8FEB86659FD93)):
        context += x.astype(np.uint64) * np.uint64(by)
    base = starts[text[firsts]]
    return text[firsts], firsts - base, lasts - base, stops - base, p - base, g[p].view(np.int64), _mix(context).view(np.int64)
