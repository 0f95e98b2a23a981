"""Token boundaries of a byte-level BPE without a regular expression.

Texts become arrays of code points, code points become classes by one table look-up, and boundaries
follow from the classes of neighbours. Only contractions ('s, 're, ...) depend on what came before: an
apostrophe starts one unless it continues a run of symbols. That is a four-state machine; each
character is a function from states to states, packed into one byte, and functions compose by a
256 x 256 table. Composition is associative, so the states at all positions come from a prefix scan over
whole batches of texts, in a few array operations.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, END = range(7)

#: Unicode White_Space (fixed values of the standard), the blank itself apart.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: States: free, in a run of symbols, before the last and before the last but one letter of a contraction.
FREE, RUN, ONE, TWO = range(4)


def _function(free: int, run: int, one: int, two: int) -> int:
    return free | run << 2 | one << 4 | two << 6


_F_TEXT = _function(FREE, FREE, FREE, ONE)
_F_SYMBOL = _function(RUN, RUN, RUN, RUN)
_F_ONE = _function(ONE, RUN, RUN, RUN)
_F_TWO = _function(TWO, RUN, RUN, RUN)
_F_END = _function(FREE, FREE, FREE, FREE)


@cache
def class_table() -> np.ndarray:
    """Class of every code point, and of the number after the last, which ends a text."""
    table = np.zeros(0x110001, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    table[_WHITE] = SPACE
    table[0x20] = BLANK
    table[0x27] = QUOTE
    table[0x110000] = END
    return table


@cache
def _compose() -> np.ndarray:
    """``[f, g]``: first f, then g."""
    f = np.arange(256, dtype=np.uint16)
    out = np.zeros((256, 256), np.uint8)
    for state in range(4):
        after = (f >> (2 * state)) & 3
        out |= (((f[None, :] >> (2 * after[:, None])) & 3) << (2 * state)).astype(np.uint8)
    return out


@cache
def _constant() -> np.ndarray:
    f = np.arange(256)
    return ((f & 3) == (f >> 2 & 3)) & ((f & 3) == (f >> 4 & 3)) & ((f & 3) == (f >> 6 & 3))


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State after each position, from FREE before the first, by doubling steps of composition.

    A position whose composed function is constant no longer depends on what came before, so the scan
    goes on only at the positions that are still open; it ends when none is.
    """
    if not len(functions):
        return np.zeros(0, np.uint8)
    compose, constant = _compose(), _constant()
    total = functions.copy()
    total[0] = _function(*[total[0] & 3] * 4)
    open_at = np.flatnonzero(~constant[total])
    step = 1
    while len(open_at):
        total[open_at] = compose[total[open_at - step], total[open_at]]
        open_at = open_at[~constant[total[open_at]]]
        step *= 2
    return total & 3


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with one end mark after each text, and the position of each text's first."""
    joined = np.frombuffer("\U0010ffff".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    points = joined.astype(np.uint32)
    points[starts[1:] - 1] = 0x110000
    return points, starts


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether a token starts at each position; end marks count as starts."""
    n = len(points)
    cls = class_table()[points]
    after = np.append(cls[1:], END)
    before = np.insert(cls[:-1], 0, END)
    functions = np.full(n, _F_TEXT, np.uint8)
    functions[(cls == OTHER) | (cls == QUOTE) | (cls == BLANK)] = _F_SYMBOL
    functions[cls == END] = _F_END
    functions[cls == SPACE] = _F_END
    quotes = np.flatnonzero(cls == QUOTE)
    one = points[np.minimum(quotes + 1, n - 1)]
    two = points[np.minimum(quotes + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(quotes), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    functions[quotes[short]] = _F_ONE
    functions[quotes[long]] = _F_TWO
    state = scan_states(functions)
    prior = np.insert(state[:-1], 0, FREE)
    prior2 = np.insert(prior[:-1], 0, FREE)
    inside = (prior == ONE) | (prior == TWO)
    ended = prior2 == ONE
    contraction = (state == ONE) | (state == TWO)
    contraction &= cls == QUOTE
    symbol = (cls == OTHER) | (cls == QUOTE)
    white, white_before, white_after = (cls == SPACE) | (cls == BLANK), (before == SPACE) | (before == BLANK), (after == SPACE) | (after == BLANK)
    same = np.where(symbol, (before == OTHER) | (before == QUOTE), cls == before)
    start = ~white & ~same & (before != BLANK)
    start |= white & (~white_before | (~white_after & (after != END)))
    start |= contraction | ended
    start &= ~inside
    return start | (cls == END) | (before == END)


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pieces in order, the start of each piece within its text, and pieces per text."""
    points, starts = code_points(texts)
    if not len(points):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(boundaries(points))
    ends = np.append(at[1:], len(points))
    real = points[at] != 0x110000
    at, ends = at[real], ends[real]
    owner = np.searchsorted(starts, at, side="right") - 1
    joined = "\x00".join([*texts, ""])
    pieces = [joined[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    return pieces, at - starts[owner], np.bincount(owner, minlength=len(texts))


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null reads as the empty text."""
    return [t or "" for t in column.to_pylist()]
