"""Vectorised splitting of text before byte-level BPE merges, for operators 2 and 3.

The usual byte-level split (contractions, letters, digits, other signs, white space, each with one leading blank) runs
without a regular expression. Code points become classes, classes with one code point of look-ahead become symbols, and
each symbol is a transition function on eight states. Functions compose associatively: the symbols are cut into rows,
all rows are composed at once for every possible entry state, a short scan over rows gives each row's real entry state,
and a second sweep marks where pieces start.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

LETTER, NUMBER, OTHER, SPACE = range(4)
#: White_Space of Unicode.
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Symbols: letter, number, other, blank before a non-blank, other white space before a non-blank, white space before
#: white space or the end, apostrophe that may start a contraction of one or two letters. Eight more: first in its text.
N_SYM, N_STATE = 16, 8
#: States: closed, in letters, in numbers, in others, after a leading blank, in white space, one or two letters to go.
CLOSED, IN_L, IN_N, IN_O, LEAD, IN_W, TAKE1, TAKE2 = range(N_STATE)
WIDTH, TAIL = 256, 24


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece starts here) for each symbol and state."""
    to, starts = np.zeros((N_SYM, N_STATE), np.uint8), np.zeros((N_SYM, N_STATE), bool)
    for state in range(N_STATE):
        for sym in range(8):
            if sym == 0:
                goes, begins = (CLOSED, False) if state == TAKE1 else (TAKE1, False) if state == TAKE2 else (IN_L, state not in (IN_L, LEAD))
            elif sym == 1:
                goes, begins = IN_N, state not in (IN_N, LEAD)
            elif sym == 2:
                goes, begins = IN_O, state not in (IN_O, LEAD)
            elif sym == 3:
                goes, begins = LEAD, True
            elif sym == 4:
                goes, begins = CLOSED, True
            elif sym == 5:
                goes, begins = IN_W, state != IN_W
            elif state in (IN_O, LEAD):
                goes, begins = IN_O, False
            else:
                goes, begins = (TAKE1 if sym == 6 else TAKE2), True
            to[sym, state], starts[sym, state] = goes, begins
        for sym in range(8):
            to[sym + 8, state], starts[sym + 8, state] = to[sym, CLOSED], True
    # first in its text, whatever came before
    for sym in range(8):
        to[sym + 8, :] = to[sym, CLOSED]
    return to, starts


def _classes() -> np.ndarray:
    """Class of each code point."""
    found = worker_cache().get("classes")
    if found is None:
        found = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                found[cp] = LETTER
            elif kind == "N":
                found[cp] = NUMBER
        found[list(BLANKS)] = SPACE
        worker_cache()["classes"] = found
    return found


def _composed(flat: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Each row's functions composed from left to right: the last state for each of the entry states."""
    comp = np.broadcast_to(np.arange(N_STATE, dtype=np.uint8), (cells.shape[1], N_STATE)).copy()
    for col in cells:
        comp = flat[(col[:, None].astype(np.uint16) << 3) + comp]
    return comp


def starts_of(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start. cps: code points of several texts end to end; first: True at the first of each text."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[cps]
    after = np.empty(n, np.uint8)  # class of what follows in the same text; SPACE also at its end
    after[:-1], after[-1] = kind[1:], SPACE
    after[:-1][first[1:]] = SPACE
    sym = kind.copy()
    blank = kind == SPACE
    sym[blank] = 5
    sym[blank & (after != SPACE)] = 4
    sym[blank & (after != SPACE) & (cps == 0x20)] = 3
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        ahead = np.zeros((len(at), 2), np.int64)
        for k in (1, 2):
            there = at + k < n
            ok = np.zeros(len(at), bool)
            ok[there] = ~first[(at + k)[there]]
            if k == 2:
                ok &= ahead[:, 0] > 0
            ahead[ok, k - 1] = cps[at[ok] + k]
        a, b = ahead[:, 0], ahead[:, 1]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[at[one]], sym[at[two]] = 6, 7
    sym[first] += 8
    to, starts = _automaton()
    rows = -(-n // WIDTH)
    cells = np.zeros(rows * WIDTH, np.uint8)
    cells[:n] = sym
    cells = np.ascontiguousarray(cells.reshape(rows, WIDTH).T)
    flat = to.ravel()
    comp = _composed(flat, cells[-TAIL:])  # a row's last symbols nearly always fix its last state
    open_rows = np.flatnonzero((comp != comp[:, :1]).any(1))
    if len(open_rows):
        comp[open_rows] = _composed(flat, cells[:, open_rows])
    entry, state = np.empty(rows, np.uint8), CLOSED
    for r, f in enumerate(comp.tolist()):
        entry[r] = state
        state = f[state]
    both = (to | starts.astype(np.uint8) << 3).ravel()  # next state, and above it whether a piece starts
    out, state = np.empty((WIDTH, rows), np.uint8), entry.astype(np.intp)
    for w, col in enumerate(cells):
        np.take(both, (col.astype(np.intp) << 3) + state, out=out[w], mode="clip")
        state = (out[w] & 7).astype(np.intp)
    return out.T.ravel()[:n] > 7


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers that a worker keeps between calls; longer runs of values get theirs anew.
KEPT_POWERS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = tuple(np.full(size, b, np.uint64) for b in (BASE, INVERSE))
        for powers in have:
            powers[0] = 1
            np.cumprod(powers, out=powers)
        if size <= KEPT_POWERS + 1:
            cache["powers"] = have
    return have[0][:n], have[1][:n]


def slice_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[begin:end]. Different slices can share one, so it only sorts; distinct() compares."""
    n = len(values)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    held = values.astype(np.uint64)
    held += np.uint64(1)
    held *= down[:n]
    np.cumsum(held, out=sums[1:])
    h = (sums[end] - sums[begin]) * up[begin]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= (end - begin).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes=slice_hashes) -> tuple[np.ndarray, np.ndarray]:
    """(a slice of each kind, kind of every slice) of values[begin:end], exactly.

    Slices of one hash are compared value by value with the first of them; those that differ from it become kinds of
    their own by their content.
    """
    _, some, index = np.unique(hashes(values, begin, end), return_index=True, return_inverse=True)
    size, lead = end - begin, some[index]
    same = size == size[lead]
    shift = np.where(same, begin[lead] - begin, 0)
    ends, other = np.cumsum(size), np.repeat(shift, size)
    if len(begin) and (begin[1:] == end[:-1]).all():  # slices without gaps: their values are one run
        own = values[begin[0] : end[-1]]
        other += np.arange(begin[0], end[-1])
    else:
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        own, other = values[at], other + at
    off = np.flatnonzero(own != np.take(values, other, mode="clip"))
    same[np.searchsorted(ends, off, side="right")] = False
    odd = np.flatnonzero(~same)
    if len(odd):
        kinds, more = {}, some.tolist()
        for i in odd.tolist():
            key = values[begin[i] : end[i]].tobytes()
            if key not in kinds:
                kinds[key] = len(more)
                more.append(i)
            index[i] = kinds[key]
        some = np.array(more)
    return some, index


def pieces(texts: list[bytes]):
    """Distinct pieces of the texts, and per text the number of each of its pieces.

    (list of distinct pieces as bytes, index of each piece in order, number of pieces per text)
    """
    whole = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.array([len(t) for t in whole], np.int64)
    joined = "".join(whole)
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    first = np.zeros(len(cps), bool)
    first[(ends - lengths)[lengths > 0]] = True
    begin = np.flatnonzero(starts_of(cps, first))
    end = np.append(begin[1:], len(cps))
    if not len(begin):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    utf8 = joined.encode()
    offsets = np.append(begin, len(cps))
    if len(utf8) > len(cps):
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(np.uint8(1) + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=at[1:])
        offsets = at[offsets]
    spans = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)])
    kinds = spans.dictionary_encode()  # a hash table that compares bytes
    per_text = np.searchsorted(begin, ends) - np.searchsorted(begin, ends - lengths)
    return kinds.dictionary.to_pylist(), kinds.indices.to_numpy(), per_text


#: Bytes of text that a task works on at once.
CHUNK = 1 << 20


def text_runs(column: pa.Array, most: int = CHUNK, rows: int = 2000) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first row, texts as bytes) of runs of rows, cut so that a task's Python objects stay few.

    A run has at most so many bytes and rows; a longer text is a run of its own. Null counts as empty.
    """
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
        stop = min(max(stop, at + 1), at + rows, n)
        yield at, [t or b"" for t in column.slice(at, stop - at).cast(pa.binary()).to_pylist()]
        at = stop


class TwoGenerations(dict):
    """A cache bounded by the size of its values: when it is full, what was used since the last time stays."""

    def __init__(self, most: int = 24 << 20):
        super().__init__()
        self.most, self.size, self.old = most, 0, {}

    def __missing__(self, key):
        return None if (v := self.old.get(key)) is None else self.put(key, v)

    def many(self, keys: list[bytes]) -> list:
        """What is known of each key, else None."""
        found = list(map(self.get, keys))
        for i, v in enumerate(found):
            if v is None and (v := self.old.get(keys[i])) is not None:
                found[i] = self.put(keys[i], v)
        return found

    def put(self, key: bytes, value, size: int | None = None):
        """size: about how many bytes the value takes; a value of over a thousandth of all is not kept."""
        size = 180 + 5 * len(key) if size is None else size
        if size > self.most // 1000:
            return value
        if self.size + size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[key] = value
        return value
