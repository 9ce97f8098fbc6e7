"""Words and character n-grams of Arrow text columns as numpy arrays of 64-bit hashes, a bounded slice at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: So many bytes of text are taken at a time; one longer text makes a slice of its own.
SLICE_BYTES = 750_000
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to words, and the byte after A-Z are lower-cased."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    low = np.arange(256, dtype=U64)
    if lower:
        low[65:91] += 32
    return inside, low


#: Words in the sense of [^\x20\x09-\x0D]+, and runs of ASCII letters, digits and all non-ASCII characters.
PLAIN = table(b" \t\n\x0b\x0c\r")
ALNUM = table(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them well."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array):
    """Yields (first row, rows, bytes, offsets): runs of rows of at most SLICE_BYTES, or single rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield at, to - at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(raw: np.ndarray, off: np.ndarray, kind=PLAIN, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the row it is in, in order; after them the same of the prefixes of so many bytes of the
    words that are longer."""
    inside, low = kind
    if not len(raw):
        return np.empty(0, U64), np.empty(0, np.int64)
    flag = inside[raw]
    before = np.empty_like(flag)
    before[0] = False
    before[1:] = flag[:-1]
    firsts = off[:-1][off[:-1] < len(raw)]
    before[firsts] = False
    after = np.empty_like(flag)
    after[-1] = False
    after[:-1] = flag[1:]
    after[firsts[firsts > 0] - 1] = False
    start = np.flatnonzero(flag & ~before)
    end = np.flatnonzero(flag & ~after) + 1
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum((low[raw] + U64(1)) * up[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    rows = np.searchsorted(off, start, "right") - 1
    hashes, where = [mix(h + (end - start).astype(U64))], [rows]
    for n in prefixes:
        long = np.flatnonzero(end - start > n)
        first = start[long]
        hashes.append(mix((total[first + n] - total[first]) * down[first] + U64(n + (1 << 40))))
        where.append(rows[long])
    return (hashes[0], rows) if not prefixes else (np.concatenate(hashes), np.concatenate(where))


def runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Borders of the rows 0..n-1 in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def char_ngrams(texts: list[str], orders: int, dim_bits: int, letter: np.ndarray):
    """(hashed n-grams of orders 1.., row of each, whether each row has a letter). Case is folded by str.lower and what
    isn't a letter counts as a space; each row is followed by spaces, so that no n-gram reaches into the next."""
    gap = " " * orders
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + orders for t in lowered])
    cp = np.frombuffer((gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[cp]
    rows = np.repeat(np.arange(len(texts)), sizes)
    c = np.where(is_letter, cp, 32).astype(U64)
    blank = ~is_letter
    out, where = [], []
    h = np.zeros(len(c), U64)
    for k in range(orders):
        h = h[: len(c) - k] * U64(0x100000001B3) + c[k:]
        h = h if k else c.copy()
        keep = ~blank if k == 0 else ~(blank[: len(h)] & blank[k : k + len(h)])
        g = (mix(h + U64(k << 40)) >> U64(64 - dim_bits)).astype(np.int64)
        out.append(g[keep[: len(g)]])
        where.append(rows[: len(h)][keep[: len(h)]])
    has = np.zeros(len(texts), bool)
    has[rows[is_letter]] = True
    return out, where, has


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _POWERS:
        _POWERS["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _POWERS["letters"]
