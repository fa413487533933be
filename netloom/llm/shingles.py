"""Word shingles of many texts at once, as 64-bit hashes in NumPy arrays."""

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd base and a random number for each byte; powers of the base and of its inverse.
_BASE = U(int(_RNG.integers(1, 2**63)) * 2 + 1)
_BACK = U(pow(int(_BASE), -1, 2**64))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes that are hashed together (some 40 times as much is held then); longer texts are a piece of their own.
PIECE = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finisher of SplitMix64)."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            cls.up, cls.down = _powers(_BASE, size), _powers(_BACK, size)
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ~blank
    start[1:] &= blank[:-1] | edge[1:-1]
    end = ~blank
    end[:-1] &= blank[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _Tables.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[:len(data)], out=sums[1:])
    words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > 256):  # long words could be made to collide
        import xxhash

        words[i] = U(xxhash.xxh3_64_intdigest(LOWER[data[first[i]:last[i]]].tobytes()))
    return words, np.searchsorted(offsets, first, "right") - 1


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, text after text; and their bounds.

    A text of fewer than ``width`` words has its whole sequence as one shingle; one without words
    has none."""
    texts = len(offsets) - 1
    words, doc = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=texts)
    begin = np.concatenate([[0], np.cumsum(count)])
    full = max(0, len(words) - width + 1)
    h = np.zeros(full, np.uint64)
    for j in range(width):
        h = mix(h + words[j:j + full], j + 1)
    whole = doc[:full] == doc[width - 1:] if full else np.zeros(0, bool)
    h, owner = h[whole], doc[:full][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            x[has] = mix(x[has] + words[begin[short[has]] + j], 100 + j)
        h, owner = np.concatenate([h, mix(x, 99)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(texts + 1))


def texts_of(column, piece: int = PIECE) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """An Arrow binary column in pieces: first row, end row, bytes, offsets. Nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return []
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(raw, raw[at] + piece, "right")) - 1)
        to = min(to, n)
        out.append((at, to, data[raw[at]:raw[to]], (raw[at:to + 1] - raw[at]).astype(np.int64)))
        at = to
    return out
