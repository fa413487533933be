"""Runs of repeated words: branching tandem repeats of an enhanced suffix array, merged into maximal runs.

All words of a batch of texts get one suffix array by prefix doubling (only groups that are still equal are
sorted again), with the ranks of every doubling kept. They give the common prefix of neighbours, and
with the previous and next smaller values the intervals of equal common prefix, which stand for the nodes of
a suffix tree without one being built. In an interval of depth D the suffixes of all children but the largest are
asked whether the suffix D words on, or D words back, lies in the interval: the inverse array says so. If
the words that follow differ, that is a square that cannot be moved to the right, so its end is the end of a
run. It is rotated to the left as far as words stay equal, by powers of two, again by the kept
ranks. Squares with the same start and end belong to one run, whose period is the smallest.

The children but the largest hold at most n log n suffixes altogether, so a text costs n log n however
periodic it is.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null

#: Words that share one suffix array; a longer text has one of its own.
BATCH_WORDS = 400_000
#: Rounds of pointer jumping before a table of minima is made.
JUMPS = 48


def suffix_ranks(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array of texts laid end to end, ranks by the first 2**k words for every k until all differ, and
    the common prefix of each suffix with the one before. ``words`` are numbers from 0 that no two texts
    share, ``end`` the end of each word's text. A rank is the first place of its group."""
    n = len(words)
    count = np.bincount(words)
    first = np.cumsum(count) - count
    rank = first[words].astype(np.int32)
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)  # right where the word is the only one of its kind
    level = np.full(n, -1, np.int8)
    level[first[count > 0]] = 0
    slots = np.flatnonzero(np.repeat(count > 1, count))
    busy = np.flatnonzero(count[words] > 1)
    sa[slots] = busy[np.argsort(words[busy], kind="stable")]
    ranks = [rank]
    width = 1
    while len(slots):
        own = sa[slots]
        after = own + width
        inside = after < end[own]
        follow = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[own].astype(np.int64) * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = slots[new]
        level[fresh[level[fresh] < 0]] = len(ranks)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(slots)))
        rank = rank.copy()
        rank[own] = np.repeat(fresh, size)
        ranks.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        width *= 2
    lcp = np.zeros(n, np.int32)
    for k in range(1, len(ranks)):
        at = np.flatnonzero(level == k)
        a, b = sa[at - 1], sa[at]
        same = np.full(len(at), 1 << (k - 1), np.int32)
        for m in range(k - 2, -1, -1):
            x, y = a + same, b + same
            fine = (x < end[a]) & (y < end[b])
            equal = fine & (ranks[m][np.where(fine, x, 0)] == ranks[m][np.where(fine, y, 0)])
            same += equal.astype(np.int32) << m
        lcp[at] = same
    return sa, ranks, lcp


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place with x > 0 the last place before it with a smaller value; x[0] must be 0."""
    at = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(x > 0)
    open_ = open_[x[at[open_]] >= x[open_]]
    for _ in range(JUMPS):
        if not len(open_):
            return at
        at[open_] = at[at[open_]]
        open_ = open_[x[at[open_]] >= x[open_]]
    least = [x]  # least of the 2**k values up to each place; -1 where there are fewer
    while 2 << (len(least) - 1) <= len(x):
        half = 1 << (len(least) - 1)
        more = np.full(len(x), -1, x.dtype)
        more[half:] = np.minimum(least[-1][half:], least[-1][:-half])
        more[:2 * half - 1] = -1
        least.append(more)
    place = at[open_]
    for k in range(len(least) - 1, -1, -1):
        place = np.where(least[k][place] >= x[open_], place - (1 << k), place)
    at[open_] = place
    return at


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Children but the largest of every interval with a common prefix: first and end place of the child,
    depth of the interval, its first and its last place."""
    n = len(lcp)
    at = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none, none
    left = previous_smaller(lcp)[at]
    right = n - previous_smaller(np.concatenate([lcp[:1] * 0, lcp[::-1]]))[n - at]  # one beyond the last
    depth = lcp[at].astype(np.int64)
    order = np.argsort(left * (depth.max() + 1) + depth, kind="stable")
    at, left, right, depth = at[order], left[order], right[order], depth[order]
    new = np.ones(len(at), bool)
    new[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    head = np.flatnonzero(new)
    last = np.append(new[1:], True)
    begin = np.concatenate([left[head], at])
    stop = np.concatenate([at[head], np.where(last, right, np.append(at[1:], 0))])
    owner = np.concatenate([np.arange(len(head)), np.cumsum(new) - 1])
    by = np.lexsort((begin - stop, owner))
    small = np.ones(len(by), bool)
    small[np.searchsorted(owner[by], np.arange(len(head)))] = False  # the largest comes first
    pick = by[small]
    whole = head[owner[pick]]
    return begin[pick], stop[pick], depth[whole], left[whole], right[whole] - 1


def find_runs(words: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of at least ``least`` words, by start and period. ``start`` and ``end``
    bound the text of each word."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    sa, ranks, lcp = suffix_ranks(words, end)
    isa = ranks[-1]
    begin, stop, depth, left, right = intervals(lcp)
    size = stop - begin
    slot = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    d, left, right = (np.repeat(x, size) for x in (depth, left, right))
    i = sa[slot].astype(np.int64)
    squares = []
    for at, other in ((i, i + d), (i - d, i - d)):  # a square begins at ``at``; ``other`` is the half not asked from
        fine = (other >= start[i]) & (other < end[i])
        place = isa[np.where(fine, other, 0)]
        fine &= (place >= left) & (place <= right)
        a, period = at[fine], d[fine]
        after = a + 2 * period
        over = after >= end[a]
        differs = over | (words[a + period] != words[np.where(over, 0, after)])
        squares.append((a[differs], period[differs]))
    a, d = (np.concatenate(x) for x in zip(*squares, strict=True))
    if not len(a):
        return none, none, none
    stop = a + 2 * d
    for m in range(len(ranks) - 1, -1, -1):
        back = a - (1 << m)
        fine = back >= start[stop - 1]
        fine &= ranks[m][np.where(fine, back, 0)] == ranks[m][np.where(fine, back + d, 1 if len(words) > 1 else 0)]
        a = np.where(fine, back, a)
    long = stop - a >= least
    a, stop, d = a[long], stop[long], d[long]
    order = np.lexsort((d, stop, a))
    a, stop, d = a[order], stop[order], d[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (stop[1:] != stop[:-1])
    a, stop, d = a[keep], stop[keep], d[keep]
    order = np.lexsort((d, a))
    return a[order], stop[order], d[order]


def judge(texts: list[bytes | None], least: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    at = 0
    while at < len(texts):
        lists, numbers, sizes, base, total = [], [], [], 0, 0
        while at < len(texts) and (not lists or total < BATCH_WORDS):
            split = (texts[at] or b"").split()  # at the six ASCII blanks
            ids = {w: k for k, w in enumerate(dict.fromkeys(split), base)}
            numbers.append(np.fromiter(map(ids.__getitem__, split), np.int64, len(split)))
            base += len(ids)
            lists.append(split)
            sizes.append(len(split))
            total += len(split)
            at += 1
        sizes = np.array(sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        a, stop, d = find_runs(np.concatenate(numbers), np.repeat(starts, sizes), np.repeat(ends, sizes), least)
        doc = np.searchsorted(ends, a, "right")
        first, last = np.searchsorted(doc, np.arange(len(sizes))), np.searchsorted(doc, np.arange(len(sizes)), "right")
        for k, split in enumerate(lists):
            rows = slice(first[k], last[k])
            if first[k] == last[k]:
                yield len(split), [], b" ".join(split)
                continue
            s, e, q = a[rows] - starts[k], stop[rows] - starts[k], d[rows]
            marks = np.zeros(len(split) + 1, np.int64)
            np.add.at(marks, s + q, 1)
            np.add.at(marks, e, -1)
            kept = np.cumsum(marks)[:-1] == 0
            found = [{"start": x, "length": y - x, "period": z} for x, y, z in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)]
            yield len(split), found, b" ".join(split[j] for j in np.flatnonzero(kept).tolist())


def _judge(least: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            step = 512  # rows of one output frame
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = list(judge(part.column("text").to_pylist(), least))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], span), pa.array([x[2] for x in found], pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    ``runs`` are all maximal stretches of at least ``least`` words and twice their smallest period, as
    ``start, length, period`` by start, then period; words are counted from 0 and parted by
    ``[\\x20\\x09-\\x0D]+``. ``collapsed`` are the words that no run holds after its first period, joined by
    one blank. A null or empty text has no words, no runs and an empty ``collapsed``. Each row is
    judged on its own: rows that repeat an id, and rows with a null id, are kept as they are. Texts of any
    length are taken whole, within one task. Other columns play no part. Nothing is shuffled.
    """
    texts = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "text", "string").cast("binary").alias("text"),
    )
    kind = "doc_id bigint, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
    return texts.mapInArrow(_judge(least), kind)
