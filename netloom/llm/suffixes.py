"""Removal of byte strings that occur before, by sorting suffixes over all documents.

A string counts if it has ``LENGTH`` bytes. Each window of that length has an anchor: the place
of its least hashed gram, which depends on the window's bytes alone. Neighbouring windows mostly
share their anchor, and all of one anchor form a block of text. Three steps follow.

1. Anchors meet by gram. A block that is equal to an earlier one is covered as a whole; blocks
   whose gram occurs in no other block have nothing to be compared with.
2. Of the rest, where blocks share a gram but differ, one occurrence of each block gives the suffix
   that begins at its anchor, as far as its windows reach. Tasks sort theirs into runs, which
   travel front-coded: each suffix as the length of the prefix it shares with the one before, and
   its other bytes. Splitters cut all runs alike, and each range is merged by a loser tree that
   keeps for every loser the prefix it shares with the winner, so that no comparison reads a
   prefix that is known. The common prefixes that come out tell which windows agree to the
   right of their anchor; of these, those are equal that also agree to the left of it.
3. The spans found are united for each document.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shingles import _BYTE, _Tables, U, mix, texts_of
from netloom.llm.store import column_or_null, written

LENGTH, GRAM = 100, 40
#: Bytes of text for one task of the first exchange, suffixes of a run, and suffixes a merging task gets.
PART_BYTES, RUN, MERGE = 6_000_000, 50_000, 50_000
#: Bytes of text that are cut into blocks at once, and whose blocks are sent on together.
PIECE, SENT = 1 << 18, 1 << 22
#: Blocks whose suffixes the splitters are taken from.
SAMPLE = 4_096


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Of texts in one buffer: for each run of windows with one anchor its text, first and last window
    (places in the text), the anchor's gram and a hash of the whole block."""
    names = ("doc", "first", "last", "anchor", "gram", "block")
    n = len(data) - length + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "block") else np.int64) for k in names}
    up, down = _Tables.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1], 31)
    width = length - gram + 1
    least, size = h, 1
    while 2 * size <= width:
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    good = np.ones(n, bool)
    for at in offsets[1:-1]:  # windows must not run over a text's end
        good[max(0, at - length + 1):at] = False
    begin = good.copy()
    begin[1:] &= (least[1:] != least[:-1]) | (h[:n - 1] == least[:-1]) | ~good[:-1]
    # the first window of a text is a beginning even if the one before is good
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begin[inner] |= good[inner]
    first = np.flatnonzero(begin)
    stop = good.copy()
    stop[:-1] &= begin[1:] | ~good[1:]
    last = np.flatnonzero(stop)
    value = least[first]
    anchor = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 12):
        f = first[k:k + (1 << 12)]
        anchor[k:k + (1 << 12)] = f + (h[f[:, None] + np.arange(width)] == value[k:k + (1 << 12), None]).argmax(1)
    end = last + length
    whole = mix((sums[end] - sums[first]) * down[first] + mix(((end - first) * 4096 + anchor - first).astype(np.uint64), 32), 33)
    doc = np.searchsorted(offsets, first, "right") - 1
    return {"doc": doc, "first": first - offsets[doc], "last": last - offsets[doc], "anchor": anchor - first, "gram": value, "block": whole}


def _earlier(ids: np.ndarray, first: np.ndarray, gram: np.ndarray, block: np.ndarray):
    """Order of the blocks, which of them are the first of their kind, and which are later ones."""
    order = np.lexsort((first, ids, block, gram))
    g, b, i, f = gram[order], block[order], ids[order], first[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)
    later = (i != i[head]) | (f != f[head])  # a repeated row is not earlier than itself
    return order, new, later


def _joined(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans sorted, those that touch made one."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    if not len(ids):
        return ids, start, end
    # running maximum of the ends, document by document
    lift = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1])]).astype(np.int64)) * (1 << 40)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return ids[at], start[at], np.maximum.reduceat(end, at)


def _cutter(length: int, gram: int, bits: int):
    names = ["part", "gram", "block", "ids", "first", "last", "anchor"]

    def sent(held: list[tuple[np.ndarray, dict]]):
        import pyarrow as pa

        ids = np.concatenate([i for i, _ in held])
        b = {c: np.concatenate([x[c] for _, x in held]) for c in ("first", "last", "anchor", "gram", "block")}
        order, new, later = _earlier(ids, b["first"], b["gram"], b["block"])
        gone = order[later]
        i, s, e = _joined(ids[gone], b["first"][gone], b["last"][gone] + length)
        rows = [(-1, b"", b"", i.tobytes(), s.tobytes(), e.tobytes(), b"")] if len(i) else []
        keep = np.sort(order[new])  # in the order of the texts, which compresses better
        part = (b["gram"][keep] >> U(64 - bits)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        keep, part = keep[by], part[by]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for x, y in zip(edges, np.append(edges[1:], len(part)), strict=True):
            k = keep[x:y]
            rows.append((
                int(part[x]), b["gram"][k].tobytes(), b["block"][k].tobytes(), ids[k].tobytes(),
                b["first"][k].astype(np.int32).tobytes(), (b["last"][k] - b["first"][k]).astype(np.uint8).tobytes(),
                b["anchor"][k].astype(np.uint8).tobytes(),
            ))
        columns, kinds = zip(*rows, strict=True), [pa.int64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def cut(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            every = np.asarray(batch.column("doc_id"))
            for at, _, data, offsets in texts_of(batch.column("text"), PIECE):
                b = blocks(data, offsets, length, gram)
                if not len(b["doc"]):
                    continue
                held.append((every[at:][b["doc"]].astype(np.int64), b))
                size += len(data)
                if size >= SENT:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return cut


MET = "doc_id bigint, start bigint, end bigint, windows bigint, anchor bigint"


def _spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    ids, start, end = _joined(ids, start, end)
    return pd.DataFrame({"doc_id": ids, "start": start, "end": end})


def _meet(length: int):
    """Later blocks as spans. Blocks to be compared, that is the first of each kind where a gram has
    several kinds, have their number of ``windows`` after the first, and the place of their anchor."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] < 0:
            settled = _spans(*(np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "first", "last")))
            return settled.assign(windows=-1, anchor=-1)
        gram, block = (np.frombuffer(b"".join(rows[c]), np.uint64) for c in ("gram", "block"))
        ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
        first = np.frombuffer(b"".join(rows["first"]), np.int32).astype(np.int64)
        windows, anchor = (np.frombuffer(b"".join(rows[c]), np.uint8) for c in ("last", "anchor"))
        order, new, later = _earlier(ids, first, gram, block)
        gone = order[later]
        settled = _spans(ids[gone], first[gone], first[gone] + windows[gone] + length).assign(windows=-1, anchor=-1)
        kinds = order[new]
        g = gram[kinds]
        several = np.zeros(len(g), bool)
        several[1:] = g[1:] == g[:-1]
        several[:-1] |= several[1:]
        k = kinds[several]
        return pd.concat([settled, pd.DataFrame({
            "doc_id": ids[k], "start": first[k], "end": first[k] + windows[k] + length,
            "windows": windows[k].astype(np.int64), "anchor": anchor[k].astype(np.int64),
        })])

    return run


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each block that is to be compared."""
    for batch in batches:
        rows = []
        for doc, text, *spans in batch.itertuples(index=False):
            raw = bytes(text)
            for start, end, windows, anchor in zip(*(x.tolist() for x in spans), strict=True):
                if end <= len(raw):
                    rows.append((doc, start, windows, anchor, raw[start:end]))
        yield pd.DataFrame(rows, columns=["doc_id", "start", "windows", "anchor", "bytes"])


def front_coded(windows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefixes with the row before, and the other bytes, of sorted rows."""
    n, length = windows.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = windows[1:] != windows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), length)
    keep = np.arange(length)[None, :] >= shared[:, None]
    return shared.astype(np.uint8), windows[keep].tobytes()


def _sorted_windows(windows: np.ndarray) -> np.ndarray:
    """Order of the rows as byte strings; an end mark keeps NumPy from dropping zero bytes."""
    marked = np.concatenate([windows, np.ones((len(windows), 1), np.uint8)], axis=1)
    return np.argsort(np.ascontiguousarray(marked).view(f"S{windows.shape[1] + 1}").ravel(), kind="stable")


def _run(rows: list[tuple], splitters: list[bytes], length: int) -> list[tuple]:
    """A sorted, front-coded run of the suffixes at the blocks' anchors, cut at the splitters. A suffix
    that need not be known to its full length is filled with zeros, which nothing looks at."""
    right = np.frombuffer(b"".join(r[4][r[3]:].ljust(length, b"\0") for r in rows), np.uint8).reshape(-1, length)
    order = _sorted_windows(right)
    right = right[order]
    rows = [rows[k] for k in order.tolist()]
    edges = [0]
    for x in splitters:  # rows below a splitter go before it
        lo, hi = edges[-1], len(rows)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if right[mid].tobytes() < x else (lo, mid)
        edges.append(lo)
    edges.append(len(rows))
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            shared, rest = front_coded(right[a:b])
            own = rows[a:b]
            out.append((
                k, shared.tobytes(), rest, b"".join(r[4][:r[3]] for r in own),
                *(np.array([r[c] for r in own], t).tobytes() for c, t in ((0, np.int64), (1, np.int64), (2, np.uint8), (3, np.uint8))),
            ))
    return out


RUNS = "part bigint, shared binary, rest binary, lefts binary, ids binary, starts binary, windows binary, anchors binary"


def _runner(splitters: list[bytes], length: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = [x.split()[0] for x in RUNS.split(", ")], []
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows.append((*row[:4], bytes(row[4])))
                if len(rows) >= most:
                    yield pd.DataFrame(_run(rows, splitters, length), columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(_run(rows, splitters, length), columns=names)

    return run


def merged(runs: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """Run, place in it and length shared with the one before, for all strings in ascending order.

    A loser tree over front-coded runs. Each loser keeps how much it shares with the string that beat
    it; the one that comes up next knows how much it shares with its predecessor, which was the last
    winner. Of two that share different lengths with the last winner the longer is smaller; only if
    these are equal are bytes compared, from there on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    place = [-1] * k
    text: list[bytes | None] = [b""] * len(runs) + [None] * (k - len(runs))
    read = [0] * len(runs)

    def step(r: int) -> int:
        """The next string of the run; how much it shares with the one before."""
        shared, rest = runs[r]
        place[r] += 1
        if place[r] >= len(shared):
            text[r] = None
            return 0
        n = shared[place[r]]
        at = read[r]
        read[r] = to = at + length - n
        text[r] = text[r][:n] + rest[at:to]
        return n

    def shares(a: bytes, b: bytes, known: int) -> tuple[int, bool]:
        """Shared length, knowing a part of it, and whether a is the smaller (or equal)."""
        x, y = int.from_bytes(a[known:]), int.from_bytes(b[known:])
        return length - ((x ^ y).bit_length() + 7) // 8, x <= y

    for r in range(len(runs)):
        step(r)
    loser, lost = [0] * k, [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if text[b] is None:
            win, lose, common = a, b, 0
        elif text[a] is None:
            win, lose, common = b, a, 0
        else:
            common, less = shares(text[a], text[b], 0)
            win, lose = (a, b) if less else (b, a)
        loser[node], lost[node] = lose, common
        return win

    best, common = build(1), 0
    while text[best] is not None:
        yield best, place[best], common
        now, h = best, step(best)
        node = (now + k) // 2
        while node:
            other, g = loser[node], lost[node]
            if text[other] is not None:
                if text[now] is None or g > h:
                    loser[node], lost[node] = now, h
                    now, h = other, g
                elif g == h:
                    both, less = shares(text[now], text[other], h)
                    lost[node] = both
                    if not less:
                        loser[node] = now
                        now = other
            node //= 2
        best, common = now, h


def _merger(length: int, gram: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = np.cumsum([0, *map(len, rows["windows"])]).tolist()
        found = [(base[r] + k, n) for r, k, n in merged(list(zip(rows["shared"], rows["rest"], strict=True)), length)]
        order, shared = (np.array(x) for x in zip(*found, strict=True))
        ids, starts = (np.frombuffer(b"".join(rows[c]), np.int64)[order] for c in ("ids", "starts"))
        windows = np.frombuffer(b"".join(rows["windows"]), np.uint8).astype(np.int64)[order]
        anchors = np.frombuffer(b"".join(rows["anchors"]), np.uint8).astype(np.int64)
        # bytes to the left of the anchors, nearest first, and hashes of the nearest 0, 1, 2, ...
        lefts = np.frombuffer(b"".join(rows["lefts"]), np.uint8)
        width = length - gram
        ends = np.cumsum(anchors)
        far = np.arange(1, width + 1)
        has = far[None, :] <= anchors[:, None]
        near = np.where(has, ends[:, None] - far[None, :], 0)
        value = np.where(has, _BYTE[lefts[near]] if len(lefts) else U(0), U(0))[order]
        anchors = anchors[order]
        up, _ = _Tables.get(width + 2)
        left = np.zeros((len(order), width + 1), np.uint64)
        np.cumsum(value * up[1:width + 1], axis=1, out=left[:, 1:])
        keys, who, at = [], [], []
        for o in range(width + 1):  # windows whose anchor is o bytes in: equal to the right for length - o
            k = np.flatnonzero((anchors >= o) & (anchors - windows <= o))
            if len(k):
                same = np.cumsum(shared < length - o)[k].astype(np.uint64)
                keys.append(mix(mix(same * U(4096) + U(o), 41) + left[k, o], 42))
                who.append(ids[k])
                at.append(starts[k] + anchors[k] - o)
        keys, who, at = np.concatenate(keys), np.concatenate(who), np.concatenate(at)
        by = np.lexsort((at, who, keys))
        keys, who, at = keys[by], who[by], at[by]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (who != who[head]) | (at != at[head])
        return _spans(who[gone], at[gone], at[gone] + length)

    return run


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns as one array each for every document, in one order."""
    found = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("x"))
    return found.select("doc_id", *[F.col(f"x.{c}").alias(f"x_{c}") for c in columns])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, end``: bytes covered by strings that start earlier, in pieces that may overlap.
    ``docs`` has a binary ``text`` and no null id."""
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(5, min(20, int(total // PART_BYTES).bit_length()))
    cut = docs.mapInArrow(
        _cutter(length, gram, bits),
        "part bigint, gram binary, block binary, ids binary, first binary, last binary, anchor binary",
    )
    # pieces that are settled already are dealt out by document
    cut = cut.withColumn("deal", F.when(F.col("part") < 0, F.xxhash64("ids") % 64).otherwise(F.lit(0)))
    met = written(cut.groupBy("part", "deal").applyInPandas(_meet(length), MET), "met")
    open_ = _lists(met.where("windows >= 0"), "start", "end", "windows", "anchor")
    contexts = docs.join(open_, "doc_id").select("doc_id", "text", *open_.columns[1:])
    contexts = written(contexts.mapInPandas(
        _contexts, "doc_id bigint, start bigint, windows bigint, anchor bigint, bytes binary"
    ), "blocks")
    count = contexts.count()
    ranges = count // MERGE + 1
    some = contexts.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(SAMPLE if ranges > 1 else 0).collect()
    # blocks of one gram stay together
    grams = sorted(bytes(r.bytes)[r.anchor:r.anchor + gram] for r in some)
    splitters = sorted({grams[k * len(grams) // ranges] for k in range(1, ranges)}) if grams else []
    runs = contexts.mapInPandas(_runner(splitters, length, RUN), RUNS)
    found = runs.groupBy("part").applyInPandas(_merger(length, gram), "doc_id bigint, start bigint, end bigint")
    return met.where("windows < 0").select("doc_id", "start", "end").unionAll(written(found, "merged"))


def _remover(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            rows = []
            for doc, text, s, e in batch.itertuples(index=False):
                raw = bytes(text)
                kept, at, gone, count = [], 0, 0, 0
                if s is not None and len(s):
                    _, s, e = _joined(np.zeros(len(s), np.int64), s, np.minimum(e, len(raw)))
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        if a < b:
                            kept.append(raw[at:a])
                            at, gone, count = b, gone + b - a, count + 1
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), gone, count, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs``; the bytes
    that are left are null unless ``with_text``.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document with a smaller
    id, or in the same one further up. Texts are bytes of UTF-8, null is empty; strings do not run from
    one document into the next. A null id has no place in the order: its text stays whole and counts for
    nothing. Rows that repeat an id are one document: what goes in one of them goes in all, and equal rows
    are not earlier than each other. Other columns play no part.
    """
    rows = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).cast("binary").alias("text"),
    )
    spans = repeated_spans(rows.where("doc_id is not null"), length, gram)
    lists = _lists(spans, "start", "end")
    return rows.join(lists, "doc_id", "left").select("doc_id", "text", *lists.columns[1:]).mapInPandas(
        _remover(with_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
