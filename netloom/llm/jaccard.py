"""N-gram Jaccard join by groups of similar sets and their token unions.

Distinct shingle sets are partitioned into groups by size and smallest hash, so that similar
sets mostly share a group; a group is cut into blocks of bounded size. A block is stored as
the union of its members' shingles and a matrix of which member has which, and a sketch of each member, which
grows with it. Before anything travels, a set is held against the sketches of the block it asks; what they cannot rule out is
held against the block's union: a member can only be similar if enough of the set lies in it. Only
blocks that qualify are opened and their members compared exactly.

Which groups are looked at at all follows from signatures. Two sets of a size class that are
similar differ in at most H shingles; with the shingles dealt into more than H parts by hash,
one part is equal in both. A set has one signature a part, and groups that share a signature are
candidates; nothing similar is missed. There are more parts than needed, so more than one is equal, and a set may
leave out as many of its signatures as it has to spare: those most frequent in a sample, which come from passages
that many texts share. Of groups that share one, all are compared with the
most frequent of them first, then only sets that this has not connected with its largest
component, so that a large family of near copies costs no pairs of all with all.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.shingles import U, mix, sets, texts_of
from netloom.llm.store import among, batches_of, column_or_null, shuffles_dropped, written

BLOCK_SETS, BLOCK_SHINGLES = 2_048, 500_000
#: Signatures that one task joins.
PER_PART = 1_500_000
#: Shingles of the texts that tell frequent signatures from others, and signatures known as frequent. They decide which ones
#: are left out, never whether similar sets share one.
SAMPLE, FREQUENT = 8_000_000, 1 << 19
#: Of so many texts one is in the sample at least: in a thinner one, passages that make many pairs would not be seen.
SPARSEST = 16
#: Bits of a signature by which its frequency is known.
KNOWN = U((1 << 56) - 1)
#: Parts more than needed, for each 100 that are.
SPARE = 10
#: Rows that a Python worker is given at once.
BATCH = "4MB"


class Levels:
    """Size classes: similar sets lie in the same class or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def until(self, size: int) -> np.ndarray:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return np.array(self.starts, dtype=np.int64)

    def parts(self, level: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of parts for sets whose larger one is of the level, and how many of them may be empty
        without mattering. |x| + |y| <= 2 * largest size, of which at most H = (1 - t) / (1 + t) is not
        shared. Of H + 1 + spare parts at least 1 + spare are equal, so one that is not empty unless
        more than ``spare`` are."""
        largest = starts[level + 1] - 1
        differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
        spare = 3 + differ * SPARE // 100
        return differ + 1 + spare, spare


def measures(h: np.ndarray, bounds: np.ndarray, levels: Levels) -> dict[str, np.ndarray]:
    """Size, two hashes of the set, and group, for each text."""
    n = np.diff(bounds)
    out = {"n": n}
    full = np.flatnonzero(n)
    at = bounds[:-1][full]
    starts = levels.until(int(n.max(initial=1)))
    level = np.searchsorted(starts, n, "right") - 1
    for name, x, how in (("set1", mix(h, 11), np.add), ("set2", mix(h, 12), np.add), ("least", mix(h, 13), np.minimum)):
        value = np.zeros(len(n), np.uint64)
        if len(full):
            value[full] = how.reduceat(x, at)
        out[name] = value
    # 40 bits; groups that meet by chance are one group, which only costs comparisons
    out["g"] = (mix(out.pop("least") + level.astype(np.uint64), 14) >> U(24)).astype(np.int64)
    out["level"] = level
    return out


#: The words of a set's sketch folded to 256 bits.
SKETCH = [f"s{w}" for w in range(4)]
SETS = "doc_id bigint, n bigint, set1 bigint, set2 bigint, g bigint, sketch binary, " + ", ".join(f"{c} bigint" for c in SKETCH)


def signatures(
    h: np.ndarray, bounds: np.ndarray, found: dict, levels: Levels, frequent: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, and the number of the text of each. With ``frequent`` (signatures, ascending, and how often each
    was seen) without the most frequent ones of each set.

    Similar sets have 1 + spare equal parts, at least 1 + spare - e of them not empty if one of the sets has e empty ones. In one
    order of all signatures, the rarest that both have is followed by spare - e others of both, so it is not among
    the last spare - e of either."""
    n, level = found["n"], found["level"]
    docs = np.flatnonzero(n)
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = levels.until(int(n.max()) * 100 // levels.percent + 2)
    sigs, owners = [], []
    spread, value = mix(h, 15) >> U(32), mix(h, 16)
    size = n[docs]
    for up in (0, 1):
        parts, spare = levels.parts(level[docs] + up, starts)
        first = np.concatenate([[0], np.cumsum(parts)])
        part = ((spread * np.repeat(parts, size).astype(np.uint64)) >> U(32)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        key = np.repeat(first[:-1], size) + part
        np.add.at(sums, key, value)
        empty = np.bincount(key, minlength=first[-1]) == 0
        owner = np.repeat(np.arange(len(docs)), parts)
        blank = np.add.reduceat(empty, first[:-1], dtype=np.int64)
        keep = ~empty | (blank > spare)[owner]
        where = (np.arange(first[-1]) - first[:-1][owner])[keep]
        owner = owner[keep]
        sig = mix(sums[keep] + mix((where * 1024 + level[docs][owner] + up).astype(np.uint64), 17), 18)
        if frequent is not None:
            order = np.lexsort((sig, _seen(sig, frequent), owner))
            sig = sig[order]  # the owners are in order as they are
            ends = np.cumsum(np.bincount(owner, minlength=len(docs)))
            keep = ends[owner] - np.arange(len(owner)) > np.maximum(spare - blank, 0)[owner]
            sig, owner = sig[keep], owner[keep]
        sigs.append(sig)
        owners.append(docs[owner])
    return np.concatenate(sigs), np.concatenate(owners)


def _seen(sig: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, times = frequent
    if not len(known):
        return np.zeros(len(sig), np.int64)
    at = np.minimum(np.searchsorted(known, sig & KNOWN), len(known) - 1)
    return np.where(known[at] == sig & KNOWN, times[at], 0)


def _reader(width: int, percent: int):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = Levels(percent)
        for batch in batches:
            for at, to, data, offsets in texts_of(batch.column("text")):
                h, bounds = sets(data, offsets, width)
                m = measures(h, bounds, levels)
                words = sketch_words(m["n"])
                first = np.cumsum(words) - words
                told = sketches(h >> U(1), slice(None), m["n"])
                short = [np.bitwise_xor.reduceat(told[w::4], first // 4) for w in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(m["n"].astype(np.int64)),
                     pa.array(m["set1"].view(np.int64)), pa.array(m["set2"].view(np.int64)), pa.array(m["g"]),
                     pa.array([x.tobytes() for x in np.split(told, first[1:])], pa.binary()),
                     *[pa.array(x.view(np.int64)) for x in short]],
                    names=["doc_id", "n", "set1", "set2", "g", "sketch", *SKETCH])

    return read


def _signer(width: int, percent: int, bits: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = Levels(percent)
        for batch in batches:
            for _, _, data, offsets in texts_of(batch.column("text")):
                h, bounds = sets(data, offsets, width)
                m = measures(h, bounds, levels)
                # of the copies within a batch one is enough
                sets_seen = np.stack([m["set1"], m["set2"], m["n"].astype(np.uint64)])
                first = np.zeros(len(m["n"]), bool)
                first[np.unique(sets_seen, axis=1, return_index=True)[1]] = True
                sig, owner = signatures(h, bounds, m, levels, frequent)
                keep = first[owner]
                sig, g = sig[keep], m["g"][owner[keep]]
                if not len(sig):
                    continue
                order = np.lexsort((g, sig))
                sig, g = sig[order], g[order]
                keep = np.ones(len(sig), bool)
                keep[1:] = (sig[1:] != sig[:-1]) | (g[1:] != g[:-1])
                sig, g = sig[keep], g[keep]
                part = (sig >> U(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cuts[1:], len(sig))
                # seven bytes of the signature (the part is its top bits), five of the group
                small = sig.view(np.uint8).reshape(-1, 8)[:, :7] if bits <= 8 else sig.view(np.uint8).reshape(-1, 8)
                group = g.view(np.uint8).reshape(-1, 8)[:, :5]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[cuts]), pa.array([small[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    pa.array([group[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                ], names=["part", "sig", "g"])

    return sign


def _wide(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view(np.uint64)


def _runs(rows: pd.DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of signature and group with their number, and where each signature begins and of how many groups it is."""
    sig, g = _wide(list(rows["sig"]), 7 if bits <= 8 else 8), _wide(list(rows["g"]), 5)
    order = np.lexsort((g, sig))
    sig, g = sig[order], g[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(sig)))
    sig, g = sig[at], g[at]
    run = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    return sig, g, count, run, np.diff(np.append(run, len(sig)))


def _frequent(bits: int):
    """Signatures of three groups and more, the most frequent of a part if there are many."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        sig, _, _, run, size = _runs(rows, bits)
        pick = np.flatnonzero(size > 2)
        pick = pick[np.argsort(-size[pick], kind="stable")[:max(1, FREQUENT >> bits)]]
        return pd.DataFrame({"sig": [(sig[run[pick]] & KNOWN).tobytes()], "times": [size[pick].astype(np.int64).tobytes()]})

    return count


def frequent_signatures(texts: DataFrame, words: int, percent: int, bits: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent signatures and in how many groups of a sample of ``texts`` (of ``total`` shingles) each was seen."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(min(-(-total // SAMPLE), SPARSEST) or 1)) == 0)
    found = some.mapInArrow(_signer(words, percent, bits), "part bigint, sig binary, g binary").groupBy("part").applyInPandas(
        _frequent(bits), "sig binary, times binary"
    ).collect()  # FREQUENT signatures of 16 bytes at most
    sig = np.frombuffer(b"".join(r.sig for r in found), np.uint64)
    times = np.frombuffer(b"".join(r.times for r in found), np.int64)
    order = np.lexsort((times, sig))
    return sig[order], times[order]


def _shared(bits: int):
    """Signatures of more than one group: one row a group, under the hash of the groups' set."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        sig, g, count, run, size = _runs(rows, bits)
        key = np.add.reduceat(mix(g, 21), run)
        pick = np.flatnonzero(size > 1)
        pick = pick[np.unique(key[pick], return_index=True)[1]]
        rows_of = np.concatenate([np.arange(run[i], run[i] + size[i]) for i in pick]) if len(pick) else np.zeros(0, int)
        return pd.DataFrame({
            "key": np.repeat(key[pick], size[pick]).view(np.int64), "g": g[rows_of].view(np.int64), "seen": count[rows_of],
        })

    return join


def _tokenizer(width: int, percent: int):
    """Shingles of the texts that are the set of their home; an id can have other texts besides."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = Levels(percent)
        for batch in batches:
            for at, to, data, offsets in texts_of(batch.column("text")):
                h, bounds = sets(data, offsets, width)
                m = measures(h, bounds, levels)
                homes = [batch.column(c).slice(at, to - at).to_numpy() for c in ("b", "node", "set1", "set2")]
                own = (m["set1"].view(np.int64) == homes[2]) & (m["set2"].view(np.int64) == homes[3]) & (m["n"] > 0)
                keep = np.zeros(to - at, bool)  # repeated rows once
                keep[np.unique(np.stack(homes), axis=1, return_index=True)[1]] = True
                if not own.all():
                    first = np.flatnonzero(own)
                    keep[:] = False
                    keep[first[np.unique(np.stack([x[first] for x in homes]), axis=1, return_index=True)[1]]] = True
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((h >> U(1)).astype(np.int64)))  # 63 bits stay in order
                pick = pa.array(np.flatnonzero(keep & own))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at).take(pick) for c in ("b", "node", "alone")), tokens.take(pick)],
                    names=["b", "node", "alone", "tokens"])

    return read


#: Least 64-bit words of a set's sketch, and shingles of one row or frame that asks.
WORDS, FRAME = 8, 250_000


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """Words of the sketches of sets of these sizes: a power of two with at least a bit a shingle, since a sketch
    of fixed length is half full for every large set and rules nothing out."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(np.asarray(sizes) / 64, WORDS))).astype(np.int64))


def sketches(union: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A parity sketch of each set of a block, one after another: each shingle turns one bit, so two sketches
    differ in no more bits than their sets do in shingles. Its halves laid over each other are the sketch of half
    the length."""
    words = sketch_words(sizes)
    first = np.cumsum(words) - words
    spot = mix(np.asarray(union).view(np.uint64), 29)[places]
    word = np.repeat(first, sizes) + ((spot >> U(6)).astype(np.int64) & np.repeat(words - 1, sizes))
    out = np.zeros(words.sum(), np.uint64)
    np.bitwise_xor.at(out, word, U(1) << (spot & U(63)))
    return out


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _apart(mine: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, row by row; the longer ones are folded to the length of the others."""
    least = min(mine.shape[-1], told.shape[-1])
    return np.bitwise_count(_folded(told, least) ^ _folded(mine, least)).sum(-1, dtype=np.int64)


def near_sets(mine: np.ndarray, n: int, told: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets of these sizes, whose sketches lie in ``told`` one after another, may be similar to the set
    of ``n`` shingles with the sketch ``mine``?"""
    fits = np.flatnonzero((100 * n >= percent * sizes) & (100 * sizes >= percent * n))
    words = sketch_words(sizes)
    first = np.cumsum(words) - words
    out = [fits[:0]]
    for width in np.unique(words[fits]).tolist():
        those = fits[words[fits] == width]
        apart = _apart(mine, told[first[those][:, None] + np.arange(width)])
        out.append(those[apart * (100 + percent) <= (n + sizes[those]) * (100 - percent)])
    return np.concatenate(out)


def could_link(mine: np.ndarray, n: int, told: np.ndarray, sizes: np.ndarray, percent: int) -> bool:
    """May the set be similar to any of those in ``told``?"""
    return len(near_sets(mine, n, told, sizes, percent)) > 0


def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: the union of its members' shingles, ascending, and for each member the
    places of its own in the union."""
    rows = rows.sort_values("node")
    union, places = np.unique(np.concatenate(list(rows["tokens"])), return_inverse=True)
    sizes = rows["tokens"].map(len).to_numpy()
    return pd.DataFrame({
        "b": [rows["b"].iloc[0]], "union": [union], "nodes": [rows["node"].to_numpy()], "sizes": [sizes],
        "places": [places.astype(np.int32)],
    })


BLOCKS = "b bigint, union array<bigint>, nodes array<bigint>, sizes array<bigint>, places array<int>"


def linked(asks: tuple, told: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between members of two blocks that connect what was not connected yet: as many as are
    needed for the same components as all links. A block is its union, nodes, sizes and places."""
    union, nodes, sizes, places = told
    ids, label = np.unique(np.concatenate([asks[1], nodes]), return_inverse=True)
    own, other = label[:len(asks[1])], label[len(asks[1]):]
    part = np.arange(len(ids))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = np.concatenate([[0], np.cumsum(asks[2])])
    flags = np.zeros(len(union), np.int32)
    out = []
    for k, node in enumerate(asks[1].tolist()):
        apart = part[other] != part[own[k]]
        if not apart.any():
            continue
        tokens = asks[0][asks[3][at[k]:at[k + 1]]]
        place = np.searchsorted(union, tokens)
        place = place[union[np.minimum(place, len(union) - 1)] == tokens]
        if 100 * len(place) < percent * len(tokens):
            continue  # not enough of the set lies in the union
        flags[place] = 1
        shared = np.add.reduceat(flags[places], starts)
        flags[place] = 0
        for j in np.flatnonzero(apart & (100 * shared >= percent * (len(tokens) + sizes - shared))):
            x, y = part[own[k]], part[other[j]]
            if x != y:
                part[part == y] = x
                out.append((node, int(nodes[j])))
    return out


def _within(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for row in batch.itertuples(index=False):
                own = (row.union, row.nodes, row.sizes, row.places)
                pairs += linked(own, own, percent)
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def _singles(batch: pd.DataFrame, percent: int) -> np.ndarray:
    """Pairs of blocks of one set each that the sketches do not rule out."""
    n, m = (np.fromiter((x[0] for x in batch[c]), np.int64, len(batch)) for c in ("sizes", "t_sizes"))
    keep = (100 * n >= percent * m) & (100 * m >= percent * n)
    mine, told = sketch_words(n), sketch_words(m)
    for x, y in np.unique(np.stack([mine[keep], told[keep]]), axis=1).T.tolist():
        those = np.flatnonzero(keep & (mine == x) & (told == y))
        a, b = (
            np.frombuffer(b"".join(batch[c].iloc[k][0] for k in those), np.uint64).reshape(-1, w)
            for c, w in (("sketch", x), ("t_sketch", y))
        )
        keep[those] = _apart(a, b) * (100 + percent) <= (n + m)[those] * (100 - percent)
    return keep


def _test(percent: int):
    """Which sets of a block (of all, or those in ``only``) the sketches of another one do not rule out, and which of
    the other one's are left for them. Of a block with itself, sets that may be similar to another one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            single = ((batch["nodes"].map(len) == 1) & (batch["t_nodes"].map(len) == 1)).to_numpy()
            pairs = batch[single]
            for row in pairs[_singles(pairs, percent)].itertuples(index=False):
                if row.only is None or row.nodes[0] in row.only:
                    rows.append((row.qb, row.b, row.nodes, row.t_nodes, int(row.sizes[0])))
            for row in batch[~single].itertuples(index=False):
                own = [np.frombuffer(x, np.uint64) for x in row.sketch]
                told = np.frombuffer(b"".join(row.t_sketch), np.uint64)
                pick = np.arange(len(row.nodes)) if row.only is None else np.flatnonzero(np.isin(row.nodes, row.only))
                left = [near_sets(own[k], int(row.sizes[k]), told, row.t_sizes, percent) for k in pick.tolist()]
                if row.qb == row.b:
                    left = [x[x != k] for k, x in zip(pick.tolist(), left, strict=True)]
                pick = pick[[len(x) > 0 for x in left]]
                if len(pick):
                    hits = np.unique(np.concatenate(left))
                    rows.append((row.qb, row.b, np.unique(row.nodes[pick]), np.unique(row.t_nodes[hits]), int(row.sizes[pick].sum())))
            yield pd.DataFrame(rows, columns=["qb", "b", "pick", "hits", "shingles"])

    return run


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a block asks another one, in few rows. Rows and frames are of bounded size."""

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["b", "part", "nodes", "sizes", "tokens"])

    for batch in batches:
        rows, held = [], 0
        for row in batch.itertuples(index=False):
            ends, pick = np.cumsum(row.sizes), np.flatnonzero(np.isin(row.nodes, row.pick))
            while len(pick):
                now = max(1, int(np.searchsorted(np.cumsum(row.sizes[pick]), FRAME, "right")))
                now, pick = pick[:now], pick[now:]
                tokens = np.concatenate([row.union[row.places[ends[k] - row.sizes[k]:ends[k]]] for k in now.tolist()])
                mark = np.array([row.qb ^ int(now[0])], np.int64).view(np.uint64)
                rows.append((row.b, int(mix(mark)[0] % U(row.parts)), row.nodes[now], row.sizes[now], tokens))
                held += len(tokens)
                if held >= FRAME:
                    yield frame(rows)
                    rows, held = [], 0
        yield frame(rows)


def _open(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        if len(left) and len(right):
            told = right.iloc[0]
            told = (told["union"], told["nodes"], told["sizes"], told["places"])
            for row in left.itertuples(index=False):
                pairs += linked((row.tokens, row.nodes, row.sizes, np.arange(len(row.tokens))), told, percent)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def _tested(jobs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Of pairs of blocks ``qb, b`` (and sets of ``qb`` in ``only`` unless it is null) those that sketches do not rule out,
    with the sets of ``qb`` that ask (``pick``) and those of ``b`` that may answer (``hits``)."""
    own = marks.select(F.col("b").alias("qb"), "nodes", "sizes", "sketch")
    seen = marks.select("b", *[F.col(c).alias("t_" + c) for c in ("nodes", "sizes", "sketch")])
    return written(jobs.join(seen, "b").join(own, "qb").mapInPandas(
        _test(percent), "qb bigint, b bigint, pick array<bigint>, hits array<bigint>, shingles bigint"
    ), "jobs")


def _matrix(jobs: DataFrame, placed: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """Blocks of the sets that ask or may answer; shingles of others are not read from their texts."""
    wanted = jobs.select(F.col("qb").alias("b"), F.explode("pick").alias("node")).unionAll(
        jobs.select("b", F.explode("hits").alias("node"))
    ).distinct()
    homes = written(placed.join(wanted, ["b", "node"]).select("b", "node", "set1", "set2"), "homes")
    # dealt out even where the join would be a broadcast, so that no task has a Python worker for the filter and one for the shingles
    texts = among(known.withColumnRenamed("doc_id", "node"), "node", homes).repartition("node")
    blocks = homes.groupBy("b").agg((F.count("*") == 1).alias("alone"))
    read = homes.join(blocks, "b").join(texts, "node").select("b", "node", "set1", "set2", "alone", "text")
    read = read.mapInArrow(_tokenizer(words, percent), "b bigint, node bigint, alone boolean, tokens array<bigint>")
    members = written(read, "members")
    n = F.size("tokens").cast("bigint")
    alone = members.where("alone").select(
        "b", F.col("tokens").alias("union"), F.array("node").alias("nodes"), F.array(n).alias("sizes"),
        F.sequence(F.lit(0), F.size("tokens") - 1).alias("places"),
    )
    built = members.where("not alone").drop("alone").groupBy("b").applyInPandas(_blocks, BLOCKS)
    return alone.unionByName(written(built, "matrix"))  # lone sets are read from where they are


def _across(jobs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Links of the sets of block ``qb`` that ask with the members of block ``b``. A block that is asked travels
    once for each ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles that ask."""
    jobs = jobs.where("qb != b")
    parts = jobs.groupBy("b").agg(F.greatest(
        F.ceil(F.sum(F.size("pick")) / BLOCK_SETS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)
    ).cast("bigint").alias("parts"))
    asking = matrix.select(F.col("b").alias("qb"), "union", "nodes", "sizes", "places")
    asks = jobs.select("qb", "b", "pick").join(parts, "b").join(asking, "qb").mapInPandas(
        _ask, "b bigint, part bigint, nodes array<bigint>, sizes array<bigint>, tokens array<bigint>"
    )
    told = parts.join(matrix, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    told = told.select("b", "part", "union", "nodes", "sizes", "places")
    told, asks = told.toDF(*told.columns), asks.toDF(*asks.columns)
    out = asks.groupBy("b", "part").cogroup(told.groupBy("b", "part")).applyInPandas(_open(percent), "a bigint, b bigint")
    return written(out, "jaccard-links")


def _meetings(held: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks under a key, ``qb`` with sets to ask, that may hold a link not known yet. What the blocks'
    own figures rule out is left out before anything is moved: sizes that cannot fit, single sets whose sketches
    are too far apart, blocks of one and the same component, a block with itself (compared already), and of two
    single sets that both ask, the second time."""
    told = held.drop("ref")
    asking = held.where("parts > 1 or top != ref").select(
        "key", "ref", *[F.col(c).alias("q" + c) for c in told.columns if c != "key"]
    )
    turned = " + ".join(f"bit_count(qt{c} ^ t{c})" for c in SKETCH)
    return asking.join(told, "key").where("qb != b").where(
        f"100 * qhigh >= {percent} * low and 100 * high >= {percent} * qlow and not (qparts = 1 and parts = 1 and qtop = top)"
    ).where(
        f"qsets > 1 or sets > 1 or ((qb < b or top = ref) and ({turned}) * {100 + percent} <= (qhigh + high) * {100 - percent})"
    ).select("ref", "qb", "b").distinct().join(told.drop("key").distinct(), "b")


def _still_apart(met: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """For pairs of blocks the sets ``only`` of ``qb`` that ask: those outside of the key's leading component. A block's
    sets meet its pairs as one array, since a row for each set and block would grow with the square of a family."""
    crowd = state.groupBy(F.col("b").alias("qb")).agg(F.collect_list(F.struct("node", "n", "component", *SKETCH)).alias("crowd"))
    # a single set is far enough if the sketches differ in more bits than similar sets could in shingles
    turned = " + ".join(f"bit_count(x.{c} ^ t{c})" for c in SKETCH)
    only = F.expr(f"""transform(filter(crowd, x ->
        x.component != ref and not (parts = 1 and top = x.component)
        and 100 * x.n >= {percent} * low and 100 * high >= {percent} * x.n
        and (sets > 1 or ({turned}) * {100 + percent} <= (x.n + high) * {100 - percent})), x -> x.node)""")
    far = met.join(crowd, "qb").select("qb", "b", only.alias("only")).where("size(only) > 0")
    return far.groupBy("qb", "b").agg(F.array_distinct(F.flatten(F.collect_list("only"))).alias("only"))


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two texts link when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``percent`` / 100; ``component_id`` is the smallest id that links reach. A text without words
    (or null) links with nothing and is its own component; a null id has a null component and
    links nothing. Rows that repeat an id stand for one document with the links of all of them.
    Other columns play no part. Copies are compared once.
    """
    with batches_of(docs.sparkSession, BATCH), shuffles_dropped(docs.sparkSession):
        return _similar(docs, words, percent)


def _similar(docs: DataFrame, words: int, percent: int) -> DataFrame:
    texts = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "text", "string").cast("binary").alias("text"),
    )
    own = written(
        texts.mapInArrow(_reader(words, percent), SETS), "sets"
    )
    some = own.where("doc_id is not null and n > 0")
    nodes = some.groupBy("set1", "set2", "n").agg(
        F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in ("g", *SKETCH)]
    )
    nodes = written(nodes, "nodes")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    signed = total * 4 * (100 - percent) // (100 + percent) + 1
    bits = max(6, min(20, int(signed // PER_PART).bit_length()))
    known = texts.where("doc_id is not null")
    frequent = frequent_signatures(known, words, percent, bits, total)
    shared = known.mapInArrow(_signer(words, percent, bits, frequent), "part bigint, sig binary, g binary")
    shared = shared.groupBy("part").applyInPandas(_shared(bits), "key bigint, g bigint, seen bigint")
    shared = written(shared.groupBy("key", "g").agg(F.max("seen").alias("seen")), "shared")

    # groups with anything to compare, in blocks
    groups = nodes.groupBy("g").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    groups = groups.withColumn("cut", F.greatest(
        F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    ).cast("bigint"))
    live = shared.select("g").unionAll(groups.where("sets > 1").select("g")).distinct()
    live = written(groups.join(live, "g", "left_semi"), "groups")
    placed = nodes.join(live.select("g", "cut"), "g").select(
        "node", "set1", "set2", "g", "n", *SKETCH, F.xxhash64("g", F.pmod(F.xxhash64("set1", "set2"), "cut")).alias("b")
    )
    placed = written(placed, "placed")
    blocks = written(placed.groupBy("g", "b").count(), "blocks")
    told = own.select(F.col("doc_id").alias("node"), "set1", "set2", "n", "sketch")
    told = placed.select("b", "node", "set1", "set2", "n").join(told, ["node", "set1", "set2", "n"]).distinct()
    told = told.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("node", "n", "sketch"))).alias("sets"))
    marks = written(told.select(
        "b", F.col("sets.node").alias("nodes"), F.col("sets.n").alias("sizes"), F.col("sets.sketch").alias("sketch")
    ), "marks")

    # within each block, and every block with the largest one of the leading group
    heads = blocks.groupBy("g").agg(F.max_by("b", F.struct("count", "b")).alias("head"))
    every = shared.select("key", "g", "seen").unionAll(
        live.where("cut > 1").select(F.xxhash64("g").alias("key"), "g", F.lit(1).cast("bigint"))
    )
    every = written(every.join(blocks.select("g", "b"), "g").join(heads, "g").select("key", "b", "head", "seen"), "met")
    lead = every.groupBy("key").agg(
        F.max_by("head", F.struct("seen", "head")).alias("to"), F.countDistinct("b").alias("blocks")
    )
    lead = written(lead, "lead")
    first = every.join(lead, "key").where("b != to").select(F.col("b").alias("qb"), F.col("to").alias("b")).distinct()
    # blocks whose sizes cannot fit, and pairs of single sets whose sketches are too far apart, are not opened
    stats = placed.groupBy("b").agg(
        F.count("*").alias("asks"), F.min("n").alias("low"), F.max("n").alias("high"), *[F.max(c).alias(c) for c in SKETCH]
    )
    stats = written(stats, "stats")
    told = stats.select("b", *[F.col(c).alias("t" + c) for c in stats.columns[1:]])
    turned = " + ".join(f"bit_count({c} ^ t{c})" for c in SKETCH)
    first = first.join(stats.withColumnRenamed("b", "qb"), "qb").join(told, "b").where(
        f"100 * high >= {percent} * tlow and 100 * thigh >= {percent} * low"
    ).where(
        f"asks > 1 or tasks > 1 or ({turned}) * {100 + percent} <= (high + thigh) * {100 - percent}"
    ).select("qb", "b").unionAll(blocks.where("count > 1").select(F.col("b").alias("qb"), "b"))
    jobs = _tested(first.withColumn("only", F.lit(None).cast("array<bigint>")), marks, percent)
    matrix = _matrix(jobs, placed, known, words, percent)
    inside = matrix.where(F.size("nodes") > 1).mapInPandas(_within(percent), "a bigint, b bigint")
    within = written(inside, "jaccard-links")
    across = _across(jobs, matrix, percent)

    # sets that are still apart from the leading block's largest component meet all blocks of the key
    so_far = components(within.unionAll(across))
    state = placed.join(so_far, "node", "left").select(
        "node", "n", "b", *SKETCH, F.coalesce("component", "node").alias("component")
    )
    state = written(state, "state")
    tops = state.groupBy("b", "component").agg(
        F.count("*").alias("count"), F.min("n").alias("low"), F.max("n").alias("high"), *[F.max(c).alias("t" + c) for c in SKETCH]
    )
    tops = written(tops.groupBy("b").agg(
        F.max_by("component", F.struct("count", "component")).alias("top"), F.count("*").alias("parts"),
        F.sum("count").alias("sets"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.max("t" + c).alias("t" + c) for c in SKETCH],
    ), "tops")
    keys = lead.where("blocks > 2").join(tops.select(F.col("b").alias("to"), F.col("top").alias("ref")), "to").select("key", "ref")
    held = written(every.select("key", "b").distinct().join(keys, "key").join(tops, "b"), "held")
    far = _still_apart(_meetings(held, percent), state, percent)
    jobs = _tested(far, marks, percent)
    rest = _across(jobs, _matrix(jobs, placed, known, words, percent), percent)

    copies = some.join(nodes.select("set1", "set2", "n", "node"), ["set1", "set2", "n"]).where("doc_id != node")
    # what is known so far is held by its stars
    found = components(so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(rest).unionAll(
        copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    ))
    out = own.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
