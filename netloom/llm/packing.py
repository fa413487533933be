"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Documents become pieces of at most ``capacity`` tokens. A packer holds the number N(g) of
open sequences for each gap g that is left, and places a piece where the sum of N(g) ** 2
becomes smallest; ties go to the tightest gap. Packers run side by side, each over its share of the pieces in falling order
of length and with memory for its open sequences alone. What each leaves open is packed
once more by the same rule, whole sequences at a time, until few are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

CAPACITY = 4096
END = 1
#: Tokens that one packer places; with more data there are more packers.
TOKENS_PER_PACKER = 64_000_000
#: Open sequences that one packer of a later pass places.
LEFT_PER_PACKER = 200_000
#: Words whose ids a worker keeps; beyond that it starts anew.
WORDS_KEPT = 1_500_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    White space ends every token of this vocabulary, so a text's ids are those of its words; a
    word met before is looked up. New words are encoded many at a time with a mark in between.
    """

    MARK = "\x01"

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[str, bytes] = {}
        self.mark = self._ids(self.MARK)
        self.ends = {c: self._ids(c).tobytes() for c in ".,"}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _core(self, word: str) -> tuple[str, bytes]:
        """The word without what does not change its other ids: capitals, one final stop or comma."""
        end = b""
        if len(word) > 1 and word[-1] in self.ends and (word[-2].isascii() and word[-2].isalnum()):
            word, end = word[:-1], self.ends[word[-1]]
        if max(word, default="") < "\u0100":
            word = word.lower()
        return word, end

    def _learn(self, new: set[str]) -> None:
        known = self.known
        if len(known) + len(new) > self.kept:
            known.clear()
        cores = {w: self._core(w) for w in new}
        missing = sorted({c for c, _ in cores.values() if c not in known})
        plain = [c for c in missing if self.MARK not in c and "<|" not in c]
        ids = self._ids(f" {self.MARK} ".join(plain))
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) == 1 and len(cuts) == len(plain) - 1:
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            for c, i, j in zip(plain, starts, ends, strict=True):
                known[c] = ids[i:j].tobytes()
        for c in missing:
            if c not in known:
                known[c] = self._ids(c).tobytes()
        for w, (c, end) in cores.items():
            known[w] = known[c] + end

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        new = {w for w in set(words) if w not in self.known}
        if len(self.known) + 2 * len(new) > self.kept:
            new = set(words)
        self._learn(new)
        return b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of each row of ``docs``: whole texts as ids, then ``end``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = encoder(tokenizer), np.uint32(end).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = encode(text or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    own = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
                      column_or_null(docs, "text", "string").alias("text"))
    return own.mapInPandas(cut, PIECES)


class Packer:
    """Open sequences by gap; ``place`` says which sequence a length goes to, and where in it.

    A new sequence is begun only where no open one has room: with falling lengths this needs fewer
    sequences than letting the rule begin one whenever that makes the sum smaller.
    """

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        c = self.capacity
        room = self.n[length:]
        # the change of the sum if it goes where the gap is length, length + 1, ...
        change = 2 * (self.n[:c - length + 1] - room + 1)
        change[0] = 1 - 2 * room[0]  # a full sequence is not open any more
        change[room == 0] = np.iinfo(np.int64).max
        left = int(change.argmin())  # the first of the least: the tightest
        if room[left]:
            gap = left + length
            at = self.open[gap].pop()
            self.n[gap] -= 1
        else:
            gap, at, left = c, self.next, c - length
            self.next += 1
        if left:
            self.open[left].append(at)
            self.n[left] += 1
        return at, c - gap


def _packed(rows: DataFrame, length: str, capacity: int, packers: int, spread: int) -> DataFrame:
    """``rows`` with ``bin`` and ``place``; bins of different packers differ."""
    schema = rows.schema.simpleString()[7:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, TaskContext.get().partitionId() * 2**36 + spread)
        for batch in batches:
            places = [packer.place(x) for x in batch[length].tolist()]
            yield batch.assign(bin=[p[0] for p in places], place=[p[1] for p in places])

    dealt = rows.repartition(packers).sortWithinPartitions(F.desc(length), *[c for c in rows.columns if c != length])
    return dealt.mapInPandas(run, f"{schema}, bin bigint, place bigint")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END,
    tokens_per_packer: int = TOKENS_PER_PACKER,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row a piece.

    A null or empty text is the end token alone. A null ``doc_id`` stays null and repeated rows
    are packed each on its own; other columns play no part. An empty table gives no rows. Pieces
    are dealt out evenly whatever their ids, so no source or document fills a packer.
    """
    cut = written(pieces(docs, tokenizer, capacity, end), "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    packed = written(_packed(cut, "length", capacity, max(1, -(-total // tokens_per_packer)), 0), "packed")
    fills = packed.groupBy("bin").agg(F.sum("length").alias("fill"))
    # sequences that were left open, packed once more among each other
    moves, level = None, 0
    left = written(fills.where(F.col("fill") < capacity), "open")
    count = left.count()
    while count > 1:
        level += 1
        packers = max(1, -(-count // LEFT_PER_PACKER))
        again = written(_packed(
            left.withColumnRenamed("bin", "was"), "fill", capacity, packers, level * 2**56
        ), "moved")
        step = again.select(F.col("was").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("shift"))
        moves = step if moves is None else written(_chained(moves, step), "moves")
        if packers == 1:
            break
        fewer = written(again.groupBy("bin").agg(F.sum("fill").alias("fill")).where(F.col("fill") < capacity), "open")
        now = fewer.count()
        if now > 0.9 * count:
            break
        left, count = fewer, now
    if moves is None:
        out = packed.select("*", F.lit(None).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("shift"))
    else:
        out = packed.join(moves, "bin", "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _chained(moves: DataFrame, step: DataFrame) -> DataFrame:
    later = step.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
    return moves.join(later, "to", "left").select(
        "bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")
    )
