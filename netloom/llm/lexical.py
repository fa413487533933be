"""Ranked lexical search, term at a time with a limit on accumulators.

Texts are read once: for each document its number of terms and how often it holds each term that any
item asks for. These postings go to shards of documents, and a shard answers all items. For an item its
terms are taken rarest first. A posting adds to the accumulator (partial score) of its document, and makes one
if there is none. Before each term the largest scores that this and the remaining terms can add are
known; once their sum is below the k-th best partial score no document without an accumulator can come
among the best, so no more are made. Those there are go on to be updated by every remaining term, so
their scores are exact. A shard carries the k best of an item from block to block; thereby later blocks
stop sooner. Scores are whole numbers and never fall, so the bounds are exact and equal scores are kept.
"""

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

#: Pairs of item and term that one pass over the texts looks for (their vocabulary goes to each task).
PASS_PAIRS = 500_000
#: Postings of one shard.
SHARD = 1_000_000
#: Bytes of terms stay, A-Z become a-z, the rest are blanks.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
MOST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _asked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids, terms = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = set(terms_of(text))
            ids += [item] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


def _index(numbers: dict[bytes, int]):
    """Documents with any term: id, number of terms, and the numbers and counts of those asked for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, sizes, found, owners = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = terms_of(text)
                if own:
                    hits = [numbers[t] for t in own if t in numbers]
                    owners.append(np.full(len(hits), len(keep), np.int64))
                    found.append(np.array(hits, np.int64))
                    keep.append(k)
                    sizes.append(len(own))
            if not keep:
                continue
            key = np.concatenate(owners) * len(numbers) + np.concatenate(found)
            key, counts = np.unique(key, return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(keep) + 1) * len(numbers)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(keep)), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array((key % max(1, len(numbers))).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.astype(np.int32))),
            ], names=["doc_id", "n", "terms", "counts"])

    return run


class Block:
    """The postings of some documents, term after term."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, vocabulary: int, docs: int, words: int):
        self.size = len(n)
        doc = np.repeat(np.arange(self.size), np.diff(bounds))
        m = 10 + (90 * n * docs) // words
        share = (1_000_000_000 * counts) // (1000 * counts + 8 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.share = doc[order], share[order]
        self.first = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.share, self.first[full])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, before: np.ndarray, counters: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents of the block that can be among the k best; ``terms`` rarest first,
        ``before`` the best scores of earlier blocks."""
        bounds = weights * self.most[terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        score = np.zeros(self.size, np.int64)
        level = before[-1] if len(before) == k else 0
        at = 0
        for at, (t, w) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
            if rest[at] == 0 or rest[at] < level:
                break
            own = slice(self.first[t], self.first[t + 1])
            if own.stop > own.start:
                score[self.doc[own]] += w * self.share[own]
                partial = score[score > 0]
                if len(partial) + len(before) >= k:
                    if len(partial) > k:
                        partial = np.partition(partial, len(partial) - k)[-k:]
                    partial = np.concatenate([partial, before])
                    level = np.partition(partial, len(partial) - k)[len(partial) - k]
        else:
            at = len(terms)
        held = np.flatnonzero(score)
        value = score[held]
        for t, w in zip(terms[at:].tolist(), weights[at:].tolist(), strict=True):
            own = slice(self.first[t], self.first[t + 1])
            if own.stop > own.start and len(held):
                docs = self.doc[own]
                place = np.searchsorted(docs, held)
                place[place == len(docs)] = 0
                hit = docs[place] == held
                value[hit] += w * self.share[own][place[hit]]
        if counters is not None:
            counters["accumulators"] = counters.get("accumulators", 0) + len(held)
        fine = value >= max(level, 1)
        return held[fine], value[fine]


def _answers(items: list[tuple[int | None, np.ndarray, np.ndarray]], vocabulary: int, docs: int, words: int, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = [np.zeros(0, np.int64) for _ in items]
        ids = [np.zeros(0, np.int64) for _ in items]
        nulls = [np.zeros(0, bool) for _ in items]
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            bounds = terms.offsets.to_numpy().astype(np.int64)
            column = batch.column("doc_id")
            missing = column.is_null().to_numpy(zero_copy_only=False)
            id_ = column.fill_null(0).to_numpy()
            flat = slice(bounds[0], bounds[-1])
            block = Block(
                batch.column("n").to_numpy(), bounds - bounds[0], terms.values.to_numpy()[flat].astype(np.int64),
                counts.values.to_numpy()[flat].astype(np.int64), vocabulary, docs, words,
            )
            for j, (_, own, weights) in enumerate(items):
                at, value = block.best(own, weights, k, scores[j])
                if len(at):
                    value, number, empty = (np.concatenate(x) for x in ((scores[j], value), (ids[j], id_[at]), (nulls[j], missing[at])))
                    order = np.lexsort((number, empty, -value))[:k]
                    scores[j], ids[j], nulls[j] = value[order], number[order], empty[order]
        for j, (item, _, _) in enumerate(items):
            if len(ids[j]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(ids[j]), pa.int64()), pa.array(ids[j], mask=nulls[j]), pa.array(scores[j]),
                ], names=["item_id", "doc_id", "score"])

    return run


def _pass(texts: DataFrame, pairs: list, k: int) -> DataFrame:
    numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in pairs}))}
    postings = written(
        texts.mapInArrow(_index(numbers), "doc_id bigint, n bigint, terms array<int>, counts array<int>"), "postings"
    )
    docs, words, held = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # PASS_PAIRS rows at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked: dict = {}
    for r in pairs:
        asked.setdefault(r.item_id, []).append(numbers[bytes(r.term)])
    items = []
    for item, own in asked.items():
        own = np.array(own)
        own = own[df[own] > 0]
        own = own[np.lexsort((own, df[own]))]
        items.append((item, own, weight[own]))
    shards = postings.coalesce(max(1, -(-held // SHARD)))
    return shards.mapInArrow(_answers(items, len(numbers), docs, words, k), "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lowered. With N documents that
    have terms, L terms in all of them, n in one, df documents holding a term and tf times in one, a term
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and a document gets w * (10**9 tf div (1000 tf + 8 m)) for
    each of the item's terms, where m = 10 + 90 n N div L. Equal scores go by ascending ``doc_id``, nulls last.

    A null or empty text has no terms. Rows that repeat a ``doc_id`` are documents of their own; items that
    repeat an ``item_id`` (or a null one) are one item with the terms of all. Items without terms, or whose
    terms no document holds, have no rows. Empty tables give none. Other columns play no part. Texts of
    any length are read whole. Items are asked in passes of some ``PASS_PAIRS`` pairs of item and term; an item
    is in one pass whole.
    """
    texts = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "text", "string").cast("binary").alias("text"),
    )
    pairs = items.select(
        column_or_null(items, "item_id", "bigint").alias("item_id"),
        column_or_null(items, "text", "string").cast("binary").alias("text"),
    ).mapInArrow(_asked, "item_id bigint, term binary").distinct()
    pairs = written(pairs, "asked")
    passes = max(1, -(-pairs.count() // PASS_PAIRS))
    turn = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    found = None
    for p in range(passes):
        part = _pass(texts, pairs.where(turn == p).collect(), k)
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
