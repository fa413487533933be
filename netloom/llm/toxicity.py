"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and digits used as
letters become the plain letter. An Aho-Corasick automaton finds the lexicon's entries: whole
words, and stems at the start of a word. Entries inside an exception phrase do not count. The
weights that were found, as they are and by length, give the score through a logistic curve.
Lexicon, exceptions and curve are learned from a bounded sample of labelled rows.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

#: Labelled rows that the lexicon is learned from: those with the smallest hash of their id.
SAMPLE = 40_000
#: Entries of the lexicon and phrases of exception at most, the surest first.
ENTRIES, PHRASES = 3_000, 500
STEM = (4, 8)

# Look-alike letters, and digits and signs written for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "ｌ": "l",
}
WRITTEN_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
LEFT_OUT = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in {**LOOK_ALIKE, **WRITTEN_FOR}.items()}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
_FOLD |= {ord("l"): "i", ord("ⅼ"): "i", 0xFF4C: "i"}  # l, I and 1 stand for each other
_FOLD |= dict.fromkeys(map(ord, LEFT_OUT))
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    #: folded word, or stem ending in "*": weight
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: constant, for log(1 + sum), for log(1 + sum per 100 words)
    curve: tuple[float, float, float] = (-4.0, 3.0, 1.0)

    def finder(self):
        import ahocorasick

        entries = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float, str]]] = {}
        for entry, weight in self.weights.items():
            stem = entry.endswith("*")
            by_text.setdefault(entry.rstrip("*"), []).append((stem, weight, entry))
        for text, found in by_text.items():
            entries.add_word(text, (len(text), found))
        phrases = ahocorasick.Automaton()
        for phrase in self.exceptions:
            phrases.add_word(phrase, len(phrase))
        for automaton in (entries, phrases):
            if len(automaton):
                automaton.make_automaton()

        def at_edge(text: str, start: int, end: int) -> tuple[bool, bool]:
            return (start == 0 or not text[start - 1].isalnum(), end == len(text) or not text[end].isalnum())

        def hits(text: str) -> list[tuple[int, int, float, str]]:
            """Start, end, weight and entry of each match; only the heaviest at a start."""
            best: dict[int, tuple[int, int, float, str]] = {}
            for last, (size, found) in entries.iter(text) if len(entries) else ():
                start, end = last + 1 - size, last + 1
                left, right = at_edge(text, start, end)
                for stem, weight, entry in found:
                    if left and (right or stem) and (start not in best or best[start][2] < weight):
                        best[start] = (start, end, weight, entry)
            return list(best.values())

        def find(folded: str) -> list[tuple[int, int, float, str]]:
            found = hits(folded)
            if not found or not len(phrases):
                return found
            text = " ".join(folded.split())
            covered = [
                (last + 1 - size, last + 1) for last, size in phrases.iter(text)
                if all(at_edge(text, last + 1 - size, last + 1))
            ]
            found = hits(text) if covered or text != folded else found
            return [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in covered)]

        return find

    def features(self, folded: str, found: list) -> tuple[float, float]:
        total = sum(h[2] for h in found)
        words = max(1.0, len(folded) / 6)
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, folded: str, find) -> float:
        a, b = self.features(folded, find(folded))
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, by a hash of their text; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``text, toxic`` of at most ``size`` labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(size)
    # at most `size` rows of 12 bytes
    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("id"), column_or_null(docs, "text", "string").alias("text"))
    rows = rows.join(F.broadcast(written(marks, "labelled")), "id").where("text is not null")
    return written(rows.select("text", "toxic"), "sample")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[toxic].update({w for w in _WORD.findall(fold(text)) if len(w) <= 40})
        words = sorted(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"word": words, "t": [counts[1][w] for w in words], "c": [counts[0][w] for w in words]})


def _weights(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    words = sample.mapInPandas(_count_words, "word string, t bigint, c bigint")
    words = written(words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    low, high = STEM
    stems = words.select(
        F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring("word", F.lit(1), n))).alias("stem"),
        "word", "t", "c",
    ).where(F.length("stem") >= low).distinct()
    stems = stems.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("words"))
    both = words.select(F.col("word").alias("entry"), "t", "c", F.lit(False).alias("stem")).unionAll(
        stems.where("words >= 5").select(F.concat("stem", F.lit("*")), "t", "c", F.lit(True))
    )
    weight = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    # how far the toxic documents with an entry are above what chance would give, in deviations
    chance = (F.col("t") + F.col("c")) * F.lit(toxic / (toxic + clean))
    both = both.withColumn("weight", weight).withColumn("sure", (F.col("t") - chance) / F.sqrt(chance))
    best = both.where("t >= 4 and weight > 1.5 and sure > 6").orderBy(F.desc("sure"), "entry").limit(ENTRIES)
    rows = sorted(best.collect(), key=lambda r: (len(r.entry), r.entry))
    kept: dict[str, float] = {}
    for r in rows:  # a longer entry only where it says more than the stem it begins with
        word = r.entry.rstrip("*")
        shorter = [kept[s] for n in range(low, len(word) + 1) if (s := word[:n] + "*") in kept]
        if not shorter or r.weight > max(shorter) + 1.0:
            kept[r.entry] = float(r.weight)
    return kept


def _contexts(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = lexicon.finder()
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                small = " ".join(fold(text).split())
                for start, end, _, _ in find(small):
                    while end < len(small) and small[end].isalnum():
                        end += 1
                    before, after = small[max(0, start - 41):start], small[end:end + 41]
                    if m := re.search(r"([^\W_]+) $", before):
                        counts[m[1] + " " + small[start:end], toxic] += 1
                    if m := re.match(r" ([^\W_]+)", after):
                        counts[small[start:end] + " " + m[1], toxic] += 1
            rows = [(p, n if x else 0, 0 if x else n) for (p, x), n in counts.items()]
            yield pd.DataFrame(rows, columns=["phrase", "t", "c"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, held near zero."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hold = np.array([1e-3, 0.05, 0.05])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (p - y) + hold * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from the ``toxic`` marks of rows that are not held out.

    Without marks of both kinds nothing can be learned: the lexicon is then empty and scores low.
    ``exceptions`` are phrases in which nothing counts, besides those learned.
    """
    sample = _sample(docs, labels, size)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicon = Lexicon({}, sorted({" ".join(fold(p).split()) for p in exceptions}))
    if not n.get(0) or not n.get(1):
        return lexicon
    lexicon.weights = _weights(sample, n[1], n[0])
    phrases = sample.mapInPandas(_contexts(lexicon), "phrase string, t bigint, c bigint")
    phrases = phrases.groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    clean = phrases.where("c >= 5 and t * 20 <= c").orderBy(F.desc("c"), "phrase").limit(PHRASES).collect()
    lexicon.exceptions = sorted({*lexicon.exceptions, *(r.phrase for r in clean)})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = lexicon.finder()
        for batch in batches:
            rows = [(*lexicon.features(f := fold(t), find(f)), y) for t, y in zip(batch["text"], batch["toxic"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "y"])

    rows = sample.mapInPandas(measure, "a double, b double, y int").toPandas()  # at most `size` rows
    rows = rows.sort_values(["a", "b", "y"])
    lexicon.curve = _curve(rows[["a", "b"]].to_numpy(float), rows["y"].to_numpy(float))
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; a null text is scored as an empty one. Rows
    stay where they are. A column of that name is replaced."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = lexicon.finder()
        for batch in texts:
            yield pd.Series([lexicon.score(fold(t or ""), find) for t in batch], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(run, "double")(column_or_null(docs, text, "string")))
