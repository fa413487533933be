"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Every token of a text is tagged begin, inside or outside by the best path (Viterbi) from its shape,
its neighbours and features of the whole text; a newline is a token, so a secret may run over white
space and lines. Long texts are decoded in windows that overlap. The field is trained on windows of a
bounded sample of documents, where the fixed patterns say what a secret is, and on made-up keys,
passwords, passphrases and key blocks, so that it also finds what the patterns miss. Spans it finds
are added; those of the patterns stay.
"""

import hashlib
import json
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

#: Documents in the training sample (smallest hash of the id), windows that are trained on, and their tokens.
SAMPLE, CHUNKS, CHAIN = 20_000, 6_000, 32
FEATURES = 1 << 15
#: A shorter span is no secret.
LEAST = 8
#: Tokens a decoded window gives, and those it reads further on either side.
CORE, AROUND = 256, 32
#: Characters that are cut into tokens at once, tokens that are decoded at once, and tokens that are remembered.
SEGMENT, DECODED, KNOWN = 1 << 20, 1 << 20, 400_000

# The patterns that always count, and the lengths they need.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "field")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: White space and the token after it; the tokens of a text are all of its characters.
TOKEN = re.compile(r"[^\S\n]*(?:[\w+/-]+|\n|[^\w\s+/-]|\Z)")
OUT, BEGIN, IN = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Start, kind, end and start of the secret itself, for the fixed patterns: leftmost matches
    that do not overlap, kind by kind; too short ones are dropped after matching."""
    small = text.lower()
    spans = []
    if any(k in small for k in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:  # a run that is too short holds no longer one, so the length can be asked for at once
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def text_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    return [
        f"F{min(len(text).bit_length(), 16)}", f"E{min(4 * text.count('=') // lines, 4)}",
        f"C{min(text.count('{') + text.count(';'), 3)}",
    ]


def _numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


#: Distances at which a token says something about another, and numbers that tell its names there apart.
PLACES = (-1, 1, -2, 2, -3, -4)
APART = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 3432918353, 461845907], np.uint64)
CLASSES = str.maketrans({c: "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "-" for c in map(chr, range(128))})


def shape_of(token: str) -> tuple[tuple, int, int]:
    """All that a token's features of shape follow from, and hashes of its name for itself and for others."""
    body = token.lstrip()
    if not body:
        name = zlib.crc32(b"\n" if token else b"")
        return ("\n" if token else "",), name, name
    low = body.lower().encode("utf-8", "surrogatepass")
    key = body.translate(CLASSES), len(set(body)) * 4 // len(body), not body.strip("0123456789abcdef"), len(body) < len(token)
    return key, zlib.crc32(low[:12]), zlib.crc32(low[-12:])


def shape_features(key: tuple) -> list[list[int]]:
    """Numbers of the features of shape: for the token itself, and for those at each of ``PLACES``."""
    if len(key) == 1:
        name = "edge" + key[0]
        return [_numbers(["b", name]), *[_numbers([f"{name} {far}"]) for far in PLACES]]
    shape, unlike, low16, gap = key
    n, digits = len(shape), shape.count("0")
    upper, lower = sum(c.isupper() for c in shape), sum(c.islower() for c in shape)
    turns = sum(a != b for a, b in zip(shape, shape[1:], strict=False))
    kinds = f"{digits > 0:d}{upper > 0:d}{lower > 0:d}{digits + upper + lower < n:d}"
    own = [
        "b", "k" + kinds, f"n{min(n // 4, 10)}", f"k{kinds}n{min(n // 8, 5)}", f"t{min(turns // 2, 6)}n{min(n // 8, 5)}",
        f"d{10 * digits // n}", f"h{low16:d}n{min(n // 8, 5)}", f"u{unlike}n{min(n // 8, 5)}", f"g{gap:d}k{kinds}",
    ]
    return [_numbers(own), *[_numbers([f"s{kinds}{min(n // 6, 5)}{gap:d} {far}"]) for far in PLACES]]


def name_features(own: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Numbers of the features of names, given by hash: a row a token; itself and each of ``PLACES``."""
    both = np.stack([own, *[beside] * len(PLACES)], axis=1).astype(np.uint64)
    mixed = (both + np.uint64(1)) * APART
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FEATURES


def type_features(token: str) -> list[list[int]]:
    """Numbers of a token's features: for itself, and for the tokens at each of ``PLACES``."""
    key, own, beside = shape_of(token)
    names = name_features(np.array([own]), np.array([beside]))[0].tolist()
    return [[*f, n] for f, n in zip(shape_features(key), names, strict=True)]


def tokens_of(text: str, at: int = 0) -> Iterator[list[str]]:
    """All tokens from a place on, in lists of about ``SEGMENT`` characters."""
    size = SEGMENT
    while at < len(text):
        stop = min(len(text), at + size)
        found = TOKEN.findall(text, at, stop)
        if stop < len(text):  # the last ones may go on behind the segment
            while found and not found[-1]:
                found.pop()
            found = found[:-1]
            if not found:
                size *= 2
                continue
        yield [t for t in found if t]
        at, size = at + sum(map(len, found)), SEGMENT


@dataclass
class Field:
    """Weights of features by tag, and of one tag after another; the row 3 is the chunk's start."""

    emit: np.ndarray
    follow: np.ndarray

    def decode(self, features: list[np.ndarray]) -> list[int]:
        best, back = None, []
        for f in features:
            e = self.emit[f].sum(0)
            if best is None:
                best = self.follow[3] + e
                continue
            s = best[:, None] + self.follow[:3]
            back.append(s.argmax(0))
            best = s.max(0) + e
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        return Reader(self).spans([text])[0]


class Reader:
    """Finds the spans of many texts. A token's part in the scores is the same wherever it stands, so it
    is added up once a token; the windows of all texts are decoded side by side."""

    def __init__(self, field: Field):
        self.emit, self.follow = field.emit.astype(np.float32), field.follow.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.known, self.shapes, self.fresh = {}, {}, []
        self.vectors: list[np.ndarray] = []
        self.table, self.body = np.zeros((0, 1 + len(PLACES), 3), np.float32), np.zeros(0, np.int64)
        self._ids([""])

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known, shapes = self.known, self.shapes
        for t in set(tokens).difference(known):
            known[t] = len(known)
            key, own, beside = shape_of(t)
            if key not in shapes:
                shapes[key] = len(shapes)
                self.vectors.append(np.array([self.emit[f].sum(0) for f in shape_features(key)]))
            self.fresh.append((shapes[key], own, beside, len(t.lstrip())))
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))

    def _learn(self) -> None:
        """Adds the tokens that came up since to the table."""
        if self.fresh:
            shape, own, beside, body = np.array(self.fresh, np.int64).T
            rows = np.array(self.vectors)[shape] + self.emit[name_features(own, beside)]
            self.table, self.body = np.concatenate([self.table, rows]), np.concatenate([self.body, body])
            self.fresh = []

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        out, held, size = [], [], 0
        for text in texts:
            ids, lengths = [], []
            for tokens in tokens_of(text):
                ids.append(self._ids(tokens))
                lengths.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            none = np.zeros(0, np.int64)
            held.append((text, np.concatenate([none.astype(np.int32), *ids]), np.cumsum(np.concatenate([none, *lengths]))))
            size += len(held[-1][1])
            if size >= DECODED:
                out += self._decoded(held)
                held, size = [], 0
                if len(self.known) > KNOWN:
                    self._forget()
        return out + self._decoded(held)

    def _decoded(self, held: list) -> list[list[tuple[int, int]]]:
        self._learn()
        pad, counts = 4, np.array([len(ids) for _, ids, _ in held], np.int64)
        begins = np.cumsum(counts + pad) - counts  # edges stand between the texts
        flat = np.zeros(int((counts + pad).sum()) + pad, np.int32)
        for (_, ids, _), at in zip(held, begins.tolist(), strict=True):
            flat[at:at + len(ids)] = ids
        e = self.table[:, 0][flat]
        for k, far in enumerate(PLACES, 1):
            e += self.table[:, k][np.roll(flat, -far)]
        for (text, ids, _), at in zip(held, begins.tolist(), strict=True):
            e[at:at + len(ids)] += self.emit[_numbers(text_features(text))].sum(0)
        tags = self._tags(e, begins, counts)
        return [
            self._joined(text, tags[at:at + len(ids)], ids, ends)
            for (text, ids, ends), at in zip(held, begins.tolist(), strict=True)
        ]

    def _tags(self, e: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best path of each window; its ``CORE`` tags are kept."""
        tags = np.zeros(len(e), np.uint8)
        parts = -(-counts // CORE)
        text = np.repeat(np.arange(len(counts)), parts)
        core = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * CORE
        first = np.maximum(core - AROUND, 0)
        stop = np.minimum(core + CORE + AROUND, counts[text])
        order = np.argsort(first - stop, kind="stable")
        first, stop, core, text = first[order], stop[order], core[order], text[order]
        size, at = stop - first, first + begins[text]
        if not len(size):
            return tags
        long = int(size[0])
        alive = np.searchsorted(-size, -np.arange(long), "left")  # windows longer than k
        back = np.zeros((long, 3, len(size)), np.uint8)
        start = np.where(first == 0, self.follow[3][:, None], 0)
        best = start + e[at].T
        for k in range(1, long):
            n = alive[k]
            old, here = best[:, :n].copy(), e[at[:n] + k].T
            for t in range(3):
                a, b, c = (old[u] + self.follow[u, t] for u in range(3))
                m = np.maximum(a, b)
                back[k, t, :n] = np.where(c > m, 2, b > a)
                best[t, :n] = np.maximum(m, c) + here[t]
        now = best.argmax(0).astype(np.uint8)
        lo, hi = core - first, np.minimum(core - first + CORE, size)
        for k in range(long - 1, -1, -1):
            n = alive[k]
            kept = np.flatnonzero((lo[:n] <= k) & (k < hi[:n]))
            tags[at[kept] + k] = now[kept]
            if k:
                now[:n] = back[k][now[:n], np.arange(n)]
        return tags

    def _joined(self, text: str, tags: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        inside = tags != OUT
        if not inside.any():
            return []
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:] & (tags[1:] != BEGIN), [False]])
        first = np.flatnonzero(inside & (~before | (tags == BEGIN)))
        last = np.flatnonzero(inside & ~after)
        out = []
        for a, b in zip((ends[first] - self.body[ids[first]]).tolist(), ends[last].tolist(), strict=True):
            found = text[a:b]
            b = a + len(found.rstrip())
            a += len(found) - len(found.lstrip())
            if b - a >= LEAST:
                out.append((a, b))
        return out


NEVER = -1e4


def _allowed() -> np.ndarray:
    """An inside follows a begin or an inside."""
    follow = np.zeros((4, 3))
    follow[OUT, IN] = follow[3, IN] = NEVER
    return follow


def fit(chains: list[tuple[list[np.ndarray], list[int]]], rounds: int = 120) -> Field:
    """Gradient steps (Adam) on the likelihood of the tags, all chains at once, held near zero."""
    if not any(t != OUT for _, tags in chains for t in tags):
        emit = np.zeros((FEATURES, 3))
        emit[zlib.crc32(b"b") % FEATURES] = [1, -9, -9]
        return Field(emit, _allowed())
    n, long = len(chains), max(len(t) for _, t in chains)
    wide = max(len(f) for fs, _ in chains for f in fs)
    y, live = np.zeros((long, n), np.int8), np.zeros((long, n), bool)
    for i, (_, tags) in enumerate(chains):
        y[:len(tags), i], live[:len(tags), i] = tags, True
    x = np.full((int(live.sum()), wide), FEATURES, np.int32)  # the last row stays zero
    at = np.zeros((long, n), np.int64)
    at[live] = np.arange(len(x))
    for i, (features, _) in enumerate(chains):
        for k, f in enumerate(features):
            x[at[k, i], :len(f)] = f
    emit, follow, fixed = np.zeros((FEATURES + 1, 3)), np.zeros((4, 3)), _allowed()
    moments = [np.zeros_like(a) for a in (emit, emit, follow, follow)]
    rows = np.arange(n)
    for r in range(1, rounds + 1):
        f = follow + fixed
        e = np.zeros((long, n, 3))
        for t in range(3):
            column, sums = emit[:, t].copy(), np.zeros(len(x))
            for w in range(wide):
                sums += column[x[:, w]]
            e[live, t] = sums
        a = np.empty((long, n, 3))
        b = np.zeros((long, n, 3))
        a[0] = f[3] + e[0]
        for k in range(1, long):
            new = np.logaddexp.reduce(a[k - 1][:, :, None] + f[None, :3], axis=1) + e[k]
            a[k] = np.where(live[k][:, None], new, a[k - 1])
        for k in range(long - 2, -1, -1):
            new = np.logaddexp.reduce(f[None, :3] + (e[k + 1] + b[k + 1])[:, None, :], axis=2)
            b[k] = np.where(live[k + 1][:, None], new, 0)
        z = np.logaddexp.reduce(a[-1], axis=1)
        p = np.exp(a + b - z[None, :, None]) * live[:, :, None]
        p[np.arange(long)[:, None], rows[None, :], y] -= live
        ge, gf = np.zeros_like(emit), np.zeros_like(follow)
        for t in range(3):
            one = p[live][:, t]
            for w in range(wide):
                ge[:, t] += np.bincount(x[:, w], one, FEATURES + 1)
        gf[3] = p[0].sum(0)
        for k in range(1, long):
            both = a[k - 1][:, :, None] + f[None, :3] + (e[k] + b[k])[:, None, :] - z[:, None, None]
            gf[:3] += (np.exp(np.minimum(both, 0)) * live[k][:, None, None]).sum(0)
            np.subtract.at(gf, (y[k - 1][live[k]], y[k][live[k]]), 1)
        ge, gf = ge / n + 1e-5 * emit, gf / n + 1e-5 * follow
        for v, g, i in ((emit, ge, 0), (follow, gf, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            v -= 0.15 * (moments[i] / (1 - 0.9**r)) / (np.sqrt(moments[i + 1] / (1 - 0.99**r)) + 1e-8)
        emit[FEATURES] = 0
    return Field(emit[:FEATURES], follow + fixed)


def windows(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[str], str, list[int]]]:
    """Pieces of a text to train on: tokens with those around them, features of the text, and tags; ``spans``
    are the secrets. A piece ends before a secret that it does not hold whole, unless it is all of the piece."""
    tokens = [t for found in tokens_of(text) for t in found]
    tags, at, spans, k = [], 0, sorted(spans), 0
    for t in tokens:
        a, at = at + (len(t) - len(t.lstrip()) if t.strip() else 0), at + len(t)
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        inside = a < at and any(s < at and a < e for s, e in spans[k:k + 3])
        tags.append(OUT if not inside else IN if tags and tags[-1] != OUT else BEGIN)
    edge, whole, first = [""] * 4, text_features(text), 0
    around = edge + tokens + edge
    while first < len(tokens):
        stop = min(len(tokens), first + CHAIN)
        if stop < len(tokens) and tags[stop] == IN:
            begin = stop
            while tags[begin] == IN:
                begin -= 1
            stop = begin if begin > first else stop
        own = tags[first:stop]
        yield around[first:stop + 8], whole, [BEGIN, *own[1:]] if own[0] == IN else own
        first = stop


def chain_of(around: list[str], whole: list[str], tags: list[int], known: dict) -> tuple[list[np.ndarray], list[int]]:
    """Features and tags of a piece."""
    for t in around:
        if t not in known:
            known[t] = type_features(t)
    parts, last = [known[t] for t in around], _numbers(whole)
    return [
        np.array([*parts[i][0], *[n for k, far in enumerate(PLACES, 1) for n in parts[i + far][k]], *last])
        for i in range(4, 4 + len(tags))
    ], tags


def _chains(text: str, spans: list[tuple[int, int]]) -> list:
    """Features and tags of a text's pieces; ``spans`` are the secrets."""
    known: dict = {}
    return [chain_of(*w, known) for w in windows(text, spans)]


def made_up(count: int = 3_000, seed: int = 7) -> list:
    """Chains of secrets that the patterns do not know, and of harmless text that looks alike."""
    rng = np.random.default_rng(seed)
    letters, digit, low, high = string.ascii_letters, string.digits, string.ascii_lowercase, string.ascii_uppercase
    plain, url = letters + digit, letters + digit + "_-"
    some = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    common = ["the", "of", "and", "in", "on", "key", "see", "at", "is", "use", "with", "password", "passphrase", "was", "not"]
    word = lambda: some(low, rng.integers(2, 11)) if rng.random() < 0.6 else str(rng.choice(common))
    words = lambda least, most: " ".join(word() for _ in range(rng.integers(least, most)))
    pick = lambda *of: of[rng.integers(len(of))]
    secret = [
        lambda: some(plain, rng.integers(24, 48)), lambda: "ghp_" + some(plain, 36), lambda: "sk-" + some(plain, 32),
        lambda: ".".join(some(url, n) for n in (20, 40, 30)), lambda: "xoxb-" + some(digit, 11) + "-" + some(plain, 24),
        lambda: some(letters, rng.integers(20, 48)), lambda: some(high, rng.integers(20, 40)),
    ]
    lines = lambda: "\n".join([some(plain + "+/", 64) for _ in range(rng.integers(1, 8))] + [some(plain + "+/", rng.integers(8, 60)) + "=" * rng.integers(0, 2)])
    kind = lambda: pick("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
    #: What stands before, the secret, and what stands after it.
    told = [
        lambda: (pick("passphrase: ", "Passphrase: ", "passphrase = ", "pass phrase: ", "recovery phrase: ", "seed phrase: "), " ".join(some(low, rng.integers(3, 10)) for _ in range(rng.integers(4, 13))), "\n"),
        lambda: (pick("passphrase: ", "passphrase=", "passphrase is "), " ".join(some(low, rng.integers(3, 10)) for _ in range(rng.integers(4, 9))), '"'),
        lambda: (pick("pwd: ", "pwd=", "pass: ", "login: root / ", "credentials: admin / "), some(pick(letters, low, plain), rng.integers(8, 20)), pick("\n", " ")),
        lambda: (f"-----BEGIN {(k := kind())}-----\n", lines(), f"\n-----END {k}-----"),
    ]
    harmless = [
        lambda: f"20{some(digit, 2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", lambda: "+" + some(digit, 11),
        lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)), lambda: f"{some(low, 6)}.{some(digit, 2)}@{some(low, 7)}.com",
        lambda: f"https://{some(low, 6)}.org/{some(low, 5)}/{some(digit, 5)}", lambda: some(low, 9) + some(digit, 2),
        lambda: some(digit, 9), lambda: f"v{rng.integers(1, 9)}.{rng.integers(1, 99)}.{rng.integers(1, 999)}",
        lambda: "the passphrase was " + words(2, 5), lambda: words(4, 12).capitalize() + ".\n" + words(4, 12).capitalize() + ".",
        lambda: some(low, 5) + some(low, 6).capitalize() + some(low, 6).capitalize(), lambda: some(low, rng.integers(12, 24)),
        lambda: some(high, rng.integers(3, 12)), lambda: f"{word()}: {words(3, 8)}\n", lambda: '"' + words(3, 8) + '"',
    ]
    out = []
    for i in range(count):
        before, after = words(1, 6), words(1, 6)
        if i % 2 == 0:
            out += _chains(f"{before} {pick(*harmless)()} {after}", [])
            continue
        if rng.random() < 0.6:
            lead, body, tail = pick("", "Bearer ", "key=", "auth: ", ""), pick(*secret)(), " "
        else:
            lead, body, tail = pick(*told)()
        at = len(before) + 1 + len(lead)
        out += _chains(f"{before} {lead}{body}{tail}{after}", [(at, at + len(body))])
    return out


def learn(docs: DataFrame, sample: int = SAMPLE, chunks: int = CHUNKS) -> Field:
    """The field for ``docs``. Pieces with a secret come first in the sample, then by hash."""
    ids = docs.select(column_or_null(docs, "doc_id", "bigint").alias("id")).where("id is not null").distinct()
    ids = written(ids.orderBy(F.xxhash64("id"), "id").limit(sample), "sampled")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                spans = [(at, end) for _, _, end, at in base_spans(text)]
                rows = [
                    (any(tags), json.dumps([around, whole, tags])) for around, whole, tags in windows(text, spans)
                ]
                yield pd.DataFrame(rows, columns=["secret", "chain"]).astype({"secret": bool, "chain": object})

    own = docs.select(column_or_null(docs, "doc_id", "bigint").alias("id"), column_or_null(docs, "text", "string").alias("text"))
    # at most `sample` ids
    own = own.where("text is not null").join(F.broadcast(ids), "id", "left_semi").select("text")
    found = written(own.mapInPandas(read, "secret boolean, chain string").distinct(), "chains")
    rank = [F.xxhash64("chain"), F.col("chain")]
    rows = found.where("secret").orderBy(*rank).limit(chunks // 2).collect()
    rows += found.where("not secret").orderBy(*rank).limit(chunks // 2).collect()
    known: dict = {}
    chains = [chain_of(*json.loads(c), known) for c in sorted(r.chain for r in rows)]
    return fit(chains + made_up())


def spans_of(text: str, found: list[tuple[int, int]]) -> tuple[list, list]:
    """Spans of the patterns, and all spans: start, kind, end; those the field ``found`` are added unless
    a pattern's span holds them whole."""
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    more = [
        (s, 3, e) for s, e in found if not any(a <= s and e <= b for a, _, b in base)
    ]
    return base, sorted(base + more)


def _told(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field, redact: bool = False) -> DataFrame:
    """Each row with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``; with
    ``redact`` its text has ``[secret]`` in place of each span.

    A null text has no spans and stays null. Rows are judged one by one, so repeated rows and ids
    get equal results. Columns that already have one of the new names are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "text"]
        reader = Reader(field)
        for batch in texts:
            rows = []
            for text, found in zip(batch, reader.spans([t or "" for t in batch]), strict=True):
                base, every = spans_of(text or "", found)
                kinds = [k for _, k, _ in base]
                clean = None
                if redact and every and text:
                    parts, at = [], 0
                    for s, _, e in every:
                        if s >= at:
                            parts += [text[at:s], "[secret]"]
                        at = max(at, e)
                    clean = "".join(parts) + text[at:]
                rows.append((
                    kinds.count(0), kinds.count(1), kinds.count(2),
                    hashlib.sha256(_told(base).encode()).hexdigest(), _told(every), clean,
                ))
            yield pd.DataFrame(rows, columns=names)

    kind = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, text string"
    out = docs.select(*[F.col(f"`{c}`") for c in own], F.pandas_udf(run, kind)(column_or_null(docs, "text", "string")).alias("__found"))
    if redact and "text" in own:
        out = out.withColumn("text", F.coalesce("__found.text", "text"))
    return out.select(*[F.col(f"`{c}`") for c in own], *[f"__found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
