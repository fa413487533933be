"""URL filters: rules indexed by their rarest literal token.

A URL is cut into tokens, every token fetches the rules stored under it, and only
those run their regular expression. A rule is stored under the one of its tokens
that the judged URLs hold least often, so that a common token fetches little.

Rules are written as text. ``host/path`` fits the host and its subdomains where the
URL's path starts with the rule's. A ``Pattern`` is literal text in which ``*``
stands for anything, ``||`` for the start of a host label and ``|`` for either end.
Host rules come first, the longest text of them wins (of equally long ones a block,
then the smaller text); patterns decide what no host rule fits, a block first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import lower_ascii

#: Rules that one pass holds in each Python worker; longer lists take more passes.
RULES_PER_PASS = 50_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
OUT = "rank bigint, size bigint, blocks boolean, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    host_rule: bool = True

    @property
    def regex(self) -> str:
        if self.host_rule:
            host, slash, path = self.text.partition("/")
            return rf"(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"
        body = self.text
        start = r".*"
        if body.startswith("||"):
            body, start = body[2:], r"(?:[^/]*\.)?"
        elif body.startswith("|"):
            body, start = body[1:], ""
        end = ""
        if body.endswith("|"):
            body, end = body[:-1], r"\Z"
        return start + ".*".join(re.escape(x.lower()) for x in body.split("*")) + end

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL holds whole: cut off on both sides."""
        text = self.text.lower()
        if self.host_rule:
            text = "|" + text
        ends = re.finditer(r"[a-z0-9]+", text)
        return sorted({
            m[0] for m in ends
            if m.start() > 0 and text[m.start() - 1] != "*"
            and m.end() < len(text) and text[m.end()] != "*"
        })

    @property
    def order(self) -> tuple[int, int, bool]:
        return (1 if self.host_rule else 0, len(self.text) if self.host_rule else 0, self.verdict == "block")


def _judge(rules: Sequence[Rule], counts: dict[str, int]):
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for k, rule in enumerate(rules):
        if tokens := rule.tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    # the best rule first, so that the first that fits ends the search
    place = {k: n for n, k in enumerate(sorted(
        range(len(rules)), key=lambda k: (tuple(-int(x) for x in rules[k].order), rules[k].text)
    ))}
    texts = [(r.regex, r.host_rule, r.text, r.verdict, *map(int, r.order)) for r in rules]
    compiled: dict[int, re.Pattern] = {}
    cut = re.compile(r"[a-z0-9]+")

    def best(url: str):
        small = url.lower()
        found = set(always)
        for token in set(cut.findall(small)):
            found.update(index.get(token, ()))
        for k in sorted(found, key=place.__getitem__):
            regex, host_rule, text, verdict, rank, size, blocks = texts[k]
            if k not in compiled:
                compiled[k] = re.compile(regex, re.DOTALL)
            if compiled[k].match(url if host_rule else small):
                return rank, size, bool(blocks), text, verdict
        return None, None, None, None, None

    def judge(urls: pd.Series) -> pd.DataFrame:
        names = ["rank", "size", "blocks", "rule", "verdict"]
        out = pd.DataFrame([best(u) for u in urls], columns=names, dtype=object)
        return out.astype({"rank": "Int64", "size": "Int64", "blocks": "boolean"})

    return F.pandas_udf(judge, OUT)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def token_counts(urls: DataFrame, text: Column, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many rows each token of the rules occurs: at most one entry a rule token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("token"))
    found = tokens.join(known, "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.toLocalIterator()}


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
    rules_per_pass: int = RULES_PER_PASS,
) -> DataFrame:
    """Each row with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the host rule that decided, or null; ``verdict`` is the rule's, else
    the pattern's, else ``default``. A null URL, or one without ``://``, has an empty
    host and path and is judged like any other; rows are kept as they are, repeated
    ones too, and a column that already has one of the new names is replaced. Nothing
    is shuffled, however often a host repeats. Each pass holds ``rules_per_pass`` rules
    on a worker, so the list has no size limit beyond the driver's.
    """
    where = F.concat(host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`")))
    counts = token_counts(pages, where, rules)
    parts_of = {"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))}
    out = pages.withColumns(parts_of)
    parts = [rules[k:k + rules_per_pass] for k in range(0, len(rules), rules_per_pass)]
    text = F.concat(F.col("host"), F.col("path"))
    found = [_judge(part, counts)(text) for part in parts]
    if not found:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    names = [f"__fit{k}" for k in range(len(found))]
    out = out.withColumns(dict(zip(names, found, strict=True)))
    best = F.greatest(*map(F.col, names)) if len(names) > 1 else F.col(names[0])
    out = out.withColumn("__fit", best)
    return out.withColumns({
        "rule": F.when(F.col("__fit.rank") == 1, F.col("__fit.rule")),
        "verdict": F.coalesce(F.col("__fit.verdict"), F.lit(default)),
    }).drop("__fit", *names)
