"""The registered queries: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import chat, jaccard, lexical, mixing, near_vectors, nearest, packing, runs, secrets, suffixes, toxicity, url_filter, warc
from netloom.llm.registry import ORACLES, QUERIES, query
from netloom.llm.store import table

__all__ = ["ORACLES", "QUERIES"]

MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM counts),
means AS (SELECT source, rate, ceil(rate / 32.0)::INT AS parts, rate / ceil(rate / 32.0) AS mean FROM rates),
cdf(source, parts, mean, k, p, c) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
  FROM cdf WHERE k < ceil(mean + 12.0 * sqrt(mean) + 30.0)),
tables AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, parts),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.cdf,
    unnest(range(1, t.parts + 1)) AS part, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) AS key
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, key, sum(len(list_filter(cdf, lambda x: x <=
    CAST('0x' || substr(md5('mix-1|' || key || '|' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0
  )))::INT AS n FROM drawn GROUP BY ALL),
copies AS (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM counted WHERE n > 0)
SELECT c.doc_id, c.text, c.lang, c.source, c.n_chars, c.copy, r.rate,
  md5('mix-1|order|' || c.key || '|' || CAST(c.copy AS VARCHAR)) AS order_key
FROM copies c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source
"""


@query("op1_poisson_mixture", MIX_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, replicated so that a source of n documents gets a share of sqrt(n)."""
    return mixing.mix(table(spark, folder, "documents"), power=0.5)


HOST_RULES = [
    url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow"),
]
PATTERNS = [
    url_filter.Rule(text, "block", host_rule=False)
    for text in ("ads-track.", "||ads.", "/ads/", ".casino.", "/login/*session=", "||tracker.")
]
URL_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'),
  ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'),
  ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE
  WHEN contains(lower(p.host || p.path), 'ads-track.') OR contains(lower(p.host || p.path), '/ads/')
    OR contains(lower(p.host || p.path), '.casino.')
    OR regexp_matches(lower(p.host || p.path), '^([^/]*[.])?(ads|tracker)[.]')
    OR regexp_matches(lower(p.host || p.path), '(?s)/login/.*session=')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""


@query("op2_url_filter", URL_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict for the URL of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, [*HOST_RULES, *PATTERNS])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_pack")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document; the lexicon knows no label of a document held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"))
    scored = toxicity.score_texts(docs, lexicon)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.learn(docs)).drop("text")


@query("op3_jaccard")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.9 of their 3-word shingles."""
    return jaccard.similar(table(spark, folder, "documents"), words=3, percent=90)


@query("op6_nearest")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    return nearest.nearest(table(spark, folder, "embeddings"), k=20, every=20)


@query("op7_near_vectors")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of vectors of one label with a cosine of 0.93 and more."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"), 0.93)


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.keeper IS DISTINCT FROM p.page_id AND m.keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.keeper IS DISTINCT FROM p.page_id THEN m.keeper END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
"""


@query("op9_warc", WARC_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, read back through the capture index."""
    directory = warc.archive(spark, table(spark, folder, "pages"))
    read = warc.read_archives(directory, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_suffixes")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without strings of 100 bytes that occur before."""
    cleaned = suffixes.remove_repeats(table(spark, folder, "documents"), with_text=False)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth by the checksum of its id repeats its tail: word i >= a is word
    a + (i - a) % p of the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("chosen"))
    chosen = chosen.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    chosen = chosen.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    text = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, get(words, a + (i - a) % p))), ' ')"
    )
    return chosen.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


RUNS_SQL = """
WITH bytes AS (
  SELECT DISTINCT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda s, b:
    list_reduce(list_concat([xor(s, b)], range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))) AS s
  FROM documents),
given AS (
  SELECT d.doc_id, row_number() OVER () AS doc, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(s, 4294967295) AS h FROM documents d JOIN bytes b ON d.doc_id IS NOT DISTINCT FROM b.doc_id),
cut AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
texts AS (
  SELECT doc_id, doc, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w
  FROM cut),
words AS (SELECT doc, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
same AS (SELECT x.doc, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc = y.doc AND x.word = y.word AND x.i < y.i),
stretch AS (SELECT doc, q, i - row_number() OVER (PARTITION BY doc, q ORDER BY i) AS island, i FROM same),
long AS (
  SELECT doc, q, min(i) AS s, count(*) + q AS length FROM stretch GROUP BY doc, q, island
  HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc, s, length, min(q) AS q FROM long GROUP BY doc, s, length),
per AS (
  SELECT doc, count(*) AS n_runs, arg_min(s, (-length, s, q)) AS start, max(length) AS length,
    arg_min(q, (-length, s, q)) AS period, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed
  FROM runs GROUP BY doc),
gone AS (SELECT DISTINCT doc, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (
  SELECT doc, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc, i) GROUP BY doc)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per USING (doc) LEFT JOIN kept USING (doc)
"""


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which repeats its tail, and what is left without them."""
    found = runs.runs(planted(table(spark, folder, "documents")), least=12)
    best = F.expr("get(array_sort(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p))), 0)")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SEARCH_SQL = """
WITH tokens AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT doc_id, row_number() OVER () AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents)),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc, doc_id, count(*) AS n FROM tokens GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
counts AS (SELECT doc, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
scores AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts look like the markers of a format."""
    odd = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return rows.unionByName(odd)


CHAT_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role <> 'system', role, text) AS i,
    coalesce(turn // 256, -1) AS block,
    4 + len(regexp_extract_all(role, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]'))
      + len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS tokens,
    14 + length(role) + length(replace(role, '\', '\\')) - length(role) + length(replace(role, '#', '##')) - length(role)
      + length(replace(role, ': ', ':: ')) - length(role) + length(replace(role, '</turn>', '</turn>#')) - length(role)
      + length(replace(text, '\', '\\')) + length(replace(text, '#', '##')) - length(text)
      + length(replace(text, '</turn>', '</turn>#')) - length(text) AS chars
  FROM given),
marked AS (SELECT *, i = 1 AND role = 'system' AS sys FROM turns),
summed AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS t,
    coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p,
    coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS s_tokens,
    coalesce(max(CASE WHEN sys THEN chars END) OVER (PARTITION BY conv_id), 0) AS s_chars
  FROM marked),
walk(conv_id, i, block, base, begins) AS (
  SELECT conv_id, i, block, p, TRUE FROM summed WHERE i = 1
  UNION ALL
  SELECT s.conv_id, s.i, s.block,
    CASE WHEN s.block <> w.block OR (s.p + s.t - w.base > 1024 - 128 - s.s_tokens AND s.p > w.base) THEN s.p ELSE w.base END,
    s.block <> w.block OR (s.p + s.t - w.base > 1024 - 128 - s.s_tokens AND s.p > w.base)
  FROM walk w JOIN summed s ON s.conv_id = w.conv_id AND s.i = w.i + 1),
again AS (
  SELECT w.conv_id, sum((SELECT coalesce(sum(h.chars), 0) FROM summed h
    WHERE h.conv_id = w.conv_id AND h.i < w.i AND NOT h.sys AND w.base - h.p <= 128)
    + CASE WHEN w.i > 1 THEN s_chars ELSE 0 END) AS chars
  FROM walk w JOIN summed s ON s.conv_id = w.conv_id AND s.i = w.i WHERE begins GROUP BY w.conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(s.chars) + any_value(a.chars))::BIGINT AS formatted_chars
FROM summed s JOIN again a ON a.conv_id = s.conv_id GROUP BY s.conv_id
"""


@query("op12_chat_windows", CHAT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation, read back from its windows of 1,024 tokens."""
    back = chat.read_back(chat.windows(conversations(spark, folder), budget=1024, history=128))
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("n_chars").alias("formatted_chars"),
    )
