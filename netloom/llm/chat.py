"""Conversations as training texts, in windows of a token budget, by DataFrame functions alone.

A turn is written as ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash is put before
every backslash and number sign and inside every ``</turn>`` (and, in roles, between colon and blank), so
neither marker occurs in them; taking away the backslash before each character that has one gives
them back.

Windows follow from prefix sums of the turns' tokens. Turns are dealt into blocks of turn numbers, so no task
holds a whole conversation; sums of the blocks before give each turn its prefix. In a block a window begins at
the first turn that ends beyond the capacity counted from where the last window began. The system turn is
retained: it opens every window. Between it and the fresh turns a window repeats the turns that began at most
``history`` tokens before it, also those of earlier blocks. The loss mask holds the texts of fresh assistant
turns; what is repeated is masked.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

#: Turn numbers of one block.
BLOCK = 256
#: Tokens that the markers of a turn count for.
MARKERS = 4
#: What counts as a token: letters, digits and characters beyond ASCII together, other marks one by one.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
KEY = ["conv", "lost", "block"]
ORDER = ["turn", "late", "role", "body"]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def _turns(rows: DataFrame) -> DataFrame:
    role = F.coalesce(column_or_null(rows, "role", "string"), F.lit(""))
    text = F.coalesce(column_or_null(rows, "text", "string"), F.lit(""))
    conv = column_or_null(rows, "conv_id", "bigint")
    turns = rows.select(
        # two columns without nulls, so that joins, windows and groups share one way of dealing rows out
        F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("lost"), column_or_null(rows, "turn", "bigint").alias("turn"),
        (role != "system").alias("late"), role.alias("role"), escape(text).alias("body"),
        (tokens(role) + tokens(text) + MARKERS).alias("t"),
    )
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(": "), F.lit(":\\ ")), F.lit(": "))
    return turns.withColumn("head", head).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))


def _placed(joined: DataFrame) -> DataFrame:
    """Turns with their number in the block and the tokens before them."""
    is_system = F.coalesce(~F.col("late") & F.col("turn").eqNullSafe(F.col("lead")) & (F.col("body") == F.col("s_body")), F.lit(False))
    in_block = Window.partitionBy(*KEY).orderBy(*ORDER)
    placed = joined.withColumn("first", F.row_number().over(in_block)).withColumn("sys", is_system & (F.col("first") == 1))
    placed = placed.withColumn("t", F.when(F.col("sys"), 0).otherwise(F.col("t")))
    before = F.coalesce(F.sum("t").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("p", F.col("p0") + before)


def _fold(capacity: str) -> str:
    """Numbers (from 1) of the turns in ``own`` that begin a window."""
    return f"""aggregate(sequence(1, size(own)), named_struct('cuts', array(1), 'base', own[0].p),
        (s, i) -> if(own[i - 1].p + own[i - 1].t - s.base > {capacity} and i > 1 and own[i - 1].p > s.base,
            named_struct('cuts', array_append(s.cuts, i), 'base', own[i - 1].p), s), s -> s.cuts)"""


def windows(rows: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """The windows of all conversations: ``conv_id, block, start_token, n_context, n_turns, n_tokens, text, loss``.

    ``rows`` hold ``conv_id, turn, role, text``. Turns of a conversation go by turn number (null first), system
    rows before others, then role and text; every row is a turn, also one that repeats another. A null role or
    text is empty, rows with a null ``conv_id`` are one conversation. The system turn is the first one if its
    role is ``system``. ``block`` and ``start_token`` (tokens of the turns before, without the system turn) order
    the windows of a conversation. Of the ``n_turns`` turns in ``text`` the first ``n_context`` are repeated. ``loss`` holds
    start and end (code points, end exclusive) of the assistant texts among the others.

    A window has at most ``budget`` tokens unless a single turn with the system turn and its history has more;
    it then stands alone with them. An empty table has no windows. Other columns play no part.
    """
    turns = _turns(rows)
    blocks = turns.groupBy(*KEY).agg(F.sum("t").alias("all"), F.min("turn").alias("first"), F.count_if(F.col("turn").isNull()).alias("nulls"))
    ahead = Window.partitionBy("conv", "lost").orderBy("block")
    whole = Window.partitionBy("conv", "lost")
    system = turns.where("not late").groupBy("conv", "lost", F.col("turn").alias("lead")).agg(
        F.min("body").alias("s_body"), F.min_by("head", "body").alias("s_head"), F.min_by("t", "body").alias("s_t"))
    blocks = blocks.withColumn("lead", F.when(F.max("nulls").over(whole) == 0, F.min("first").over(whole)))
    blocks = blocks.join(
        system.withColumnsRenamed({"conv": "c", "lost": "l", "lead": "at"}),
        (F.col("conv") == F.col("c")) & (F.col("lost") == F.col("l")) & F.col("lead").eqNullSafe(F.col("at")), "left",
    ).drop("c", "l", "at")
    # the system turn is left out of the sums: it lies in the first block, and costs its tokens in each window
    blocks = blocks.withColumn("s_t", F.coalesce("s_t", F.lit(0)))
    own_sum = F.col("all") - F.when(F.row_number().over(ahead) == 1, F.col("s_t")).otherwise(0)
    blocks = blocks.withColumn("own_sum", own_sum)
    blocks = blocks.withColumn("p0", F.coalesce(F.sum("own_sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # later blocks near enough to repeat turns of this one; each block has MARKERS tokens at least
    near = F.collect_list(F.struct("block", "p0")).over(ahead.rowsBetween(1, history // MARKERS + 1))
    blocks = blocks.withColumn("near", F.filter(near, lambda x: x["p0"] - F.col("p0") - F.col("own_sum") < history))
    info = written(blocks.select(*KEY, "lead", "s_head", "s_body", "s_t", "p0", "near"), "blocks")
    joined = turns.join(info, KEY)
    placed, split = _placed(joined), _placed(joined.where("size(near) > 0"))  # the second: long conversations alone

    turn = F.struct(F.col("first").alias("i"), "p", "t", "sys", "head", "body", (F.col("role") == "assistant").alias("told"))
    own = placed.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(turn)).alias("own"), *[F.first(c).alias(c) for c in ("s_head", "s_body", "s_t")]
    )
    tail = split.where("not sys").select(
        "conv", "lost", F.explode("near").alias("to"), F.struct("p", "first", "t", "head", "body").alias("x")
    ).where(F.col("to.p0") - F.col("x.p") <= history)
    tail = tail.groupBy("conv", "lost", F.col("to.block").alias("block")).agg(F.array_sort(F.collect_list("x")).alias("tail"))
    both = own.join(tail, KEY, "left")

    cut = both.withColumn("cuts", F.expr(_fold(f"({budget} - {history} - s_t)")))
    each = cut.select(
        *KEY, "own", "tail", "s_head", "s_body", "s_t", "cuts", F.posexplode("cuts").alias("k", "from"),
    ).withColumn("to", F.expr("coalesce(get(cuts, k + 1), size(own) + 1)"))
    each = each.withColumn("fresh", F.expr("slice(own, `from`, `to` - `from`)")).withColumn("base", F.expr("fresh[0].p"))
    item = "named_struct('p', x.p, 'first', 0, 't', x.t, 'head', x.head, 'body', x.body)"
    old = F.expr(f"""filter(
        concat(coalesce(tail, array()), transform(filter(slice(own, 1, `from` - 1), x -> not x.sys), x -> {item})),
        x -> base - x.p <= {history})""")
    each = each.withColumn("old", old).withColumn("retained", F.expr("s_head is not null and not fresh[0].sys"))
    markers = "concat(x.head, x.body, '</turn>\n')"
    lead = F.expr(f"""concat(if(retained, concat(s_head, s_body, '</turn>\n'), ''),
        array_join(transform(old, x -> {markers}), ''))""")
    each = each.withColumn("context", lead)
    loss = F.expr("""aggregate(fresh, named_struct('at', char_length(context), 'spans', cast(array() as array<struct<start: int, end: int>>)),
        (s, x) -> named_struct('at', s.at + char_length(x.head) + char_length(x.body) + 8,
            'spans', if(x.told, array_append(s.spans, named_struct('start', s.at + char_length(x.head),
                'end', s.at + char_length(x.head) + char_length(x.body))), s.spans)),
        s -> s.spans)""")
    total = "aggregate({0}, 0L, (s, x) -> s + x.t)"
    return each.select(
        F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "block", F.col("base").alias("start_token"), F.expr("size(old) + if(retained, 1, 0)").alias("n_context"),
        F.expr("size(old) + if(retained, 1, 0) + size(fresh)").alias("n_turns"),
        (F.col("s_t") + F.expr(total.format("old")) + F.expr(total.format("fresh"))).alias("n_tokens"),
        F.concat("context", F.expr(f"array_join(transform(fresh, x -> {markers}), '')")).alias("text"), loss.alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text as structs of ``role, text``."""
    pieces = F.split(text, "</turn>\n")

    def parse(x: Column) -> Column:
        colon = F.instr(x, ": ")
        return F.struct(
            unescape(F.substring(x, F.lit(5), colon - 5)).alias("role"), unescape(F.substring(x, colon + 2, F.char_length(x))).alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse)


def loss_text(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), ""))


def read_back(found: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, n_chars`` of each conversation from its windows: fresh turns in order, the text
    under the mask, and the characters of all windows. A conversation is one row, as its digest needs."""
    each = found.select(
        "conv_id", "block", "start_token",
        F.slice(read_turns(F.col("text")), F.col("n_context") + 1, F.col("n_turns") - F.col("n_context")).alias("turns"),
        loss_text(F.col("text"), F.col("loss")).alias("loss"), F.char_length("text").cast("bigint").alias("n_chars"),
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "start_token", "turns", "loss")))
    each = each.groupBy("conv_id").agg(parts.alias("parts"), F.sum("n_chars").alias("n_chars"))
    return each.select(
        "conv_id", F.flatten(F.transform("parts", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.transform("parts", lambda x: x["loss"]), "").alias("loss"), "n_chars",
    )
