"""TCP segment analysis over whole captures (B19, C4a-C4k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.packet import has_flag
from netloom.operators.scan import Running, by_group_size

PAIR = ["session_id", "_lo", "_hi"]


def _paired(segments: DataFrame) -> DataFrame:
    """Put both directions of a connection in one group; ``_d`` tells them apart."""
    def end(side: str) -> Column:
        return F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"))

    flags = F.col("tcp_flags")
    return segments.withColumns(
        {
            "_lo": F.least(end("src"), end("dst")),
            "_hi": F.greatest(end("src"), end("dst")),
            "_d": F.when(end("src") <= end("dst"), 0).otherwise(1),
            "_syn": has_flag(flags, "SYN"),
            "_fin": has_flag(flags, "FIN"),
            "_ackf": has_flag(flags, "ACK"),
            "_psh": has_flag(flags, "PSH"),
            "_rst": has_flag(flags, "RST"),
        }
    )


def _per_side(kind: str, value: Column, name: str, inclusive: bool = False) -> dict[str, Running]:
    """One running value per direction, ``name0`` and ``name1``."""
    return {
        f"{name}{d}": Running(kind, F.when(F.col("_d") == d, value), inclusive) for d in (0, 1)
    }


def _own(name: str) -> Column:
    return F.when(F.col("_d") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _peer(name: str) -> Column:
    return F.when(F.col("_d") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))


def _label_group(segments: DataFrame, scan) -> DataFrame:
    c = F.col
    frame = c("frame_number")
    pure = (c("payload_len") == 0) & ~c("_psh")
    # a reset without SYN neither reads nor changes the state
    rows = segments.filter(~c("_rst") | c("_syn"))

    # 1: last SYN, first frame and previous frame of each direction
    rows = scan.run(
        rows,
        {
            **_per_side("max", F.when(c("_syn"), frame), "_s", inclusive=True),
            **_per_side("min", frame, "_first"),
            **_per_side("max", F.struct("frame_number", "ack", "win"), "_prev"),
        },
    )
    own_first, own_prev = _own("_first"), _own("_prev")
    epoch = F.coalesce(_own("_s"), F.lit(-1))
    length = c("payload_len") + F.when(c("_fin"), 1).otherwise(0)
    reaches = (
        F.when(c("_syn"), c("seq") + 1)
        .when(length > 0, c("seq") + length)
        .when(own_first.isNull(), c("seq"))
    )
    acked = F.when(c("_syn") & ~c("_ackf"), F.lit(0)).otherwise(c("ack"))
    starts_run = c("_syn") | own_first.isNull() | (c("ack") != own_prev["ack"])
    rows = rows.withColumns(
        {
            "_reach": F.when(reaches.isNotNull(), F.struct(epoch.alias("e"), reaches.alias("v"))),
            "_acked": F.struct(epoch.alias("e"), acked.alias("v")),
            "_run": starts_run,
            "_known": own_first.isNotNull(),
            "_peer_known": _peer("_first").isNotNull(),
            "_own_first": own_first,
            "_prev_ack": own_prev["ack"],
            "_prev_win": own_prev["win"],
        }
    ).drop("_first0", "_first1", "_prev0", "_prev1")

    # 2: next expected sequence number, highest acknowledgement, start of the ack run;
    # the epoch leads each struct, so a SYN starts the maximum afresh
    rows = scan.run(
        rows,
        {
            **_per_side("max", c("_reach"), "_exp"),
            **_per_side("max", c("_acked"), "_hi_ack"),
            **_per_side("max", F.when(c("_run"), frame), "_origin", inclusive=True),
        },
    )
    expected = _own("_exp")["v"]
    judged = c("_known") & c("_ackf") & ~c("_syn")
    alive = judged & ~c("_fin") & (c("payload_len") <= 1) & (c("seq") == expected - 1) & ~c("_psh")
    rows = rows.withColumns(
        {
            "_expected": expected,
            "_peer_ack": _peer("_hi_ack")["v"],
            "_orig": _own("_origin"),
            "_judged": judged,
            "_alive": alive,
            "_cand": judged & ~c("_fin") & pure & ~alive,
        }
    ).drop("_exp0", "_exp1", "_hi_ack0", "_hi_ack1", "_origin0", "_origin1")

    # 3: last keep-alive of the peer against whatever would have used it up
    rows = scan.run(
        rows,
        {
            **_per_side("max", F.when(c("_alive"), frame), "_ka"),
            **_per_side("max", F.when(c("_cand"), frame), "_used"),
        },
    )
    cleared = F.greatest(_own("_used"), _own("_s"), c("_own_first"))
    answers = c("_cand") & (_peer("_ka") > cleared)
    answers = F.coalesce(answers, F.lit(False))
    duplicate = (
        c("_cand") & ~answers & (c("ack") == c("_prev_ack")) & (c("seq") == c("_expected"))
        & ((c("win") == c("_prev_win")) | F.coalesce("has_sack", F.lit(False)))
    )
    rows = rows.withColumns({"_answers": answers, "_dup": F.coalesce(duplicate, F.lit(False))})
    rows = rows.drop("_ka0", "_ka1", "_used0", "_used1")

    # 4, 5: duplicates so far, minus those before this run of equal acks
    rows = scan.run(rows, _per_side("sum", c("_dup").cast("int"), "_dups", inclusive=True))
    rows = rows.withColumn("_all_dups", _own("_dups")).drop("_dups0", "_dups1")
    rows = scan.run(rows, _per_side("max", F.when(c("_run"), c("_all_dups")), "_base", inclusive=True))
    nth = c("_all_dups") - _own("_base")

    carries = (c("payload_len") > 0) | c("_fin")
    end = c("seq") + c("payload_len") + F.when(c("_fin"), 1).otherwise(0)
    late = c("_judged") & carries & (c("seq") < c("_expected"))
    empty = c("_judged") & (c("payload_len") == 0) & ~c("_fin")
    same_ack = c("ack") == c("_prev_ack")
    label = (
        F.when(c("_alive"), "TCP Keep-Alive")
        .when(c("_answers"), "TCP Keep-Alive ACK")
        .when(c("_dup"), F.concat(F.lit("TCP Dup ACK "), c("_orig").cast("string"), F.lit("#"), nth.cast("string")))
        .when(late & c("_peer_known") & (end <= c("_peer_ack")), "TCP Spurious Retransmission")
        .when(late & (end <= c("_expected")), "TCP Retransmission")
        .when(late, "TCP Out-Of-Order")
        .when(empty & (c("win") == 0), "TCP ZeroWindow")
        .when(empty & ~c("_psh") & same_ack & (c("win") != c("_prev_win")), "TCP Window Update")
        .when(empty & ~c("_psh") & ~c("_peer_known") & (c("ack") > 0), "TCP ACKed unseen segment")
        .when(c("_known") & ~c("_syn") & carries & (c("seq") > c("_expected")), "TCP Previous segment not captured")
    )
    return rows.select("session_id", "frame_number", label.alias("tcp_label"))


def label_segments(segments: DataFrame, large_group: int = 4_000_000) -> DataFrame:
    """C4: ``(session_id, frame_number, tcp_label)`` for every segment that the
    state machine looks at; null where nothing stands out.

    All steps share the group and the order, so there is one shuffle and one
    sort for ordinary groups; those above ``large_group`` rows are scanned in ranges.
    """
    paired = _paired(segments)
    return by_group_size(paired, PAIR, "frame_number", _label_group, large_group)


def _relative_group(segments: DataFrame, scan) -> DataFrame:
    c = F.col
    frame = c("frame_number")
    quiet = ~c("_syn") & ~c("_rst")
    rows = scan.run(
        segments,
        {
            **_per_side("max", F.when(c("_syn"), F.struct("frame_number", "seq")), "_s", inclusive=True),
            **_per_side("max", F.when(c("_syn") & c("win_scale").isNotNull(), F.struct("frame_number", "win_scale")), "_w", inclusive=True),
            **_per_side("min", F.when(quiet, F.struct("frame_number", "seq")), "_q", inclusive=True),
            **_per_side("min", F.when(quiet & c("_ackf") & (c("ack") > 0), F.struct("frame_number", "ack")), "_a", inclusive=True),
        },
    )

    def base(own, peer) -> Column:
        """The sequence number that counts as 0: the last SYN; before any SYN,
        one less than the first number seen, in a segment or in the peer's ack."""
        syn, first, acked = own("_s"), own("_q"), peer("_a")
        guess = F.when(
            acked.isNull() | (first["frame_number"] <= acked["frame_number"]), first["seq"] - 1
        ).otherwise(acked["ack"] - 1)
        return F.when(syn.isNotNull(), syn["seq"]).otherwise(guess)

    low32 = F.lit(0xFFFFFFFF).cast("bigint")
    seq_base, ack_base = base(_own, _peer), base(_peer, _own)
    scale = _own("_w")["win_scale"]
    scaled = c("win") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.coalesce(scale, F.lit(0)))
    return rows.select(
        "session_id",
        "frame_number",
        F.coalesce((c("seq") - seq_base).bitwiseAND(low32), c("seq")).alias("rel_seq"),
        F.coalesce((c("ack") - ack_base).bitwiseAND(low32), c("ack")).alias("rel_ack"),
        F.when(c("_syn"), c("win")).otherwise(scaled).alias("scaled_win"),
    )


def relative_numbers(segments: DataFrame, large_group: int = 4_000_000) -> DataFrame:
    """Sequence and ack numbers from each side's start, and the real window."""
    return by_group_size(_paired(segments), PAIR, "frame_number", _relative_group, large_group)
