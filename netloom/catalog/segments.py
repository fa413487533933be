"""Checked queries: TCP analysis (B19, C4), against a row-by-row fold in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.registry import query
from netloom.catalog.views import with_views
from netloom.operators.tcp import label_segments, relative_numbers

_FORWARD = "src_ip || ':' || src_port <= dst_ip || ':' || dst_port"
_STATE = "STRUCT(e BIGINT, a BIGINT, w BIGINT, k BOOLEAN, d BIGINT, o BIGINT, h BIGINT)"
# one step per segment: own and peer state in, label and new states out
_FOLD = f"""RECURSIVE WITH q AS (
  SELECT session_id, frame_number, CASE WHEN {_FORWARD} THEN src_ip || '>' || dst_ip ELSE dst_ip || '>' || src_ip END AS p, CASE WHEN {_FORWARD} THEN 0 ELSE 1 END AS dir,
         tcp_flags LIKE '%SYN%' AS syn, tcp_flags LIKE '%FIN%' AS fin, tcp_flags LIKE '%ACK%' AS ackf, tcp_flags LIKE '%PSH%' AS psh, seq, ack, win, payload_len AS len, has_sack AS sack,
         row_number() OVER (PARTITION BY session_id, CASE WHEN {_FORWARD} THEN src_ip || '>' || dst_ip ELSE dst_ip || '>' || src_ip END ORDER BY frame_number) AS n
  FROM segments WHERE tcp_flags NOT LIKE '%RST%' OR tcp_flags LIKE '%SYN%'),
fold AS (
  SELECT session_id, p, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS {_STATE}) AS s0, CAST(NULL AS {_STATE}) AS s1 FROM q GROUP BY session_id, p
  UNION ALL
  SELECT session_id, p, n, frame_number, label, CASE WHEN dir = 0 THEN mine ELSE other END, CASE WHEN dir = 0 THEN other ELSE mine END FROM (
   SELECT *, CASE WHEN syn THEN struct_pack(e := seq + 1, a := ack, w := win, k := false, d := CAST(0 AS BIGINT), o := frame_number, h := CASE WHEN ackf THEN ack ELSE 0 END)
       ELSE struct_pack(e := CASE WHEN f IS NULL THEN CASE WHEN eff > 0 THEN seq + eff ELSE seq END WHEN eff > 0 THEN greatest(f.e, seq + eff) ELSE f.e END, a := ack, w := win,
          k := CASE WHEN f IS NULL OR label = 'TCP Keep-Alive ACK' THEN false ELSE f.k END,
          d := CASE WHEN f IS NULL OR ack <> f.a THEN CAST(0 AS BIGINT) WHEN dup THEN f.d + 1 ELSE f.d END,
          o := CASE WHEN f IS NULL OR ack <> f.a THEN frame_number ELSE f.o END, h := CASE WHEN f IS NULL THEN ack ELSE greatest(f.h, ack) END) END AS mine,
     CASE WHEN ka AND r IS NOT NULL THEN struct_pack(e := r.e, a := r.a, w := r.w, k := true, d := r.d, o := r.o, h := r.h) ELSE r END AS other
   FROM (SELECT *, CASE WHEN ka THEN 'TCP Keep-Alive' WHEN kack THEN 'TCP Keep-Alive ACK' WHEN dup THEN 'TCP Dup ACK ' || f.o || '#' || (f.d + 1)
          WHEN syn THEN NULL WHEN f IS NOT NULL AND ackf AND (len > 0 OR fin) AND seq < f.e THEN
             CASE WHEN r IS NOT NULL AND seq + eff <= r.h THEN 'TCP Spurious Retransmission' WHEN seq + eff <= f.e THEN 'TCP Retransmission' ELSE 'TCP Out-Of-Order' END
          WHEN f IS NOT NULL AND ackf AND len = 0 AND win = 0 AND NOT fin THEN 'TCP ZeroWindow'
          WHEN f IS NOT NULL AND ackf AND len = 0 AND ack = f.a AND win <> f.w AND NOT psh AND NOT fin THEN 'TCP Window Update'
          WHEN f IS NOT NULL AND ackf AND len = 0 AND NOT psh AND NOT fin AND r IS NULL AND ack > 0 THEN 'TCP ACKed unseen segment'
          WHEN f IS NOT NULL AND (len > 0 OR fin) AND seq > f.e THEN 'TCP Previous segment not captured' END AS label
     FROM (SELECT *, coalesce(base AND NOT ka AND len = 0 AND NOT kack AND ack = f.a AND seq = f.e AND (win = f.w OR sack), false) AS dup
      FROM (SELECT *, coalesce(base AND NOT ka AND len = 0 AND f.k, false) AS kack
       FROM (SELECT *, coalesce(base AND len <= 1 AND seq = f.e - 1, false) AS ka
        FROM (SELECT q.*, CASE WHEN q.dir = 0 THEN z.s0 ELSE z.s1 END AS f, CASE WHEN q.dir = 0 THEN z.s1 ELSE z.s0 END AS r, q.len + CASE WHEN q.fin THEN 1 ELSE 0 END AS eff,
                 coalesce((CASE WHEN q.dir = 0 THEN z.s0 ELSE z.s1 END) IS NOT NULL AND q.ackf AND NOT q.fin AND NOT q.psh AND NOT q.syn, false) AS base
              FROM fold z JOIN q ON q.session_id = z.session_id AND q.p = z.p AND q.n = z.n + 1) a) b) c) d) e) g)
"""
LABELS = {
    "c04a_keep_alive": "TCP Keep-Alive", "c04b_keep_alive_ack": "TCP Keep-Alive ACK",
    "c04c_dup_ack": "TCP Dup ACK %", "c04d_spurious_retransmission": "TCP Spurious Retransmission",
    "c04e_retransmission": "TCP Retransmission", "c04f_out_of_order": "TCP Out-Of-Order",
    "c04g_zero_window": "TCP ZeroWindow", "c04h_window_update": "TCP Window Update",
    "c04i_acked_unseen": "TCP ACKed unseen segment",
    "c04j_previous_not_captured": "TCP Previous segment not captured",
}


def _label_query(name: str, pattern: str):
    sql = _FOLD + f"SELECT session_id, frame_number, label AS tcp_label FROM fold WHERE label LIKE '{pattern}'"

    @query(name, with_views("segments", sql))
    def run(s):
        return label_segments(s.segments).filter(F.col("tcp_label").like(pattern))


for _name, _pattern in LABELS.items():
    _label_query(_name, _pattern)


@query("c04k_segment_labels", with_views("segments", _FOLD + "SELECT session_id, frame_number, label AS tcp_label FROM fold WHERE n > 0"))
def c04(s):
    return label_segments(s.segments)


@query("c04_large_groups", with_views("segments", _FOLD + "SELECT session_id, frame_number, label AS tcp_label FROM fold WHERE n > 0"))
def c04_large(s):
    """The same with every group treated as too large for one task."""
    return label_segments(s.segments, large_group=s.segments.count() // 100)


_BASE = f"""
WITH g AS (SELECT *, {_FORWARD} AS fw, CASE WHEN {_FORWARD} THEN src_ip || '>' || dst_ip ELSE dst_ip || '>' || src_ip END AS p, tcp_flags LIKE '%SYN%' AS syn, tcp_flags LIKE '%RST%' AS rst, tcp_flags LIKE '%ACK%' AS ackf FROM segments),
ev AS (SELECT session_id, p, fw AS side, frame_number AS t, 1 AS strong, seq AS base FROM g WHERE syn
       UNION ALL SELECT session_id, p, fw, frame_number, 0, seq - 1 FROM g WHERE NOT syn AND NOT rst
       UNION ALL SELECT session_id, p, NOT fw, frame_number, 0, ack - 1 FROM g WHERE NOT syn AND NOT rst AND ackf AND ack > 0),
st AS (SELECT session_id, p, side, t, base FROM ev WHERE strong = 1
       UNION ALL SELECT session_id, p, side, min(t), arg_min(base, t) FROM ev e WHERE strong = 0 AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.strong = 1 AND s.session_id = e.session_id AND s.p = e.p AND s.side = e.side AND s.t < e.t) GROUP BY session_id, p, side),
own AS (SELECT g.*, s.base AS sb FROM g ASOF LEFT JOIN st s ON g.session_id = s.session_id AND g.p = s.p AND g.fw = s.side AND g.frame_number >= s.t),
both_ AS (SELECT o.*, s.base AS ab FROM (SELECT *, NOT fw AS pw FROM own) o ASOF LEFT JOIN st s ON o.session_id = s.session_id AND o.p = s.p AND o.pw = s.side AND o.frame_number >= s.t)
SELECT b.session_id, b.frame_number, coalesce((seq - sb) & 4294967295, seq) AS rel_seq, coalesce((ack - ab) & 4294967295, ack) AS rel_ack,
       CASE WHEN syn THEN b.win ELSE b.win * (1 << CAST(coalesce((SELECT arg_max(win_scale, frame_number) FROM g w WHERE w.syn AND w.win_scale IS NOT NULL AND w.session_id = b.session_id AND w.p = b.p AND w.fw = b.fw AND w.frame_number <= b.frame_number), 0) AS BIGINT)) END AS scaled_win
FROM both_ b"""


@query("b19_relative_numbers", with_views("segments", _BASE))
def b19(s):
    return relative_numbers(s.segments)
