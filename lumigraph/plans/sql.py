"""Pieces of DuckDB SQL that the registered queries share."""

from __future__ import annotations

from ..sources import graphs

#: Restart probability of the registered walks, and rounds after which nothing is left of (1 - RESTART) ** ROUNDS.
RESTART, ROUNDS = 0.4, 72

E = """e AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, round(sum(l_extendedprice * (1 - l_discount)), 2) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
V = """v AS (SELECT n_nationkey::BIGINT AS vertex, n_regionkey AS region, coalesce(x, 0) AS weight FROM nation
  LEFT JOIN (SELECT c_nationkey, round(sum(o_totalprice), 2) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON n_nationkey = c_nationkey)"""
T = "t AS (SELECT quantile_cont(w, 0.7) AS t FROM e)"
TARJAN = "g(src, dst, w) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {w}::DOUBLE)" for a, b, w in graphs.TARJAN) + ")"
STEP = "st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e)"
#: Replicas of the nations' weights, by order month.
P = "p AS (SELECT month(o_orderdate) AS perm, c_nationkey::BIGINT AS vertex, round(sum(o_totalprice) * 12, 2) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def walk(rounds: int = ROUNDS) -> str:
    """The walk as a chain of tables x0, x1, ..., each a round."""
    ident = f"SELECT vertex AS src, vertex AS dst, {RESTART}::DOUBLE AS w FROM v"
    chain = [f"x0 AS MATERIALIZED ({ident})"]
    for k in range(rounds):
        chain.append(f"x{k + 1} AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM ({ident} UNION ALL SELECT x.src, st.dst, x.w * st.w * {1 - RESTART} FROM x{k} x JOIN st ON x.dst = st.src) GROUP BY 1, 2)")
    return ", ".join(chain)


def strong(e: str = "e", v: str = "v", rev: bool = False) -> str:
    """lab(t, vertex, component) at every weight, and tt(t), the thresholds of the tree."""
    op, order = ("<=", "DESC") if rev else (">=", "ASC")
    return f"""th AS (SELECT DISTINCT w t FROM {e}), rr(t, s, d) AS (SELECT t, vertex, vertex FROM th, {v} UNION SELECT rr.t, rr.s, q.dst FROM rr JOIN {e} q ON q.src = rr.d AND q.w {op} rr.t),
lab AS MATERIALIZED (SELECT a.t, a.s AS vertex, min(a.d) AS component FROM rr a JOIN rr b ON a.t = b.t AND a.s = b.d AND a.d = b.s GROUP BY 1, 2),
sig AS (SELECT t, string_agg(component, ',' ORDER BY vertex) AS s FROM lab GROUP BY t),
tt AS (SELECT t FROM (SELECT t, s, lead(s) OVER (ORDER BY t {order}) AS n FROM sig) WHERE s IS DISTINCT FROM coalesce(n, (SELECT string_agg(vertex, ',' ORDER BY vertex) FROM {v})))"""


def tree(v: str = "v", rev: bool = False) -> str:
    """k(node, threshold, vs), the nodes of the tree, and up(node, parent); needs ``strong``."""
    best, order = ("min", "DESC") if rev else ("max", "ASC")
    return f"""sets AS (SELECT t, component, list_sort(list(vertex)) AS vs FROM lab WHERE t IN (SELECT t FROM tt) GROUP BY 1, 2 HAVING count(*) > 1),
n AS (SELECT vs, {best}(t) AS threshold FROM sets GROUP BY 1), whole AS (SELECT list_sort(list(vertex)) AS vs FROM {v}),
k AS (SELECT row_number() OVER (ORDER BY threshold {order} NULLS FIRST, vs[1]) AS node, threshold, vs FROM (SELECT vs, threshold FROM n UNION ALL SELECT vs, NULL FROM whole WHERE vs NOT IN (SELECT vs FROM n))),
up AS (SELECT a.node, arg_min(b.node, len(b.vs)) AS parent FROM k a JOIN k b ON len(b.vs) > len(a.vs) AND list_contains(b.vs, a.vs[1]) GROUP BY 1),
direct AS (SELECT u.vertex, arg_min(k.node, len(k.vs)) AS node FROM {v} u JOIN k ON list_contains(k.vs, u.vertex) GROUP BY 1)"""


TREE_ROWS = """SELECT k.node, up.parent, k.threshold, len(k.vs)::INT AS nvertices, k.vs[1] AS component, coalesce((SELECT string_agg(c.node, ',' ORDER BY c.node) FROM up c WHERE c.parent = k.node), '') AS children,
coalesce((SELECT string_agg(x.vertex, ',' ORDER BY x.vertex) FROM direct x WHERE x.node = k.node), '') AS vertices FROM k LEFT JOIN up ON up.node = k.node"""

#: Levels of the unrolled flows: more than any flow here has.
LEVELS = 8


def flows(where: str = "t IN (SELECT t FROM tt)", more: str = "") -> str:
    """c(t, vertex, component), ce (component edges), levels l0, l1, ... and flows, at the thresholds that ``where`` keeps."""
    levels = ["l0 AS (SELECT DISTINCT c.t, c.component AS s, c.component AS node, 0 AS len, coalesce(ce.w, 0) AS mw FROM c JOIN v ON c.vertex = v.vertex AND v.region = 0 LEFT JOIN ce ON ce.t = c.t AND ce.a = c.component AND ce.b = c.component)"]
    for k in range(1, LEVELS + 1):
        seen = " UNION ALL ".join(f"SELECT t, s, node FROM l{j}" for j in range(k))
        best = "ce.w" if k == 1 else "least(l.mw, ce.w)"
        levels.append(f"l{k} AS MATERIALIZED (SELECT l.t, l.s, ce.b AS node, {k} AS len, max({best}) AS mw FROM l{k - 1} l JOIN ce ON ce.t = l.t AND ce.a = l.node AND ce.a <> ce.b WHERE (l.t, l.s, ce.b) NOT IN (SELECT (t, s, node) FROM ({seen})) GROUP BY 1, 2, 3)")
    return (
        f"{E}, {V}, {strong()}, {more} c AS MATERIALIZED (SELECT * FROM lab WHERE {where}), ce AS MATERIALIZED (SELECT a.t, a.component AS a, b.component AS b, max(e.w) AS w FROM c a JOIN e ON e.src = a.vertex AND e.w >= a.t JOIN c b ON b.t = a.t AND b.vertex = e.dst GROUP BY 1, 2, 3), "
        + ", ".join(levels)
        + ", fl AS (SELECT f.*, (SELECT count(*) FROM c JOIN v USING (vertex) WHERE c.t = f.t AND c.component = f.s AND region = 0) AS ns, (SELECT count(*) FROM c JOIN v USING (vertex) WHERE c.t = f.t AND c.component = f.node AND region = 1) AS nt FROM ("
        + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(LEVELS + 1))
        + ") f), flows AS (SELECT t AS threshold, s AS src_comp, node AS dst_comp, len, mw AS minweight, ns AS n_src, nt AS n_dst FROM fl WHERE nt > 0)"
    )


#: Vertex flows, vf, and the subgraph, sub; need ``flows``.
VERTEX_FLOWS = """vf AS (SELECT f.threshold, a.vertex AS source, b.vertex AS target, src_comp, dst_comp, len, minweight FROM flows f JOIN c ca ON ca.t = threshold AND ca.component = src_comp JOIN v a ON a.vertex = ca.vertex AND a.region = 0
  JOIN c cb ON cb.t = threshold AND cb.component = dst_comp JOIN v b ON b.vertex = cb.vertex AND b.region = 1)"""
SUBGRAPH = """bk(t, node) AS (SELECT c.t, c.component FROM c JOIN v USING (vertex) WHERE region = 1 UNION SELECT bk.t, ce.a FROM bk JOIN ce ON ce.t = bk.t AND ce.b = bk.node),
way AS (SELECT DISTINCT fl.t, fl.node FROM fl JOIN bk ON bk.t = fl.t AND bk.node = fl.node),
sub AS (SELECT a.t AS threshold, e.src AS source, e.dst AS target, a.component AS src_comp, b.component AS dst_comp, e.w AS walkweight FROM e JOIN c a ON a.vertex = e.src JOIN c b ON b.vertex = e.dst AND b.t = a.t
  JOIN way x ON x.t = a.t AND x.node = a.component JOIN way y ON y.t = a.t AND y.node = b.component WHERE e.w >= a.t)"""


def tail(z: str) -> str:
    """P(Z >= z) by the fit that the column function uses."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = "0.0"
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = f"({poly} * {t} + {c}::DOUBLE)"
    p = f"({t} * exp(-{x} * {x} - 1.26551223::DOUBLE + {t} * {poly}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN {p} ELSE 1 - {p} END"


def fisher(hits: str, size: str, all_hits: str, total: str) -> str:
    """P(X >= hits) for a draw of ``size`` from ``total`` with ``all_hits`` hits."""
    choose = lambda n, k: f"(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - {k} + 1.0::DOUBLE))"
    low, high = f"greatest({hits}, {size} - ({total} - {all_hits}), 0)", f"least({size}, {all_hits})"
    term = f"exp({choose(f'({all_hits})', 'k')} + {choose(f'({total} - {all_hits})', f'({size} - k)')} - {choose(f'({total})', f'({size})')})"
    return f"least(1.0::DOUBLE, coalesce(list_sum(list_transform(range(({low})::BIGINT, ({high})::BIGINT + 1), lambda k: {term})), 0))"
