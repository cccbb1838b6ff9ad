"""SQL that grows the trees of the weight fits, level by level in recursive queries.

A row is a cell of feature values in the node it has come to; a step splits every node once.
"""

from __future__ import annotations

import math

#: Splits of the nodes of ``cur`` (tree, node, r, f, m, n, g): all sides, then the one that gains most.
_STEP = """
    sides_by_value AS (
      SELECT tree, node, k AS feature, [r, f, m][k + 1] AS v, sum(n) AS h, sum(g) AS g
      FROM cur, range(3) AS t(k) GROUP BY ALL),
    cumulated AS (
      SELECT tree, node, feature, v, lead(v) OVER w AS next_v, sum(h) OVER w AS hl, sum(g) OVER w AS gl,
             sum(h) OVER p AS h, sum(g) OVER p AS g
      FROM sides_by_value
      WINDOW w AS (PARTITION BY tree, node, feature ORDER BY v), p AS (PARTITION BY tree, node, feature)),
    rated AS (
      SELECT *, round(gl * gl / (hl + {penalty}) + (g - gl) * (g - gl) / (h - hl + {penalty})
                      - g * g / (h + {penalty}), 12) AS gain
      FROM cumulated WHERE next_v IS NOT NULL),
    winner AS (
      SELECT tree, node, feature, v, (v + next_v) / 2 AS threshold, gain
      FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, v) AS i FROM rated)
      WHERE i = 1 AND {enough}),
    gone_on AS (
      SELECT cur.* EXCLUDE (feature, parent, threshold, gain), w.feature, w.threshold, w.gain,
             CASE WHEN w.node IS NULL THEN cur.node
                  ELSE 2 * cur.node + CAST([r, f, m][w.feature + 1] > w.v AS INT) END AS child
      FROM cur LEFT JOIN winner w ON w.tree = cur.tree AND w.node = cur.node)"""

_NO_SPLIT = """CAST(NULL AS BIGINT) AS feature, CAST(NULL AS BIGINT) AS parent,
               CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS gain"""


def boosted(
    depth: int, rounds: int, rate: str, penalty: str, enough: str, base: str
) -> str:
    """Splits of boosted trees: ``tree``, ``place``, ``feature``, ``threshold``, ``gain``.

    ``enough`` is the condition on ``gain`` and the weight ``h`` of a node, ``rate`` an
    expression over ``step``.
    """
    return f"""
        WITH RECURSIVE start AS (
          SELECT r, f, m, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s
          FROM points WHERE y IS NOT NULL GROUP BY r, f, m),
        grow AS (
          SELECT 0 AS step, 0 AS tree, r, f, m, n, s, CAST({base} AS DOUBLE) AS predicted,
                 CAST(1 AS BIGINT) AS node, {_NO_SPLIT}
          FROM start
          UNION ALL
          (WITH cur AS (SELECT *, s - n * predicted AS g FROM grow WHERE step < {depth * rounds}),
           {_STEP.format(penalty=penalty, enough=enough)}
           SELECT step + 1 AS step, 0 AS tree, r, f, m, n, s,
                  CASE WHEN step % {depth} = {depth - 1}
                       THEN predicted + ({rate}) * sum(g) OVER leaf / (sum(n) OVER leaf + {penalty})
                       ELSE predicted END AS predicted,
                  CASE WHEN step % {depth} = {depth - 1} THEN 1 ELSE child END AS node,
                  feature, node AS parent, threshold, gain
           FROM gone_on WINDOW leaf AS (PARTITION BY child)))
        SELECT CAST((step - 1) // {depth} AS BIGINT) AS tree,
               row_number() OVER (PARTITION BY (step - 1) // {depth} ORDER BY step, parent) - 1 AS place,
               ['r_quartile', 'f_quartile', 'm_quartile'][feature + 1] AS feature, threshold, gain
        FROM (SELECT DISTINCT step, parent, feature, threshold, gain FROM grow WHERE feature IS NOT NULL)"""


def forest(trees: int, seed: int, depth: int) -> str:
    """Importances of a forest on samples drawn by hashes of the merchant's name: one row."""
    cutoffs = [
        round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)
    ]
    return f"""
        WITH RECURSIVE sampled AS (
          SELECT t AS tree, r, f, m, y,
                 len(list_filter({cutoffs}, lambda d: bits >= d)) AS w
          FROM (SELECT t, r, f, m, y, CAST('0x' || substr(
                       sha256('{seed}:' || (t // 16) || ':' || merchant_name), 4 * (t % 16) + 1, 4) AS INT) AS bits
                FROM points, range({trees}) AS u(t) WHERE y IS NOT NULL)),
        grow AS (
          SELECT 0 AS step, tree, r, f, m, CAST(sum(w) AS DOUBLE) AS n, sum(w * y) AS g,
                 CAST(1 AS BIGINT) AS node, {_NO_SPLIT}
          FROM sampled WHERE w > 0 GROUP BY tree, r, f, m
          UNION ALL
          (WITH cur AS (
             SELECT * FROM grow WHERE step < {depth}
             WINDOW q AS (PARTITION BY tree, node)
             QUALIFY round(sum(g * g / n) OVER q - (sum(g) OVER q) * (sum(g) OVER q) / sum(n) OVER q, 12) > 0),
           {_STEP.format(penalty="0", enough="true")}
           SELECT step + 1 AS step, tree, r, f, m, n, g, child AS node, feature, node AS parent, threshold, gain
           FROM gone_on)),
        gained AS (
          SELECT tree, feature, sum(gain) AS gain
          FROM (SELECT DISTINCT step, tree, parent, feature, gain FROM grow WHERE feature IS NOT NULL)
          GROUP BY tree, feature),
        shared AS (
          SELECT feature, gain / nullif(sum(gain) OVER (PARTITION BY tree), 0) AS part FROM gained)
        SELECT coalesce(sum(part) FILTER (feature = 0), 0) / sum(part) AS wr,
               coalesce(sum(part) FILTER (feature = 1), 0) / sum(part) AS wf,
               coalesce(sum(part) FILTER (feature = 2), 0) / sum(part) AS wm
        FROM shared"""


def shares(splits: str) -> str:
    """Part of the splits that each feature has: one row."""
    return f"""
        SELECT count(*) FILTER (feature = 'r_quartile') / count(*) AS wr,
               count(*) FILTER (feature = 'f_quartile') / count(*) AS wf,
               count(*) FILTER (feature = 'm_quartile') / count(*) AS wm
        FROM {splits}"""


RELATIONS = {
    "penalized_splits": boosted(
        3, 100, "0.1", "1", "gain > 1e-6", "(SELECT sum(s) / sum(n) FROM start)"
    ),
    "gradient_splits": boosted(
        3, 100, "CASE WHEN step < 3 THEN 1 ELSE 0.2 END", "0", "gain > 2.5e-13 * h", "0"
    ),
    "penalized": shares("penalized_splits"),
    "gradient": shares("gradient_splits"),
    "forest": forest(100, 42, 9),
}


def _weights(relation: str) -> str:
    return f"""
        SELECT round(wr, 6) AS recency, round(wf, 6) AS frequency, round(wm, 6) AS monetary
        FROM {relation}"""


def _scored(relation: str) -> str:
    return f"""
        SELECT merchant_name, r AS r_quartile, f AS f_quartile, m AS m_quartile,
               round(score, 6) AS weighted_rfm,
               round(score / max(score) OVER (), 6) AS normalized_weighted_rfm
        FROM (SELECT *, wr * r + wf * f + wm * m AS score FROM points, {relation})"""


QUERIES = {
    "boosted_splits": """
        SELECT tree, place, feature, threshold, round(gain, 6) AS gain FROM penalized_splits""",
    "fit_penalized_weights": _weights("penalized"),
    "fit_boosted_weights": _weights("gradient"),
    "fit_forest_weights": _weights("forest"),
    "weighted_scores_penalized": _scored("penalized"),
    "weighted_scores_boosted": _scored("gradient"),
    "weighted_scores_forest": _scored("forest"),
}
