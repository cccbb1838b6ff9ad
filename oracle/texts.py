"""DuckDB SQL for each query.  A text takes the relations it names, in order, as CTEs."""

from __future__ import annotations

import re

from oracle import trees

# The input tables, from the raw ones; FIXTURES.md section 3.
RELATIONS = {
    "companies": """
        SELECT s_suppkey AS id,
               s_name || CASE WHEN s_suppkey % 25 = 7 THEN ' CHURN' ELSE '' END AS name,
               CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS is_disabled,
               CASE s_suppkey % 2 WHEN 0 THEN 'POS_A' ELSE 'POS_B' END AS payment_integration,
               s_suppkey + 5000 AS payment_credentials_id,
               'M' || s_suppkey AS pos_merchant_id
        FROM supplier""",
    "locations": """
        SELECT s_suppkey * 10 + k AS id, s_name || '/' || k AS name,
               CASE WHEN k = 2 AND s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted,
               s_suppkey AS company_id
        FROM supplier, range(3) AS r(k)""",
    "credentials": """
        SELECT payment_credentials_id AS id,
               CASE WHEN id % 4 = 0 THEN pos_merchant_id END AS merchant_id
        FROM companies WHERE payment_integration = 'POS_A'""",
    "shop_orders": """
        SELECT l_orderkey * 100000 + l_suppkey AS id, o_custkey AS user_id,
               l_suppkey AS company_id, l_suppkey * 10 + l_orderkey % 3 AS location_id,
               o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS ordered_on,
               o_orderstatus IN ('F', 'P') AS done, SUM(l_extendedprice) AS total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY ALL""",
    "pos_a_locations": """
        SELECT l.id, c.pos_merchant_id AS merchant_id, l.name AS business_name,
               c.name AS merchant_name,
               CASE WHEN c.id % 3 = 0 OR c.id % 10 <> 8 THEN c.payment_credentials_id
                    + CASE WHEN l.id % 10 = 1 AND c.id % 20 = 0 THEN 1 ELSE 0 END
               END AS resolved_id
        FROM locations l JOIN companies c ON c.id = l.company_id
        WHERE c.payment_integration = 'POS_A'""",
    "pos_a_payments": """
        SELECT l_orderkey * 100 + l_linenumber AS id, l_suppkey * 10 + l_orderkey % 3 AS location_id,
               CAST(l_shipdate AS DATE) AS paid_on, l_returnflag = 'R' AS flagged,
               o_custkey AS customer_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_suppkey % 2 = 0 AND l_linestatus = 'F'
          AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-09-30'""",
    "pos_b_orders": """
        SELECT l_suppkey * 10 + l_orderkey % 3 AS location_id, name AS merchant_name,
               strftime(l_shipdate, '%Y-%m') AS period, l_extendedprice * 4 AS amount
        FROM lineitem JOIN companies ON id = l_suppkey
        WHERE l_suppkey % 2 = 1
          AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-09-30'""",
    # Cohorts.
    "starters": """
        SELECT user_id, company_id, c.name AS merchant_name, min(ordered_on) AS started_on
        FROM shop_orders JOIN companies c ON c.id = company_id
        WHERE done GROUP BY ALL""",
    "matrix": """
        SELECT merchant_name, strftime(started_on, '%Y-%m') AS cohort_period,
               strftime(ordered_on, '%Y-%m') AS order_period,
               count(DISTINCT user_id) AS customers, sum(total) AS revenue
        FROM shop_orders JOIN starters USING (user_id, company_id)
        WHERE done GROUP BY ALL""",
    "rolled": """
        SELECT merchant_name,
               CASE WHEN contains(merchant_name, '7') THEN 'Seven' ELSE 'Not seven' END AS merchant,
               cohort_period, CAST(sum(customers) AS BIGINT) AS active_customers,
               round(sum(revenue), 2) AS total_revenue
        FROM matrix WHERE cohort_period >= '1996-01' GROUP BY ALL""",
    # Identity and activity.
    "bridge": """
        SELECT DISTINCT merchant_id, merchant_name, resolved_id
        FROM pos_a_locations WHERE resolved_id IS NOT NULL""",
    "bounds": """
        SELECT c.id, c.name, c.payment_integration, c.payment_credentials_id, c.pos_merchant_id,
               c.is_disabled = 1 OR contains(c.name, 'CHURN') AS is_churned,
               min(o.ordered_on) AS first_order, max(o.ordered_on) AS latest_order
        FROM companies c JOIN shop_orders o ON o.company_id = c.id AND o.done
        GROUP BY ALL""",
    "spans_a": """
        SELECT DISTINCT first_order, latest_order, name, id, is_churned,
               coalesce(merchant_id, pos_merchant_id) AS pos_merchant_id
        FROM bounds JOIN bridge ON resolved_id = payment_credentials_id
        WHERE payment_integration = 'POS_A'""",
    "spans_b": """
        SELECT first_order, latest_order, name, id AS company_id, is_churned
        FROM bounds WHERE payment_integration = 'POS_B'""",
    "gated_orders": """
        SELECT * FROM shop_orders o
        WHERE EXISTS (FROM spans_b s WHERE s.company_id = o.company_id
                      AND o.ordered_on >= s.first_order
                      AND (NOT s.is_churned OR o.ordered_on <= s.latest_order))""",
    # Channel share.
    "flag_counts": """
        SELECT l.id, l.merchant_id, l.business_name,
               count(p.id) FILTER (WHERE flagged) AS flagged_count
        FROM pos_a_locations l JOIN pos_a_payments p ON p.location_id = l.id
        GROUP BY ALL""",
    "gated_payments": """
        SELECT f.merchant_id, b.merchant_name, p.*
        FROM pos_a_payments p
        JOIN flag_counts f ON f.id = p.location_id AND f.flagged_count > 0
        JOIN bridge b ON b.merchant_id = f.merchant_id
        WHERE EXISTS (FROM spans_a s WHERE s.pos_merchant_id = f.merchant_id
                      AND p.paid_on >= s.first_order
                      AND (NOT s.is_churned OR p.paid_on <= s.latest_order))""",
    "sales_a": """
        SELECT merchant_id, merchant_name AS business_name, strftime(paid_on, '%Y-%m') AS period,
               CAST(sum(amount) AS BIGINT) AS total_order,
               CAST(coalesce(sum(amount) FILTER (WHERE flagged), 0) AS BIGINT) AS platform_total,
               CAST(coalesce(sum(amount) FILTER (WHERE NOT flagged), 0) AS BIGINT) AS other_total,
               avg(amount) FILTER (WHERE flagged) AS platform_avg_total,
               avg(amount) FILTER (WHERE NOT flagged) AS other_avg_total,
               count(amount) FILTER (WHERE flagged) AS platform_order_count,
               count(amount) FILTER (WHERE NOT flagged) AS other_order_count,
               count(customer_id) FILTER (WHERE flagged) AS platform_customer_count,
               count(customer_id) FILTER (WHERE NOT flagged) AS other_customer_count,
               count(DISTINCT customer_id) FILTER (WHERE flagged) AS platform_unique_customers,
               count(DISTINCT customer_id) FILTER (WHERE NOT flagged) AS other_unique_customers
        FROM gated_payments GROUP BY ALL""",
    "pos_b": """
        SELECT location_id, merchant_name, period, sum(amount) AS pos_sum
        FROM pos_b_orders GROUP BY ALL""",
    "direct": """
        SELECT l.id AS location_id, l.name AS location_name,
               strftime(ordered_on, '%Y-%m') AS period, sum(total) AS own_sum
        FROM gated_orders o JOIN locations l ON l.id = o.location_id AND l.is_deleted = 0
        WHERE done AND ordered_on BETWEEN DATE '1996-01-01' AND DATE '1996-09-30'
        GROUP BY ALL""",
    "sides": "SELECT * FROM pos_b JOIN direct USING (location_id, period)",
    "totals_b": """
        SELECT merchant_name, period, sum(own_sum) AS own, sum(pos_sum) AS pos,
               CASE WHEN sum(pos_sum) = 0 THEN 0 ELSE sum(own_sum) / sum(pos_sum) END AS share
        FROM sides GROUP BY ALL""",
    "sales": """
        SELECT period, business_name AS merchant_name,
               platform_total / nullif(total_order, 0) AS share, platform_total / 100 AS platform,
               other_total / 100 AS other, total_order / 100 AS total
        FROM sales_a WHERE platform_total / nullif(total_order, 0) <= 1
        UNION ALL BY NAME
        SELECT period, merchant_name, share, own AS platform, pos - own AS other, pos AS total
        FROM totals_b WHERE share <= 1""",
    # Segments.
    "totals": """
        SELECT merchant_name, avg(share) AS avg_share, sum(platform) AS platform,
               sum(total) AS revenue, sum(platform) / nullif(sum(total), 0) AS share
        FROM sales GROUP BY ALL""",
    "large": """
        SELECT * FROM totals
        QUALIFY ntile(4) OVER (ORDER BY revenue DESC NULLS LAST, merchant_name) = 1""",
    "labels": """
        SELECT merchant_name, 'Merchant ' || row_number() OVER
               (ORDER BY share DESC NULLS LAST, merchant_name) AS merchant_label
        FROM large""",
    "best": """
        SELECT merchant_name FROM large
        ORDER BY share DESC NULLS LAST, merchant_name LIMIT 10""",
    "worst": """
        SELECT merchant_name FROM large
        ORDER BY share NULLS FIRST, merchant_name LIMIT 10""",
    # Customers.
    "best_orders": """
        SELECT user_id, company_id, c.name AS merchant_name, created_at, total,
               count(*) OVER (PARTITION BY user_id, company_id) AS order_count
        FROM shop_orders JOIN companies c ON c.id = company_id
        WHERE done AND c.name IN (FROM best)""",
    "worst_orders": """
        SELECT user_id, company_id, c.name AS merchant_name, created_at, total,
               count(*) OVER (PARTITION BY user_id, company_id) AS order_count
        FROM shop_orders JOIN companies c ON c.id = company_id
        WHERE done AND c.name IN (FROM worst)""",
    "best_lives": """
        SELECT user_id, merchant_name, min(created_at) AS first_at, max(created_at) AS last_at,
               sum(total) AS revenue, max(order_count) AS n
        FROM best_orders GROUP BY ALL""",
    "worst_lives": """
        SELECT user_id, merchant_name, min(created_at) AS first_at, max(created_at) AS last_at,
               sum(total) AS revenue, max(order_count) AS n
        FROM worst_orders GROUP BY ALL""",
    # RFM over the large merchants, and over all with sales.
    "rfm_large": """
        SELECT t.merchant_name, t.share, DATE '2001-09-01' - max(o.ordered_on) AS recency,
               max(o.created_at) AS last_at, count(o.id) AS frequency, sum(o.total) AS monetary
        FROM large t JOIN companies c ON c.name = t.merchant_name
        JOIN shop_orders o ON o.company_id = c.id
        GROUP BY ALL HAVING sum(o.total) <> 0""",
    "rfm_all": """
        SELECT t.merchant_name, t.share, DATE '2001-09-01' - max(o.ordered_on) AS recency,
               count(o.id) AS frequency
        FROM totals t JOIN companies c ON c.name = t.merchant_name
        JOIN shop_orders o ON o.company_id = c.id
        GROUP BY ALL HAVING sum(o.total) <> 0""",
    "scores": """
        SELECT *, ntile(4) OVER (ORDER BY recency DESC, frequency, merchant_name) AS r,
               ntile(4) OVER (ORDER BY frequency, merchant_name) AS f,
               ntile(4) OVER (ORDER BY share NULLS FIRST, merchant_name) AS m
        FROM rfm_large""",
    "points": """
        SELECT merchant_name, share AS y,
               ntile(4) OVER (ORDER BY recency DESC, frequency, merchant_name) AS r,
               ntile(4) OVER (ORDER BY frequency, merchant_name) AS f,
               ntile(4) OVER (ORDER BY share NULLS FIRST, merchant_name) AS m
        FROM rfm_all""",
    # Least squares with three standardized features, solved by Cramer's rule.
    "moments": """
        SELECT corr(r, f) AS rf, corr(r, m) AS rm, corr(f, m) AS fm,
               covar_pop(r, y) / stddev_pop(r) AS ry, covar_pop(f, y) / stddev_pop(f) AS fy,
               covar_pop(m, y) / stddev_pop(m) AS my,
               stddev_pop(r) AS dr, stddev_pop(f) AS df, stddev_pop(m) AS dm
        FROM points""",
    "fitted": """
        SELECT (ry * (1 - fm * fm) + fy * (rm * fm - rf) + my * (rf * fm - rm)) / det AS wr,
               (ry * (rm * fm - rf) + fy * (1 - rm * rm) + my * (rf * rm - fm)) / det AS wf,
               (ry * (rf * fm - rm) + fy * (rf * rm - fm) + my * (1 - rf * rf)) / det AS wm,
               dr, df, dm
        FROM (SELECT *, 1 + 2 * rf * rm * fm - rf * rf - rm * rm - fm * fm AS det FROM moments)""",
    "weighted": """
        SELECT merchant_name, r, f, m, wm, wr * r + wf * f + wm * m AS score
        FROM points, fitted""",
}
RELATIONS |= trees.RELATIONS


def _split_report(picked: str) -> str:
    return f"""
        SELECT merchant_name, merchant_label, type,
               round(sum(CASE type WHEN 'Platform' THEN platform ELSE other END), 2)
                 AS total_revenue
        FROM sales JOIN labels USING (merchant_name), (VALUES ('Platform'), ('Other')) AS t(type)
        WHERE merchant_name IN (FROM {picked}) GROUP BY ALL"""


def _customer_report(lives: str) -> str:
    return f"""
        SELECT merchant_name, merchant_label, many AS repeat_customer_count,
               single AS first_time_customer_count,
               round(orders_each, 6) AS avg_orders_per_repeat_customer,
               round(many_sum, 2) AS total_revenue_from_repeat_customers,
               round(single_sum, 2) AS total_revenue_from_first_time_customers,
               round(100 * many_sum / (many_sum + single_sum), 2)
                 AS repeat_customer_revenue_percentage,
               round(100 * single_sum / (many_sum + single_sum), 2)
                 AS first_time_customer_revenue_percentage
        FROM (SELECT merchant_name, count(user_id) FILTER (WHERE n > 1) AS many,
                     count(user_id) FILTER (WHERE n = 1) AS single,
                     avg(n) FILTER (WHERE n > 1) AS orders_each,
                     sum(revenue) FILTER (WHERE n > 1) AS many_sum,
                     sum(revenue) FILTER (WHERE n = 1) AS single_sum,
                     count(*) FILTER (WHERE n > 1) AS many_rows,
                     count(*) FILTER (WHERE n = 1) AS single_rows
              FROM {lives} GROUP BY ALL) JOIN labels USING (merchant_name)
        WHERE many_rows > 0 AND single_rows > 0"""


def _rfm_report(picked: str) -> str:
    return f"""
        SELECT merchant_name, merchant_label, round(share, 6) AS overall_share_per_merchant,
               recency, frequency, round(monetary, 2) AS monetary, r AS r_quartile,
               f AS f_quartile, m AS m_quartile, '' || r || f || m AS rfm_score,
               round((0.28287841191067 * r + 0.34987593052109184 * f + 0.3672456575682382 * m) / 4, 6) AS weighted_rfm
        FROM scores JOIN labels USING (merchant_name) WHERE merchant_name IN (FROM {picked})"""


QUERIES = {
    "orders_by_hour": """
        SELECT c.name AS merchant_name, hour(ts) AS hour, count(*) AS order_count
        FROM events JOIN companies c ON c.id = user_id % 10 GROUP BY ALL""",
    "orders_by_weekday": """
        SELECT c.name AS merchant_name, dayofweek(created_at) AS day_of_the_week,
               count(*) AS order_count
        FROM shop_orders JOIN companies c ON c.id = company_id GROUP BY ALL""",
    "category_popularity": """
        SELECT c.name AS merchant_name,
               CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'ECONOMY' THEN 'Economy'
                    ELSE p_type END AS category_name,
               count(*) AS total_orders, round(avg(p_retailprice), 6) AS average_price
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN companies c ON c.id = l_suppkey
        JOIN orders ON o_orderkey = l_orderkey
        WHERE p_name NOT ILIKE '%test%' AND c.name NOT ILIKE '%test%'
        GROUP BY c.name, p_type""",
    "first_activity": """
        SELECT user_id, company_id, merchant_name, CAST(started_on AS VARCHAR) AS first_order_date
        FROM starters""",
    "cohort_activity_matrix": """
        SELECT merchant_name, cohort_period, order_period, customers AS active_customers,
               round(revenue, 2) AS total_revenue
        FROM matrix""",
    "cohort_rollup": "SELECT * FROM rolled",
    "cohort_report": "SELECT * FROM rolled",
    "resolve_external_ids": "SELECT * FROM bridge",
    "activity_span_bridged": """
        SELECT * REPLACE (CAST(first_order AS VARCHAR) AS first_order,
                          CAST(latest_order AS VARCHAR) AS latest_order) FROM spans_a""",
    "activity_span": """
        SELECT * REPLACE (CAST(first_order AS VARCHAR) AS first_order,
                          CAST(latest_order AS VARCHAR) AS latest_order) FROM spans_b""",
    "active_entities": """
        SELECT DISTINCT c.name, c.id, CAST(c.is_disabled AS BIGINT) AS is_disabled,
               coalesce(k.merchant_id, c.pos_merchant_id) AS pos_merchant_id
        FROM companies c JOIN credentials k ON k.id = c.payment_credentials_id
        WHERE c.payment_integration = 'POS_A' AND c.is_disabled = 0
          AND NOT contains(c.name, 'CHURN') AND c.id IN (SELECT company_id FROM shop_orders)""",
    "live_locations": "SELECT id, name FROM locations WHERE is_deleted = 0",
    "activity_gate": """
        SELECT id, company_id AS company_ord_fk, CAST(ordered_on AS VARCHAR) AS ordered_on
        FROM gated_orders""",
    "flagged_count_by_location": """
        SELECT id AS pos_location_id, merchant_id AS pos_merchant_id,
               business_name AS pos_merchant_name, flagged_count AS platform_order_count
        FROM flag_counts""",
    "channel_sales_by_period": """
        SELECT * REPLACE (round(platform_avg_total, 6) AS platform_avg_total,
                          round(other_avg_total, 6) AS other_avg_total),
               round(platform_total / nullif(total_order, 0), 6) AS share_per_merchant
        FROM sales_a""",
    "pos_totals_by_location_period": """
        SELECT round(pos_sum, 2) AS total_orders_sum, location_id, merchant_name, period
        FROM pos_b""",
    "direct_orders_by_location_period": """
        SELECT location_id, location_name, round(own_sum, 2) AS total_orders_sum, period
        FROM direct""",
    "share_by_location_period": """
        SELECT round(CASE WHEN pos_sum = 0 THEN 0 ELSE own_sum / pos_sum END, 6) AS share,
               round(own_sum, 2) AS total_platform_orders_sum,
               round(pos_sum, 2) AS total_orders_sum, location_id, merchant_name, location_name,
               period
        FROM sides""",
    "share_by_period": """
        SELECT round(share, 6) AS share, merchant_name, period FROM totals_b""",
    "channel_totals_by_period": """
        SELECT merchant_name, period, round(own, 2) AS platform_total, round(pos, 2) AS total,
               round(share, 6) AS share_per_merchant
        FROM totals_b""",
    "union_channel_sales": """
        SELECT period, merchant_name, round(share, 6) AS share_per_merchant,
               round(platform, 2) AS platform_total, round(other, 2) AS other_total,
               round(total, 2) AS total_order
        FROM sales""",
    "top_revenue_quartile": """
        SELECT merchant_name, round(avg_share, 6) AS avg_share_per_merchant,
               round(platform, 2) AS total_platform_revenue, round(revenue, 2) AS total_revenue,
               round(share, 6) AS overall_share_per_merchant
        FROM large""",
    "anonymize_by_rank": "SELECT * FROM labels",
    "pick_k_top": "SELECT * FROM best",
    "pick_k_bottom": "SELECT * FROM worst",
    "channel_split_report_top": _split_report("best"),
    "channel_split_report_bottom": _split_report("worst"),
    "customer_orders": """
        SELECT user_id, company_id, merchant_name, CAST(created_at AS VARCHAR) AS created_at,
               'COMPLETED' AS orderStatus, round(total, 2) AS order_total, order_count
        FROM best_orders""",
    "customer_lifetime": """
        SELECT user_id, merchant_name, CAST(first_at AS VARCHAR) AS first_order_date,
               CAST(last_at AS VARCHAR) AS last_order_date, round(revenue, 2) AS total_revenue,
               n AS total_orders
        FROM best_lives""",
    "repeat_customers": """
        SELECT merchant_name, count(user_id) AS repeat_customer_count,
               round(avg(n), 6) AS avg_orders_per_repeat_customer,
               round(sum(revenue), 2) AS total_revenue_from_repeat_customers
        FROM best_lives WHERE n >= 2 GROUP BY ALL""",
    "first_time_customers": """
        SELECT merchant_name, count(user_id) AS first_time_customer_count,
               round(sum(revenue), 2) AS total_revenue_from_first_time_customers
        FROM best_lives WHERE n = 1 GROUP BY ALL""",
    "repeat_vs_first_time_report_top": _customer_report("best_lives"),
    "repeat_vs_first_time_report_bottom": _customer_report("worst_lives"),
    "rfm_base": """
        SELECT merchant_name, round(share, 6) AS overall_share_per_merchant, recency,
               CAST(last_at AS VARCHAR) AS last_order_date, frequency,
               round(monetary, 2) AS monetary
        FROM rfm_large""",
    "rfm_quartiles": """
        SELECT merchant_name, round(share, 6) AS overall_share_per_merchant, recency,
               CAST(last_at AS VARCHAR) AS last_order_date, frequency,
               round(monetary, 2) AS monetary, r AS r_quartile, f AS f_quartile, m AS m_quartile
        FROM scores""",
    "rfm_report_top": _rfm_report("best"),
    "rfm_report_bottom": _rfm_report("worst"),
    "standardize": """
        SELECT merchant_name,
               round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS r_quartile_z,
               round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS f_quartile_z,
               round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS m_quartile_z
        FROM points""",
    "fit_linear_weights": """
        SELECT round(wr, 6) AS recency, round(wf, 6) AS frequency, round(wm, 6) AS monetary
        FROM fitted""",
    "fit_linear_weights_raw": """
        SELECT round(wr / dr, 6) AS recency, round(wf / df, 6) AS frequency,
               round(wm / dm, 6) AS monetary
        FROM fitted""",
    "normalize_to_shares": """
        SELECT round(wr / (wr + wf + wm), 6) AS recency, round(wf / (wr + wf + wm), 6) AS frequency,
               round(wm / (wr + wf + wm), 6) AS monetary
        FROM fitted""",
    "apply_weights": """
        SELECT merchant_name, r AS r_quartile, f AS f_quartile, m AS m_quartile,
               round(score, 6) AS weighted_rfm
        FROM weighted""",
    "normalize_by_max": """
        SELECT merchant_name, r AS r_quartile, f AS f_quartile, m AS m_quartile,
               round(score, 6) AS weighted_rfm,
               round(score / (SELECT max(score) FROM weighted), 6) AS normalized_weighted_rfm
        FROM weighted""",
    "scaled_weight_by_max": """
        SELECT round(max(wm) / max(score), 6) AS scaled_weight FROM weighted""",
}

QUERIES |= trees.QUERIES
# The same results by another way.
QUERIES |= {
    "category_popularity_bucketed": QUERIES["category_popularity"],
    "orders_by_weekday_catalog": QUERIES["orders_by_weekday"],
    "monthly_sales_refreshed": QUERIES["union_channel_sales"],
    "fit_penalized_weights_csv": QUERIES["fit_penalized_weights"],
    "rfm_base_today": """
        SELECT merchant_name, round(share, 6) AS overall_share_per_merchant,
               current_date - CAST(last_at AS DATE) AS recency,
               CAST(last_at AS VARCHAR) AS last_order_date, frequency,
               round(monetary, 2) AS monetary
        FROM rfm_large""",
}

_NAMED = "'Supplier#000000002', 'Supplier#000000003', 'Supplier#000000007 CHURN'"
QUERIES |= {
    f"{name}_named": f"SELECT * FROM ({QUERIES[name]}) WHERE merchant_name IN ({_NAMED})"
    for name in ("orders_by_hour", "orders_by_weekday", "category_popularity", "first_activity")
}


def _text(query: str) -> str:
    def names_in(sql: str) -> set[str]:
        return set(re.findall(r"\w+", sql)) & RELATIONS.keys()

    needed, todo = set(), names_in(query)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= names_in(RELATIONS[name]) - needed
    ctes = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in RELATIONS.items() if n in needed)
    return f"WITH {ctes} {query}" if ctes else query


def oracle_texts() -> dict[str, str]:
    return {name: _text(query) for name, query in QUERIES.items()}
