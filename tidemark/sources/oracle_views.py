"""The same canonical views as DuckDB common table expressions (the oracle's half)."""

from __future__ import annotations

from tidemark.sources import adapters as ad


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def pick(expr: str, values) -> str:
    return f"list_extract({_list(values)}, CAST(({expr}) % {len(values)} AS INT) + 1)"


def _person(pid: str) -> str:
    return (f"{pick(pid, ad.CHANNELS)} AS acquisition_channel, "
            f"'region_' || CAST({pid} % 5 AS VARCHAR) AS region, "
            f"{pick(pid, ad.AGE_BANDS)} AS age_band, {pick(pid, ad.INCOME_BANDS)} AS income_band, "
            f"{pick(pid, ad.DEVICES)} AS device_type, ({pid} % 4 <> 0) AS email_opt_in")


_STAGE = "list_position(" + _list(ad.STAGE_EVENTS) + ", event_type)"
_EXP = ad.EXPERIMENT

JOURNEY = f"""
ev AS (SELECT event_id, user_id, ts, event_type, value,
              CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
j_people AS (SELECT user_id, min(ts) AS created_at,
              min(CASE WHEN event_type = 'purchase' THEN ts END) AS customer_since
              FROM ev GROUP BY user_id),
j_prospects AS (SELECT user_id AS prospect_id, created_at,
              CASE WHEN user_id % 5 <> 0 THEN user_id % 25 END AS campaign_id,
              {_person('user_id')} FROM j_people),
j_customers AS (SELECT user_id AS customer_id, user_id AS prospect_id, customer_since,
              {_person('user_id')} FROM j_people WHERE customer_since IS NOT NULL),
j_sessions AS (SELECT session_id, user_id AS prospect_id,
              CASE WHEN session_start >= customer_since THEN user_id END AS customer_id,
              session_start, {pick('session_id', ad.PLATFORMS)} AS platform,
              {pick('user_id', ad.DEVICES)} AS device_type,
              {pick('session_id', ad.SOURCES)} AS traffic_source,
              CASE WHEN user_id % 5 <> 0 THEN user_id % 25 END AS campaign_id, pages_viewed
              FROM (SELECT user_id, user_id * 1000 + dayofyear(ts) AS session_id,
                    min(ts) AS session_start, count(*) AS pages_viewed FROM ev GROUP BY 1, 2)
              JOIN (SELECT user_id, customer_since FROM j_people) USING (user_id)),
j_funnel AS (SELECT event_id, user_id * 1000 + dayofyear(ts) AS session_id, ts AS event_ts,
              list_extract({_list(ad.STAGES)}, CAST({_STAGE} AS INT)) AS event_type,
              CAST({_STAGE} AS BIGINT) AS stage_number FROM ev),
j_touches AS (SELECT event_id AS touch_id, user_id AS prospect_id,
              CASE WHEN ts >= customer_since THEN user_id END AS customer_id,
              user_id % 25 AS campaign_id, {pick('user_id', ad.CHANNELS)} AS channel,
              CASE event_type WHEN 'view' THEN 'email' WHEN 'click' THEN 'ad_click'
                   ELSE 'referral_credit' END AS touch_type,
              ts AS touch_at, k % 2 = 0 AS opened, k % 3 = 0 AS clicked, value / 100 AS cost
              FROM ev JOIN (SELECT user_id, customer_since FROM j_people) USING (user_id)
              WHERE event_type IN ('view', 'click', 'signup')),
j_orders AS (SELECT event_id AS order_id, user_id AS customer_id, ts AS order_ts,
              CASE WHEN k % 3 = 0 THEN 'store' WHEN k % 3 = 1 THEN 'app' ELSE 'web' END
                AS order_channel,
              CASE WHEN k % 3 <> 0 THEN user_id * 1000 + dayofyear(ts) END AS session_id,
              CASE WHEN k < 50 THEN k % 25 END AS campaign_id, k % 3 + 1 AS item_count,
              value AS gross_amount,
              CASE WHEN k < 50 THEN value * 0.1::DOUBLE ELSE 0.0::DOUBLE END AS discount_amount,
              CASE WHEN k < 50 THEN value - value * 0.1::DOUBLE ELSE value END AS net_amount
              FROM ev WHERE event_type = 'purchase'),
j_lines AS (SELECT order_id * 10 + 1 AS order_line_id, order_id, order_id % 100 AS product_id,
              item_count AS quantity, gross_amount / item_count AS unit_price, discount_amount,
              net_amount FROM j_orders),
j_subs AS (SELECT event_id AS subscription_event_id, user_id AS customer_id, ts AS event_ts,
              CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'click' THEN 'renew'
                   ELSE 'cancel' END AS event_type,
              CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'annual' END AS plan, value AS amount
              FROM ev WHERE event_type IN ('signup', 'click', 'error')),
j_contacts AS (SELECT event_id AS contact_id, user_id AS customer_id,
              CASE WHEN k % 4 = 0 THEN event_id - 1 END AS order_id, ts AS contact_ts,
              CASE WHEN k % 5 <> 0 THEN ts + to_hours(k) END AS resolved_at,
              CASE WHEN k % 5 <> 0 THEN k % 5 + 1 END AS csat_score
              FROM ev WHERE event_type = 'error'),
j_campaigns AS (SELECT CAST(n_nationkey AS BIGINT) AS campaign_id, n_name || ' 1999'
              AS campaign_name, {pick('n_nationkey', ad.CHANNELS)} AS channel,
              {pick('n_nationkey', ad.OBJECTIVES)} AS objective,
              TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS start_date,
              TIMESTAMP '2024-01-01' + to_days(n_nationkey + 6) AS end_date,
              n_regionkey * 0.05::DOUBLE AS discount_pct FROM nation),
j_experiments AS (SELECT '{_EXP['experiment_id']}' AS experiment_id,
              TIMESTAMP '{_EXP['start']}' AS start_date, TIMESTAMP '{_EXP['end']}' AS end_date,
              0.5::DOUBLE AS treatment_share),
j_eligible AS (SELECT prospect_id, min(session_start) AS first_eligible_session FROM j_sessions
              WHERE customer_id IS NULL AND session_start >= TIMESTAMP '{_EXP['start']}'
                AND session_start < TIMESTAMP '2024-01-06' GROUP BY 1),
j_assignments AS (SELECT '{_EXP['experiment_id']}' AS experiment_id, prospect_id,
              CASE WHEN CAST('0x' || substr(sha256('{_EXP['experiment_id']}:' ||
                   CAST(prospect_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5
                   THEN 'treatment' ELSE 'control' END AS variant,
              first_eligible_session AS assigned_at FROM j_eligible)
"""

_BACK = f"({ad.LEDGER_SHIFT_DAYS} + ((event_id % 120) // 10) * 30)"

LEDGER = f"""
g_first AS (SELECT o_custkey, min(o_orderdate) AS customer_since FROM orders GROUP BY 1),
g_customers AS (SELECT c_custkey AS customer_id, c_custkey AS prospect_id, customer_since,
              c_mktsegment AS acquisition_channel, r_name AS region,
              {pick('c_custkey', ad.AGE_BANDS)} AS age_band,
              {pick('c_custkey', ad.INCOME_BANDS)} AS income_band,
              {pick('c_custkey', ad.DEVICES)} AS device_type, c_acctbal > 0 AS email_opt_in
              FROM customer JOIN g_first ON c_custkey = o_custkey
              JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g_prospects AS (SELECT prospect_id, customer_since - to_days(CAST(prospect_id % 120 AS INT))
              AS created_at, acquisition_channel, region, age_band, income_band, device_type,
              email_opt_in FROM g_customers),
g_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts,
              CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'store'
                   WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'app' ELSE 'web' END
                AS order_channel,
              CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderkey END AS session_id,
              CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 25 END AS campaign_id,
              CAST(floor(o_totalprice / 100000) + 1 AS BIGINT) AS item_count,
              o_totalprice AS gross_amount,
              CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.1::DOUBLE
                   ELSE 0.0::DOUBLE END AS discount_amount,
              o_totalprice - CASE WHEN o_orderpriority = '1-URGENT'
                   THEN o_totalprice * 0.1::DOUBLE ELSE 0.0::DOUBLE END AS net_amount
              FROM orders),
g_lines AS (SELECT l_orderkey * 10 + l_linenumber AS order_line_id, l_orderkey AS order_id,
              l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
              l_extendedprice / l_quantity AS unit_price,
              l_extendedprice * l_discount AS discount_amount,
              l_extendedprice * (1 - l_discount) AS net_amount FROM lineitem),
products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
              p_retailprice AS list_price, p_retailprice * 0.6::DOUBLE AS unit_cost FROM part),
g_campaigns AS (SELECT CAST(n_nationkey AS BIGINT) AS campaign_id, n_name || ' 1999'
              AS campaign_name, {pick('n_nationkey', ad.CHANNELS)} AS channel,
              {pick('n_nationkey', ad.OBJECTIVES)} AS objective,
              TIMESTAMP '1995-01-01' + to_days(n_nationkey * 90) AS start_date,
              TIMESTAMP '1995-01-01' + to_days(n_nationkey * 90 + 6) AS end_date,
              n_regionkey * 0.05::DOUBLE AS discount_pct FROM nation),
g_base AS (SELECT event_id, event_type, value,
              CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
              user_id * 10 + event_id % 10 AS customer_id,
              ts - to_days(CAST({_BACK} AS INT)) AS moved_at FROM events),
g_sessions AS (SELECT event_id AS session_id, customer_id AS prospect_id,
              customer_id, moved_at AS session_start, {pick('k', ad.PLATFORMS)} AS platform,
              {pick('customer_id', ad.DEVICES)} AS device_type,
              {pick('k', ad.SOURCES)} AS traffic_source, k AS pages_viewed
              FROM g_base WHERE event_type IN ('view', 'click')),
g_touches AS (SELECT event_id AS touch_id, customer_id AS prospect_id, customer_id,
              event_id % 25 AS campaign_id, {pick('k', ad.CHANNELS)} AS channel,
              CASE WHEN event_type = 'signup' THEN 'email' ELSE 'ad_click' END AS touch_type,
              moved_at AS touch_at, k % 2 = 0 AS opened, k % 4 = 0 AS clicked, value / 100 AS cost
              FROM g_base WHERE event_type IN ('signup', 'click')),
g_subs AS (SELECT event_id AS subscription_event_id, customer_id, moved_at AS event_ts,
              CASE k % 3 WHEN 0 THEN 'subscribe' WHEN 1 THEN 'renew' ELSE 'cancel' END
                AS event_type,
              CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'annual' END AS plan, value AS amount
              FROM g_base WHERE event_type = 'purchase'),
g_contacts AS (SELECT event_id AS contact_id, customer_id, moved_at AS contact_ts,
              CASE WHEN k % 5 <> 0 THEN moved_at + to_hours(k) END AS resolved_at,
              CASE WHEN k % 5 <> 0 THEN k % 5 + 1 END AS csat_score
              FROM g_base WHERE event_type = 'error')
"""

SCORES = """
scored AS (SELECT o_orderkey AS entity_id, o_custkey AS cluster_id,
              make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1) AS run_cutoff,
              CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
              (floor(o_totalprice / 5000) * 5 + 10) / 1000 AS score_a,
              CAST((o_custkey * 7919) % 97 + 1 AS DOUBLE) / 100 AS score_b,
              o_totalprice AS amount, o_totalprice / 1000 AS value FROM orders)
"""

ALL = ",".join([JOURNEY, LEDGER, SCORES])


def with_views(body: str, extra: str = "") -> str:
    """A full oracle statement: canonical views, optional extra CTEs, then the query."""
    return f"WITH {ALL}{',' + extra if extra.strip() else ''}\n{body}"
