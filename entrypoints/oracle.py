"""The named queries in ANSI SQL.

The SQL is written independently of the library. The constants of the generator, its salts and the
list of relationships are taken from it, as both sides must mean the same ones.

Each text is complete: the star schema is spelled out as common table expressions over the
retail tables.
"""

from __future__ import annotations

from galley.functions.columns import DRAW_ID_FACTOR, DRAW_PRIME, DRAW_SALT_FACTOR
from galley.plans.measures import RELATIONSHIPS
from galley.sources import synthetic

ORACLE: dict[str, str] = {}

# --- the star schema --------------------------------------------------------------------

STAR = """
raw_content AS (
  SELECT 'CNT' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS content_id, p_name AS title,
         p_brand AS brand, p_type AS section, split_part(p_name, ' ', -1) AS content_type,
         DATE '1995-01-01' + CAST((p_partkey * 7) % 2400 AS INTEGER) AS publish_date,
         'Author' || CAST(p_size AS VARCHAR) AS author, CAST(p_size * 50 AS INTEGER) AS word_count
  FROM part
), spans AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
  FROM orders GROUP BY o_custkey
), raw_subscriptions AS (
  SELECT 'SUB' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS subscriber_id,
         'Brand#' || CAST(c_nationkey + 1 AS VARCHAR) AS brand, first_day AS signup_date,
         c_mktsegment AS plan, r_name AS region, n_name AS channel,
         NOT (last_day < DATE '2001-01-01') AS is_active,
         CASE WHEN last_day < DATE '2001-01-01' THEN last_day END AS churn_date,
         CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 9.99 WHEN 'BUILDING' THEN 14.99
              WHEN 'FURNITURE' THEN 19.99 WHEN 'HOUSEHOLD' THEN 9.99 ELSE 14.99 END AS DOUBLE) AS mrr
  FROM customer LEFT JOIN spans ON c_custkey = o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), raw_engagement AS (
  SELECT 'EVT' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts AS event_timestamp,
         p_brand AS brand,
         'CNT' || lpad(CAST(event_id % (SELECT count(*) FROM part) AS VARCHAR), 12, '0') AS content_id,
         CASE WHEN event_type NOT IN ('error', 'view')
              THEN 'SUB' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS subscriber_id,
         event_type AS platform, CAST(event_id % 13 AS INTEGER) AS page_views,
         CAST(1 AS INTEGER) AS sessions, CAST(floor(value) AS INTEGER) AS time_on_page_sec
  FROM events LEFT JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)
), raw_ad_impressions AS (
  SELECT 'IMP' || lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 12, '0') AS impression_id,
         l_shipdate AS impression_timestamp, p_brand AS brand,
         'CMP' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS campaign_id,
         'Supplier ' || CAST(l_suppkey AS VARCHAR) || ' ' || l_returnflag || ' Campaign' AS campaign_name,
         'Supplier ' || CAST(l_suppkey AS VARCHAR) AS advertiser, l_returnflag AS channel,
         CASE l_linenumber % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
              WHEN 3 THEN 'signup' ELSE 'view' END AS platform,
         CAST(l_quantity * 100 AS INTEGER) AS impressions, CAST(l_quantity AS INTEGER) AS clicks,
         CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,2)) AS DOUBLE) AS ad_revenue
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
), silver_content AS (
  SELECT row_number() OVER (ORDER BY content_id) AS content_key, *
  FROM (SELECT * FROM raw_content
        QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY publish_date, title, brand, section,
                                   content_type, author, word_count) = 1)
), silver_subscriptions AS (
  SELECT row_number() OVER (ORDER BY subscriber_id) AS subscriber_key, *
  FROM raw_subscriptions
), silver_engagement AS (
  SELECT event_id, event_timestamp, CAST(event_timestamp AS DATE) AS event_date, brand, content_id,
         subscriber_id, platform, page_views, sessions, time_on_page_sec
  FROM (SELECT * FROM raw_engagement
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp) = 1)
  WHERE page_views > 0
), silver_ad_impressions AS (
  SELECT impression_id, impression_timestamp, CAST(impression_timestamp AS DATE) AS impression_date, brand,
         campaign_id, campaign_name, advertiser, channel, platform, impressions, clicks, ad_revenue
  FROM (SELECT * FROM raw_ad_impressions
        QUALIFY row_number() OVER (PARTITION BY impression_id
          ORDER BY impression_timestamp, brand, campaign_id, campaign_name, advertiser, channel, platform,
                   impressions, clicks, ad_revenue) = 1)
  WHERE impressions > 0
), dim_date AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', d) + 1 AS INTEGER) AS date_key, d AS full_date,
         CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, isodow(d) >= 6 AS is_weekend
  FROM (SELECT CAST(g AS DATE) AS d
        FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) AS t(g))
), dim_brand AS (
  SELECT CAST(row_number() OVER (ORDER BY brand_name) AS INTEGER) AS brand_key, brand_name
  FROM (SELECT DISTINCT p_brand AS brand_name FROM part)
), dim_platform AS (
  SELECT CAST(k AS INTEGER) AS platform_key, p AS platform, p AS platform_name
  FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view')) AS t(k, p)
), dim_content AS (
  SELECT content_key, content_id, title, section, content_type, author, brand_key
  FROM silver_content LEFT JOIN dim_brand ON brand = brand_name
), dim_subscriber AS (
  SELECT subscriber_key, subscriber_id, date_key AS signup_date_key, plan, region, channel,
         plan AS subscriber_tier, channel AS acquisition_channel
  FROM silver_subscriptions LEFT JOIN dim_date ON signup_date = full_date
), dim_campaign AS (
  SELECT row_number() OVER (ORDER BY campaign_id) AS campaign_key, campaign_id,
         campaign_name, advertiser, channel, channel AS campaign_type
  FROM (SELECT DISTINCT campaign_id, campaign_name, advertiser, channel FROM silver_ad_impressions
        QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY campaign_name, advertiser, channel) = 1)
), fct_engagement AS (
  SELECT date_key, b.brand_key, content_key, subscriber_key, platform_key, page_views, sessions, time_on_page_sec
  FROM silver_engagement e LEFT JOIN dim_date ON event_date = full_date
  LEFT JOIN dim_brand b ON e.brand = b.brand_name
  LEFT JOIN silver_content c ON e.content_id = c.content_id
  LEFT JOIN silver_subscriptions s ON e.subscriber_id = s.subscriber_id
  LEFT JOIN dim_platform p ON e.platform = p.platform
), fct_subscription AS (
  SELECT date_key, brand_key, subscriber_key, CAST(CASE WHEN is_active THEN 1 ELSE 0 END AS INTEGER) AS active_flag,
         CAST(1 AS INTEGER) AS new_flag, CAST(CASE WHEN is_active THEN 0 ELSE 1 END AS INTEGER) AS churned_flag,
         CAST(mrr AS DECIMAL(18,2)) AS mrr
  FROM silver_subscriptions LEFT JOIN dim_date ON signup_date = full_date
  LEFT JOIN dim_brand ON brand = brand_name
), fct_ad AS (
  SELECT date_key, brand_key, campaign_key, platform_key, impressions, clicks,
         CAST(ad_revenue AS DECIMAL(18,2)) AS ad_revenue
  FROM silver_ad_impressions a LEFT JOIN dim_date ON impression_date = full_date
  LEFT JOIN dim_brand b ON a.brand = b.brand_name
  LEFT JOIN dim_campaign c ON a.campaign_id = c.campaign_id
  LEFT JOIN dim_platform p ON a.platform = p.platform
)
"""


def _sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def _star(name: str, text: str) -> None:
    ORACLE[name] = f"WITH {STAR.strip()}\n{text.strip()}"


# --- scans, sources, sinks --------------------------------------------------------------

_sql(
    "scan_project",
    """SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_quantity AS quantity
       FROM lineitem""",
)
_sql("row_count", "SELECT count(*) AS record_count FROM lineitem")
_star(
    "static_dim",
    """SELECT platform_key, platform, CAST(count(event_id) AS BIGINT) AS events
       FROM dim_platform LEFT JOIN events ON platform = event_type GROUP BY 1, 2""",
)

_CUSTOMERS = """SELECT c_custkey AS customer_id, c_name AS customer_name, r_name AS region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey"""
_ORDERS = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS order_total, o_orderstatus AS order_status FROM orders"""

_sql("ensure_table", _CUSTOMERS)
_sql(
    "seed_rows",
    f"""{_CUSTOMERS} UNION ALL
        SELECT CAST(a AS BIGINT), b, c FROM (VALUES (-1, 'Acme Corp', 'North America'),
                                                    (-2, 'Global Media Inc', 'Europe')) AS t(a, b, c)""",
)
_sql("csv_roundtrip", "SELECT * FROM orders")
_sql("table_roundtrip", "SELECT * FROM events")
_sql("overwrite_schema", "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1")
_sql(
    "create_view",
    f"""WITH c AS ({_CUSTOMERS}), o AS ({_ORDERS})
        SELECT c.region, count(o.order_id) AS total_orders, max(o.order_date) AS last_order_date
        FROM c LEFT JOIN o ON c.customer_id = o.customer_id GROUP BY 1""",
)

_BRONZE = ["raw_content", "raw_subscriptions", "raw_engagement", "raw_ad_impressions"]
_SILVER = ["silver_content", "silver_subscriptions", "silver_engagement", "silver_ad_impressions"]
_DIMS = ["dim_date", "dim_brand", "dim_content", "dim_subscriber", "dim_platform", "dim_campaign"]
_FACTS = ["fct_engagement", "fct_subscription", "fct_ad"]

_star(
    "catalog_probe",
    " UNION ALL ".join(
        f'SELECT \'{t}\' AS "table", TRUE AS present, count(*) AS rows FROM {t}'
        for t in _DIMS + _FACTS
    )
    + " UNION ALL SELECT 'dim_country', FALSE, NULL",
)
_AD_TYPES = {
    "impression_id": "string",
    "impression_timestamp": "timestamp_ntz",
    "impression_date": "date",
    "brand": "string",
    "campaign_id": "string",
    "campaign_name": "string",
    "advertiser": "string",
    "channel": "string",
    "platform": "string",
    "impressions": "int",
    "clicks": "int",
    "ad_revenue": "double",
}
_star(
    "describe_columns",
    " UNION ALL ".join(
        f"SELECT '{n}' AS col_name, '{t}' AS data_type, count({n}) AS filled FROM silver_ad_impressions"
        for n, t in _AD_TYPES.items()
    )
    + " UNION ALL SELECT 'load_timestamp', 'timestamp', count(*) FROM silver_ad_impressions",
)
_sql(
    "preview",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20",
)
_sql(
    "config_value",
    """SELECT count(*) AS churned FROM (SELECT o_custkey FROM orders GROUP BY 1
       HAVING max(CAST(o_orderdate AS DATE)) < DATE '2001-01-01')""",
)
_star(
    "layer_counts",
    " UNION ALL ".join(
        f'SELECT \'{layer}\' AS layer, \'{t}\' AS "table", count(*) AS rows FROM {t}'
        for layer, tables in (("bronze", _BRONZE), ("silver", _SILVER), ("gold", _DIMS + _FACTS))
        for t in tables
    ),
)
_sql(
    "sample_loads",
    """SELECT 'orders' AS "table", count(o_totalprice) AS rows FROM orders
       UNION ALL SELECT 'example_audience', 4 UNION ALL SELECT 'sample_events', 5""",
)
_star(
    "table_description",
    """SELECT col_name, data_type, CAST(mentioned AS BIGINT) AS mentioned, (SELECT count(*) FROM fct_ad) AS rows
       FROM (VALUES ('date_key', 'int', 1), ('impressions', 'int', 1), ('ad_revenue', 'decimal(18,2)', 1),
                    ('date_month', 'int', 2), ('Provider', 'parquet', 1)) AS t(col_name, data_type, mentioned)""",
)
_sql(
    "csv_dirty_load",
    """WITH told AS (
         SELECT CASE WHEN o_orderkey % 83 = 0 THEN 'too many fields' WHEN o_orderkey % 79 = 0 THEN 'too few fields'
                WHEN o_orderkey % 97 = 0 THEN 'o_totalprice is no double' WHEN o_orderkey % 73 = 0 THEN 'o_orderkey is missing'
                ELSE 'accepted' END AS problem,
                CASE WHEN o_orderkey % 97 = 0 OR (o_orderkey % 79 = 0 AND o_orderkey % 83 <> 0) THEN NULL ELSE o_totalprice END AS price,
                o_orderkey % 89 = 0 AS quoted
         FROM orders)
       SELECT problem, count(*) AS rows, round(sum(price), 2) AS total, count(*) FILTER (WHERE quoted) AS quoted
       FROM told GROUP BY 1""",
)
_star(
    "audit_columns",
    " UNION ALL ".join(f'SELECT \'{t}\' AS "table", count(*) AS rows FROM {t}' for t in _SILVER),
)
_sql(
    "stage_binding",
    """SELECT 'orders' AS "table", count(*) AS rows, 'dev' AS stage FROM orders
       UNION ALL SELECT 'orders', count(*), 'uat' FROM orders""",
)

# --- generated sources ------------------------------------------------------------------


def _draw(row: str, salt: int) -> str:
    start = salt * DRAW_SALT_FACTOR % DRAW_PRIME
    p = DRAW_PRIME
    x = f"((({row} % {p}) * {DRAW_ID_FACTOR} + {start}) % {p})"
    square = f"(({x} * {x}) % {p})"
    return f"(((({square} * {square}) % {p}) * {x}) % {p})"


def _int(row: str, name: str, low: int, high: int) -> str:
    return f"CAST({low} + {_draw(row, synthetic.salt(name))} % {high - low + 1} AS INTEGER)"


def _upto(row: str, name: str, table: str) -> str:
    """From 1 to the number of rows of a table."""
    rows = f"(SELECT count(*) FROM {table})"
    return f"CAST(1 + {_draw(row, synthetic.salt(name))} % {rows} AS INTEGER)"


def _choice(row: str, name: str, values: tuple[str, ...]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST({_draw(row, synthetic.salt(name))} % {len(values)} + 1 AS INTEGER)]"


def _fraction(row: str, name: str) -> str:
    return f"(CAST({_draw(row, synthetic.salt(name))} AS DOUBLE) / CAST({DRAW_PRIME} AS DOUBLE))"


def _between(row: str, name: str, low: float, high: float) -> str:
    return f"(CAST({low!r} AS DOUBLE) + {_fraction(row, name)} * CAST({high - low!r} AS DOUBLE))"


def _padded(prefix: str, number: str, width: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}' || CASE WHEN length({text}) >= {width} THEN {text} ELSE lpad({text}, {width}, '0') END"


_BRANDS = ("Alpha", "Bravo", "Cedar", "Delta", "Ember")
_BRAND_LIST = ", ".join(f"'{b}'" for b in _BRANDS)

_sql(
    "gen_content",
    f"""SELECT content_id, brand || ' ' || section || ' ' || content_type || ' #' || CAST(item AS VARCHAR) AS title,
               brand, section, content_type, publish_date, author, word_count
        FROM (SELECT {_padded("CNT", "(id + 1)", 6)} AS content_id, id % 400 + 1 AS item,
                     ([{_BRAND_LIST}])[CAST((id // 400) % 5 + 1 AS INTEGER)] AS brand,
                     {_choice("id", "section", synthetic.SECTIONS)} AS section,
                     {_choice("id", "type", synthetic.CONTENT_TYPES)} AS content_type,
                     DATE '2026-03-25' + {_int("id", "publish", 0, 60)} AS publish_date,
                     'Author' || CAST({_int("id", "author", 1, 50)} AS VARCHAR) AS author,
                     {_int("id", "words", 300, 2500)} AS word_count
              FROM (SELECT p_partkey AS id FROM part))""",
)
_sql(
    "gen_subscriptions",
    f"""SELECT subscriber_id, brand, signup_date, plan, region, channel, churn_date IS NULL AS is_active, churn_date,
               CAST(CASE plan WHEN 'basic' THEN 9.99 WHEN 'premium' THEN 14.99 ELSE 19.99 END AS DOUBLE) AS mrr
        FROM (SELECT *, CASE WHEN leaves AND signup_date + stay <= DATE '2026-06-23' THEN signup_date + stay END
                        AS churn_date
              FROM (SELECT {_padded("SUB", "(id + 1)", 7)} AS subscriber_id,
                           {_choice("id", "brand", _BRANDS)} AS brand,
                           DATE '2026-03-25' + {_int("id", "signup", 0, 89)} AS signup_date,
                           {_choice("id", "plan", synthetic.PLANS)} AS plan,
                           {_choice("id", "region", synthetic.REGIONS)} AS region,
                           {_choice("id", "channel", synthetic.CHANNELS)} AS channel,
                           {_fraction("id", "churn")} <= 0.1::DOUBLE AS leaves,
                           {_int("id", "churn_day", 7, 90)} AS stay
                    FROM (SELECT c_custkey AS id FROM customer)))""",
)


def _daily(table: str, column: str) -> str:
    return f"""SELECT day, CAST(before + k AS BIGINT) AS id
        FROM (SELECT day, sum(n) OVER (ORDER BY day) - n AS before, n
              FROM (SELECT CAST({column} AS DATE) AS day, count(*) AS n FROM {table} GROUP BY 1)) AS d,
             LATERAL (SELECT unnest(range(n)) AS k) AS r"""


def _moment(row: str) -> str:
    parts = [f"to_hours({_int(row, 'hour', 0, 23)})", f"to_minutes({_int(row, 'minute', 0, 59)})",
             f"to_seconds({_int(row, 'second', 0, 59)})"]
    return "CAST(day AS TIMESTAMP) + " + " + ".join(parts)


_sql(
    "gen_engagement",
    f"""SELECT {_padded("EVT", "id", 12)} AS event_id, {_moment("id")} AS event_timestamp,
               {_choice("id", "ev_brand", _BRANDS)} AS brand,
               {_padded("CNT", _upto("id", "content", "part"), 6)} AS content_id,
               CASE WHEN {_fraction("id", "known")} < 0.6::DOUBLE
                    THEN {_padded("SUB", _upto("id", "subscriber", "customer"), 7)} END AS subscriber_id,
               {_choice("id", "platform", synthetic.PLATFORMS)} AS platform,
               {_int("id", "views", 1, 12)} AS page_views, CAST(1 AS INTEGER) AS sessions,
               CAST({_int("id", "views", 1, 12)} * {_int("id", "seconds", 30, 300)} AS INTEGER) AS time_on_page_sec
        FROM ({_daily("events", "ts")})""",
)
_sql(
    "gen_ads",
    f"""SELECT brand, campaign_name, platform, count(*) AS rows, count(DISTINCT campaign_id) AS campaigns,
               CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
               CAST(sum(CAST(round(clicks * price, 2) AS DECIMAL(18,2))) AS DOUBLE) AS ad_revenue,
               min(strftime(moment, '%H:%M:%S')) AS first_time
        FROM (SELECT *, advertiser || ' ' || upper(channel[1]) || channel[2:] || ' Campaign' AS campaign_name,
                     CAST(floor(impressions * ctr) AS INTEGER) AS clicks
              FROM (SELECT {_moment("id")} AS moment, {_choice("id", "ad_brand", _BRANDS)} AS brand,
                           {_padded("CMP", _int("id", "campaign", 1, 50), 3)} AS campaign_id,
                           {_choice("id", "advertiser", synthetic.ADVERTISERS)} AS advertiser,
                           {_choice("id", "ad_channel", synthetic.AD_CHANNELS)} AS channel,
                           {_choice("id", "ad_platform", synthetic.PLATFORMS)} AS platform,
                           {_int("id", "impressions", 100, 5000)} AS impressions,
                           {_between("id", "ctr", 0.005, 0.03)} AS ctr,
                           {_between("id", "price", 0.25, 2.50)} AS price
                    FROM ({_daily("lineitem", "l_shipdate")})))
        GROUP BY 1, 2, 3""",
)
_sql(
    "row_id",
    f"""SELECT o_orderkey, {_padded("ORD", "o_orderkey", 12)} AS order_id,
               {_padded("O", "o_orderkey", 2)} AS short_id FROM orders""",
)

# --- projections, filters, scalar functions ---------------------------------------------

_sql(
    "typed_columns",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(trunc(value) AS INTEGER) AS value, event_type,
              CASE WHEN CAST(trunc(value) AS INTEGER) % 2 = 0 THEN CAST(user_id AS INTEGER) END AS number_text
       FROM events""",
)
_sql(
    "case_flags",
    """SELECT c_custkey,
              CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 9.99 WHEN 'BUILDING' THEN 14.99
                   WHEN 'FURNITURE' THEN 19.99 WHEN 'HOUSEHOLD' THEN 9.99 ELSE 14.99 END AS DOUBLE) AS mrr,
              CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS overdrawn_flag,
              NOT (c_acctbal < 0) AS is_active, CAST(1 AS INTEGER) AS new_flag
       FROM customer""",
)
_sql(
    "string_fns",
    f"""SELECT p_partkey, {_padded("CNT", "p_partkey", 6)} AS content_id,
               p_brand || ' ' || p_type || ' #' || CAST(p_size AS VARCHAR) AS title,
               upper(p_type[1]) || lower(p_type[2:]) AS section,
               upper(p_type[1]) || lower(p_type[2:]) || ' Campaign' AS campaign_name,
               CAST(p_partkey AS VARCHAR) AS key_text, md5(p_name || '|' || p_brand) AS fingerprint
        FROM part""",
)
_sql(
    "date_fns",
    """SELECT o_orderkey, day + 30 AS due, day - 7 AS week_before,
              CAST(date_diff('day', DATE '1995-01-01', day) AS INTEGER) AS days_in,
              CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_int, CAST(year(day) AS INTEGER) AS year,
              CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month,
              monthname(day) AS month_name, CAST(day(day) AS INTEGER) AS day_of_month, dayname(day) AS day_name,
              CAST(isodow(day) AS INTEGER) AS day_of_week, isodow(day) >= 6 AS is_weekend
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""",
)
_sql(
    "math_fns",
    """SELECT l_orderkey, l_linenumber,
              CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DOUBLE)
                AS discount_amount,
              CAST(floor(l_extendedprice / 7) AS INTEGER) AS whole,
              coalesce(l_tax / NULLIF(l_discount, 0), 0.0::DOUBLE) * 100 AS tax_to_discount_pct,
              abs(l_tax - l_discount) / NULLIF(abs(l_discount), 0) AS relative_difference
       FROM lineitem""",
)

_MEASURES = {
    "page_views": ("fct_engagement", "Page Views", "CAST(sum(page_views) AS BIGINT)"),
    "sessions": ("fct_engagement", "Sessions", "CAST(sum(sessions) AS BIGINT)"),
    "avg_time_on_page_sec": ("fct_engagement", "Avg Time on Page (sec)", "coalesce(CAST(sum(time_on_page_sec) AS DOUBLE) / NULLIF(CAST(sum(sessions) AS DOUBLE), 0), 0.0::DOUBLE) * 1"),
    "active_subscribers": ("fct_subscription", "Active Subscribers", "count(DISTINCT subscriber_key) FILTER (WHERE active_flag = 1)"),
    "new_subscribers": ("fct_subscription", "New Subscribers", "CAST(sum(new_flag) AS BIGINT)"),
    "churned_subscribers": ("fct_subscription", "Churned Subscribers", "CAST(sum(churned_flag) AS BIGINT)"),
    "churn_rate_pct": ("fct_subscription", "Churn Rate %", "coalesce(CAST(sum(churned_flag) AS DOUBLE) / NULLIF(CAST(count(DISTINCT subscriber_key) FILTER (WHERE active_flag = 1) AS DOUBLE), 0), 0.0::DOUBLE) * 100"),
    "mrr": ("fct_subscription", "MRR", "CAST(sum(mrr) AS DOUBLE)"),
    "arpu": ("fct_subscription", "ARPU", "coalesce(CAST(sum(mrr) AS DOUBLE) / NULLIF(CAST(count(DISTINCT subscriber_key) FILTER (WHERE active_flag = 1) AS DOUBLE), 0), 0.0::DOUBLE) * 1"),
    "ad_revenue": ("fct_ad", "Ad Revenue", "CAST(sum(ad_revenue) AS DOUBLE)"),
    "ad_impressions": ("fct_ad", "Ad Impressions", "CAST(sum(impressions) AS BIGINT)"),
    "ad_clicks": ("fct_ad", "Ad Clicks", "CAST(sum(clicks) AS BIGINT)"),
    "ctr_pct": ("fct_ad", "CTR %", "coalesce(CAST(sum(clicks) AS DOUBLE) / NULLIF(CAST(sum(impressions) AS DOUBLE), 0), 0.0::DOUBLE) * 100"),
    "ecpm": ("fct_ad", "eCPM", "coalesce(CAST(sum(ad_revenue) AS DOUBLE) / NULLIF(CAST(sum(impressions) AS DOUBLE), 0), 0.0::DOUBLE) * 1000"),
    "new_subscriber_growth_pct": ("fct_subscription", "New Subscriber Growth %", "coalesce(CAST(sum(new_flag) AS DOUBLE) / NULLIF(CAST(count(DISTINCT subscriber_key) FILTER (WHERE active_flag = 1) AS DOUBLE), 0), 0.0::DOUBLE) * 100"),
}


def _m(*names: str) -> str:
    return ", ".join(f"{_MEASURES[n][2]} AS {n}" for n in names)


_JOINS = {
    "dim_date": "LEFT JOIN dim_date USING (date_key)",
    "dim_brand": "LEFT JOIN dim_brand USING (brand_key)",
    "dim_content": "LEFT JOIN (SELECT content_key, content_id, title, section FROM dim_content) USING (content_key)",
    "dim_subscriber": "LEFT JOIN (SELECT subscriber_key, acquisition_channel FROM dim_subscriber) USING (subscriber_key)",
    "dim_platform": "LEFT JOIN dim_platform USING (platform_key)",
    "dim_campaign": "LEFT JOIN (SELECT campaign_key, campaign_id, campaign_name FROM dim_campaign) USING (campaign_key)",
}


def _report(name, measures, by=(), dims=(), where="", tail="") -> None:
    fact = _MEASURES[measures[0]][0]
    select = ", ".join([*by, _m(*measures)])
    joins = " ".join(_JOINS[d] for d in dims)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    where = f"WHERE {where}" if where else ""
    _star(name, f"SELECT {select} FROM {fact} {joins} {where} {group} {tail}")


def _last(fact: str) -> str:
    return f"(SELECT max(full_date) FROM {fact} JOIN dim_date USING (date_key))"


def _within(unit: str, fact: str, back: int = 0) -> str:
    last = f"CAST(date_trunc('{unit}', {_last(fact)}) AS DATE)"
    months = {"month": 1, "quarter": 3}[unit]
    start = f"CAST({last} - INTERVAL {back * months} MONTH AS DATE)"
    stop = f"CAST({last} + INTERVAL {(1 - back) * months} MONTH AS DATE)"
    return f"full_date >= {start} AND full_date < {stop}"


_star(
    "display_format",
    """SELECT brand_name, format('{:,}', n) AS new_subscribers_text,
              CASE WHEN m < 0 THEN '($' || format('{:,.0f}', -m) || ')' ELSE '$' || format('{:,.0f}', m) END AS mrr_text,
              '$' || format('{:,.2f}', u) AS arpu_text, format('{:.2f}', r) || '%' AS churn_rate_pct_text
       FROM (SELECT brand_name, """
    + f"""{_MEASURES["new_subscribers"][2]} AS n, {_MEASURES["mrr"][2]} AS m, {_MEASURES["arpu"][2]} AS u,
             {_MEASURES["churn_rate_pct"][2]} AS r
             FROM fct_subscription {_JOINS["dim_brand"]} GROUP BY 1)""",
)
_sql(
    "conditional_aggregates",
    """SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE l_linestatus = 'O') AS open_rows,
              count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS open_suppliers,
              CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS open_quantity,
              CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 AS open_pct
       FROM lineitem GROUP BY 1""",
)
_sql(
    "cross_column_filter",
    "SELECT l_returnflag, count(*) AS rows FROM lineitem WHERE l_discount > l_tax GROUP BY 1",
)
_report(
    "dimension_slice",
    ["page_views", "sessions", "avg_time_on_page_sec"],
    ["section", "is_weekend"],
    ["dim_content", "dim_date", "dim_brand"],
    f"brand_name = 'Brand#7' AND {_within('quarter', 'fct_engagement')}",
)

# --- silver and gold --------------------------------------------------------------------

for _t in _SILVER:
    _star(_t, f"SELECT * FROM {_t}")
_sql(
    "first_per_key",
    """SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) = 1""",
)
_sql(
    "latest_per_key",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey, o_totalprice) = 1""",
)
_sql("distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
_sql(
    "surrogate_key",
    """SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS order_line_key
       FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
_sql(
    "dim_date",
    """WITH per_day AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
            days AS (SELECT CAST(g AS DATE) AS d FROM generate_series(
              (SELECT CAST(min(day) AS TIMESTAMP) FROM per_day), (SELECT CAST(max(day) AS TIMESTAMP) FROM per_day),
              INTERVAL 1 DAY) AS t(g))
       SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS date_key, d AS full_date,
              CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_int, CAST(year(d) AS INTEGER) AS year,
              CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
              CAST(day(d) AS INTEGER) AS day_of_month, dayname(d) AS day_name,
              CAST(isodow(d) AS INTEGER) AS day_of_week, isodow(d) >= 6 AS is_weekend, coalesce(n, 0) AS orders
       FROM days LEFT JOIN per_day ON d = day""",
)
for _t in ("dim_brand", "dim_content", "dim_subscriber", "dim_campaign", "fct_engagement"):
    _star(_t, f"SELECT * FROM {_t}")
_star("fct_subscription", "SELECT * REPLACE (CAST(mrr AS DOUBLE) AS mrr) FROM fct_subscription")
_star("fct_ad", "SELECT * REPLACE (CAST(ad_revenue AS DOUBLE) AS ad_revenue) FROM fct_ad")

_SNAPSHOT = """snapshot AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', day) + 1 AS INTEGER) AS date_key, brand_key,
         CASE WHEN churn_date IS NOT NULL AND day = churn_date THEN 0 ELSE 1 END AS active,
         CASE WHEN day = signup_date THEN 1 ELSE 0 END AS new,
         CASE WHEN churn_date IS NOT NULL AND day = churn_date THEN 1 ELSE 0 END AS churned,
         CAST(mrr AS DECIMAL(18,2)) AS mrr
  FROM (SELECT s.*, CAST(unnest(generate_series(CAST(signup_date AS TIMESTAMP),
               CAST(coalesce(churn_date, DATE '2001-12-31') AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
        FROM silver_subscriptions s)
  LEFT JOIN dim_brand ON brand = brand_name)"""
_SNAPSHOT_SUMS = """count(*) AS subscribers, CAST(sum(active) AS BIGINT) AS active, CAST(sum(new) AS BIGINT) AS new,
  CAST(sum(churned) AS BIGINT) AS churned, CAST(sum(mrr) AS DOUBLE) AS mrr"""
_star(
    "subscription_snapshot",
    f", {_SNAPSHOT} SELECT date_key, brand_key, {_SNAPSHOT_SUMS} FROM snapshot GROUP BY 1, 2",
)
_star(
    "subscription_daily_totals",
    f", {_SNAPSHOT} SELECT date_key, {_SNAPSHOT_SUMS} FROM snapshot GROUP BY 1",
)

_star(
    "snapshot_active_on_a_day",
    f""", {_SNAPSHOT} SELECT brand_key, count(*) AS subscribers, CAST(sum(active) AS BIGINT) AS active,
       CAST(sum(mrr) AS DOUBLE) AS mrr FROM snapshot
       WHERE date_key = date_diff('day', DATE '1995-01-01', DATE '1998-03-15') + 1 GROUP BY 1""",
)
_star(
    "snapshot_mrr_by_month",
    f""", {_SNAPSHOT}, last AS (SELECT year * 100 + month AS date_month, max(date_key) AS date_key
         FROM dim_date WHERE full_date <= DATE '2001-12-31' GROUP BY 1)
       SELECT CAST(date_month AS INTEGER) AS date_month, count(*) AS subscribers, CAST(sum(mrr) AS DOUBLE) AS mrr
       FROM snapshot JOIN last USING (date_key) GROUP BY 1""",
)

# --- joins ------------------------------------------------------------------------------

_sql(
    "sales_summary",
    f"""WITH c AS ({_CUSTOMERS}), o AS ({_ORDERS})
        SELECT c.customer_id, c.customer_name, c.region, count(o.order_id) AS total_orders,
               CAST(sum(o.order_total) AS DOUBLE) AS total_revenue, max(o.order_date) AS last_order_date
        FROM c LEFT JOIN o ON c.customer_id = o.customer_id
        GROUP BY c.customer_id, c.customer_name, c.region""",
)
_star(
    "fanout_check",
    " UNION ALL ".join(
        f"""SELECT (SELECT count(*) FROM silver_ad_impressions) AS before, count(*) AS after, '{k}' AS lookup_on
            FROM silver_ad_impressions a LEFT JOIN dim_campaign c ON a.{k} = c.{k}"""
        for k in ("campaign_id", "campaign_name", "channel")
    ),
)
_NOT_FINISHED = (
    "NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')"
)
_sql(
    "orphan_rows",
    f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {_NOT_FINISHED}",
)
_sql(
    "orphan_keys",
    f"SELECT l_orderkey AS key, count(*) AS rows FROM lineitem WHERE {_NOT_FINISHED} GROUP BY 1",
)
_PAIRS = [(f, d, k) for f, dims in RELATIONSHIPS.items() for d, k in dims.items()]
_star(
    "relationship_rows",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS fact, '{d}' AS dim, count(*) AS rows, count(d.{k}) AS matched
            FROM {f} f LEFT JOIN {d} d ON f.{k} = d.{k}"""
        for f, d, k in _PAIRS
    ),
)


def _across(keys: list[str], parts: list[tuple[list[str], list[str]]]) -> str:
    """Groups of several facts, full-joined on possibly null keys."""
    frames, all_names = [], []
    for i, (names, dims) in enumerate(parts):
        joins = " ".join(_JOINS[d] for d in dims)
        fact = _MEASURES[names[0]][0]
        frames.append(f"g{i} AS (SELECT {', '.join(keys)}, {_m(*names)} FROM {fact} {joins} GROUP BY ALL)")
        all_names += names
    union = " UNION ".join(f"SELECT {', '.join(keys)} FROM g{i}" for i in range(len(parts)))
    same = [" AND ".join(f"k.{c} IS NOT DISTINCT FROM g{i}.{c}" for c in keys) for i in range(len(parts))]
    joins = " ".join(f"LEFT JOIN g{i} ON {s}" for i, s in enumerate(same))
    columns = ", ".join([f"k.{c}" for c in keys] + all_names)
    return f", {', '.join(frames)}, keyset AS ({union}) SELECT {columns} FROM keyset k {joins}"


_star(
    "drill_across",
    _across(
        ["brand_name"],
        [
            (["page_views"], ["dim_brand"]),
            (["new_subscribers", "mrr"], ["dim_brand"]),
            (["ad_revenue"], ["dim_brand"]),
        ],
    ),
)
_star(
    "drill_across_months",
    _across(
        ["year", "month", "month_name"],
        [
            (["new_subscribers"], ["dim_date"]),
            (["ad_clicks"], ["dim_date"]),
            (["page_views"], ["dim_date"]),
        ],
    ),
)

# --- measures and reports ---------------------------------------------------------------


def _scalar(name: str, measure: str) -> None:
    fact, title, expression = _MEASURES[measure]
    _star(
        name,
        f"SELECT '{title}' AS measure, coalesce(CAST({expression} AS DOUBLE), 0.0::DOUBLE) AS value FROM {fact}",
    )


for _name in _MEASURES:
    _scalar(f"measure_{_name}", _name)
for _name, _measure in {
    "n01_page_views_card": "page_views",
    "n02_active_subscribers_card": "active_subscribers",
    "n03_mrr_card": "mrr",
    "n04_churn_rate_card": "churn_rate_pct",
    "n05_ad_revenue_card": "ad_revenue",
    "n06_ecpm_card": "ecpm",
}.items():
    _scalar(_name, _measure)

_MONTHS = ["year", "month", "month_name"]
_report("n07_page_views_by_month", ["page_views"], _MONTHS, ["dim_date"])
_report(
    "n08_new_and_churned_by_month", ["new_subscribers", "churned_subscribers"], _MONTHS, ["dim_date"]
)
_report("n09_top_brands", ["page_views"], ["brand_name"], ["dim_brand"])
_report(
    "n10_brand_churn_rate",
    ["churned_subscribers", "active_subscribers", "churn_rate_pct"],
    dims=["dim_date", "dim_brand"],
    where=f"brand_name = 'Brand#7' AND {_within('month', 'fct_subscription')}",
)
_report(
    "n11_top_sections",
    ["page_views"],
    ["section"],
    ["dim_content", "dim_date"],
    _within("quarter", "fct_engagement"),
    "ORDER BY page_views DESC, section LIMIT 5",
)
_report(
    "n12_mrr_trend",
    ["mrr"],
    _MONTHS,
    ["dim_date"],
    f"full_date >= CAST(CAST(date_trunc('month', {_last('fct_subscription')}) AS DATE) - INTERVAL 5 MONTH AS DATE)",
)
_report("n13_ecpm_by_platform", ["ecpm"], ["platform_name"], ["dim_platform"])
_report(
    "n14_new_by_channel",
    ["new_subscribers"],
    ["acquisition_channel"],
    ["dim_subscriber", "dim_date"],
    "year = 1996 AND quarter = 1",
)
_report("n15_arpu_by_brand", ["arpu"], ["brand_name"], ["dim_brand"])
_report(
    "n16_churn_by_brand_and_month",
    ["churned_subscribers", "active_subscribers", "churn_rate_pct"],
    ["brand_name", *_MONTHS],
    ["dim_brand", "dim_date"],
)
_report(
    "n17_best_ecpm_brand",
    ["ecpm"],
    ["brand_name"],
    ["dim_brand", "dim_date"],
    _within("quarter", "fct_ad", 1),
    "ORDER BY ecpm DESC, brand_name LIMIT 1",
)
_report(
    "n18_brand_growth",
    ["new_subscribers", "active_subscribers", "new_subscriber_growth_pct"],
    dims=["dim_brand"],
    where="brand_name = 'Brand#7'",
)
_report("n19_page_views_by_brand", ["page_views"], ["brand_name"], ["dim_brand"])
_star(
    "n20_monthly_active_users",
    f"""SELECT year, month, month_name, count(DISTINCT subscriber_key) AS active_users
        FROM fct_engagement {_JOINS["dim_date"]} GROUP BY 1, 2, 3""",
)
_report("n20_churn_by_brand", ["churn_rate_pct"], ["brand_name"], ["dim_brand"])
_report("n20_mrr_by_brand", ["mrr"], ["brand_name"], ["dim_brand"])
_report(
    "n20_top_content",
    ["page_views"],
    ["content_id", "title"],
    ["dim_content"],
    tail="ORDER BY page_views DESC, content_id, title LIMIT 10",
)
_report(
    "n20_ad_revenue_by_campaign", ["ad_revenue"], ["campaign_id", "campaign_name"], ["dim_campaign"]
)
# The same questions, answered from stored roll-ups.
for _name in (
    "n02_active_subscribers_card", "n04_churn_rate_card", "n07_page_views_by_month", "n08_new_and_churned_by_month",
    "n09_top_brands", "n10_brand_churn_rate", "n11_top_sections", "n12_mrr_trend", "n13_ecpm_by_platform",
    "n15_arpu_by_brand", "n16_churn_by_brand_and_month", "n17_best_ecpm_brand", "n18_brand_growth",
    "n20_monthly_active_users", "n20_top_content", "n20_ad_revenue_by_campaign", "drill_across_months",
):
    ORACLE[f"stored_{_name}"] = ORACLE[_name]

_BY_MONTH = """dated AS (
  SELECT CAST(year * 100 + month AS INTEGER) AS date_month, f.* FROM fct_engagement f LEFT JOIN dim_date USING (date_key))"""
_LEVELS = (
    "date_month, brand_key, content_key, platform_key", "date_month, brand_key, platform_key", "date_month, content_key",
    "date_month, brand_key", "date_month", "brand_key", "",
)
_star(
    "rollup_levels",
    f", {_BY_MONTH} "
    + " UNION ALL ".join(
        f"""SELECT CAST({n} AS INTEGER) AS level, count(*) AS groups, CAST(sum(r) AS BIGINT) AS rows,
            CAST(sum(p) AS BIGINT) AS page_views
            FROM (SELECT count(*) AS r, sum(page_views) AS p FROM dated {f"GROUP BY {k}" if k else ""})"""
        for n, k in enumerate(_LEVELS)
    ),
)
_star(
    "distinct_users_cube",
    f""", {_BY_MONTH} SELECT date_month, brand_key, platform_key,
       CAST(grouping(date_month, brand_key, platform_key) AS BIGINT) AS level, count(DISTINCT subscriber_key) AS active_users
       FROM dated GROUP BY CUBE (date_month, brand_key, platform_key)""",
)
_sql(
    "n21_top_event_types",
    "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
_sql("event_type_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
_report(
    "top_sections",
    ["page_views"],
    ["section"],
    ["dim_content"],
    tail="ORDER BY page_views DESC, section LIMIT 3",
)
_report("brands_by_arpu", ["arpu"], ["brand_name"], ["dim_brand"])
_star(
    "latest_months",
    f"""SELECT month_name, CAST(sum(churned_flag) AS BIGINT) AS churned, count(*) AS rows, max(date_key) AS last_key
        FROM fct_subscription {_JOINS["dim_date"]} GROUP BY 1""",
)
_sql(
    "first_row",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
)

# --- quality ----------------------------------------------------------------------------


def _check(check: str, target: str, violations: str, source: str) -> str:
    return f"""SELECT '{check}' AS "check", '{target}' AS target, CAST(v AS BIGINT) AS violations, v = 0 AS passed
      FROM (SELECT coalesce({violations}, 0) AS v FROM {source})"""


def _empty(t: str) -> str:
    return _check("not_empty", t, "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", t)


def _null(t: str, c: str, source: str = "") -> str:
    return _check("no_nulls", f"{t}.{c}", "count(*)", f"{source or t} WHERE {c} IS NULL")


def _negative(t: str, c: str) -> str:
    return _check("non_negative", f"{t}.{c}", "count(*)", f"{t} WHERE {c} < 0 OR isnan(CAST({c} AS DOUBLE))")


def _unique(t: str, *columns: str, source: str = "") -> str:
    cols = ", ".join(columns)
    inner = f"(SELECT {cols} FROM {source or t} GROUP BY {cols} HAVING count(*) > 1)"
    return _check("unique", f"{t}.{'+'.join(columns)}", "count(*)", inner)


def _fk(t: str, fk: str, d: str, pk: str, source: str = "", dim: str = "") -> str:
    missing = f"NOT EXISTS (SELECT 1 FROM {dim or d} d WHERE d.{pk} = f.{fk})"
    where = f"{source or t} f WHERE f.{fk} IS NOT NULL AND {missing}"
    return _check("fk_exists", f"{t}.{fk}->{d}.{pk}", "count(*)", where)


def _gaps(t: str, c: str, source: str = "") -> str:
    violations = f"date_diff('day', min({c}), max({c})) + 1 + count(*) - 2 * count(DISTINCT {c})"
    return _check("no_gaps", f"{t}.{c}", violations, source or t)


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


_KEYS = {t: t.removeprefix("dim_") + "_key" for t in _DIMS}
_MEASURE_COLUMNS = {
    "fct_engagement": ("page_views", "sessions"),
    "fct_subscription": ("mrr",),
    "fct_ad": ("impressions", "clicks", "ad_revenue"),
}
_CLICKS = _check(
    "expect", "fct_ad.clicks<=impressions", "count(*)", "fct_ad WHERE clicks > impressions"
)
_LINKS = [_fk(f, k, d, k) for f, d, k in _PAIRS]

_star("dq_not_empty", _union(_empty(t) for t in _DIMS + _FACTS))
_star("dq_null_pk", _union(_null(t, k) for t, k in _KEYS.items()))
_star(
    "dq_unique_pk",
    _union([*(_unique(t, k) for t, k in _KEYS.items()), _unique("lineitem", "l_orderkey", "l_linenumber")]),
)
_star("dq_null_fk", _union(_null(f, k) for f, _, k in _PAIRS))
_star(
    "dq_referential",
    _union(
        [
            *_LINKS,
            _fk("orders", "o_custkey", "customer", "c_custkey"),
            _fk(
                "lineitem",
                "l_orderkey",
                "finished",
                "o_orderkey",
                dim="(SELECT * FROM orders WHERE o_orderstatus = 'F')",
            ),
        ]
    ),
)
_star(
    "dq_date_continuity",
    _union(
        [
            _gaps("dim_date", "full_date"),
            _gaps(
                "order_days",
                "day",
                "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
            ),
        ]
    ),
)
_star(
    "dq_non_negative",
    _union(
        [_negative(f, c) for f, cols in _MEASURE_COLUMNS.items() for c in cols]
        + [_negative("orders", "o_totalprice"), _negative("customer", "c_acctbal")]
    ),
)
_star(
    "dq_row_rule",
    _union(
        [
            _CLICKS,
            _check(
                "expect", "lineitem.discount<=tax", "count(*)", "lineitem WHERE l_discount > l_tax"
            ),
        ]
    ),
)
_SOURCES = {
    "fct_engagement": "silver_engagement",
    "fct_subscription": "silver_subscriptions",
    "fct_ad": "silver_ad_impressions",
}
_star(
    "dq_same_count",
    _union(
        _check(
            "same_count",
            f"{s}->{f}",
            f"abs(count(*) - (SELECT count(*) FROM {s}))",
            f,
        )
        for f, s in _SOURCES.items()
    ),
)
_sql(
    "dq_has_columns",
    f"""SELECT 'has_columns' AS "check", 'events' AS target, CAST(0 AS BIGINT) AS violations, TRUE AS passed
        UNION ALL SELECT 'has_columns', 'faulty', CAST(1 AS BIGINT), FALSE
        UNION ALL {_empty("events")}
        UNION ALL {_null("events", "event_id")}
        UNION ALL {_null("events", "ts")}
        UNION ALL {_empty("events").replace("'events'", "'faulty'")}
        UNION ALL {_check("no_nulls", "faulty.user_id", "count(*)", "events WHERE event_type = 'error'")}""",
)
_sql(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
_sql(
    "date_span",
    """SELECT min(d) AS first_day, max(d) AS last_day, CAST(date_diff('day', min(d), max(d)) + 1 AS INTEGER) AS days,
              count(DISTINCT d) AS days_with_orders
       FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
_star(
    "dq_critical_nulls",
    _union(_null("raw_engagement", c) for c in ("event_id", "event_timestamp", "subscriber_id")),
)
_star(
    "dq_contract",
    _union(
        [_check("contract", t, "0", "(SELECT 1)") for t in _DIMS + _FACTS]
        + [_empty(t) for t in _DIMS + _FACTS]
    ),
)
ORACLE["dq_warehouse"] = f"WITH customers AS ({_CUSTOMERS}), placed AS ({_ORDERS})\n" + _union(
    [
        _check("not_empty", "customer", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "customers"),
        _null("customer", "customer_id", "customers"),
        _check("not_empty", "order", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "placed"),
        _null("order", "order_id", "placed"),
        _check("non_negative", "order.order_total", "count(*)", "placed WHERE order_total < 0"),
        _unique("customer", "customer_id", source="customers"),
        _unique("order", "order_id", source="placed"),
        _fk("order", "customer_id", "customer", "customer_id", source="placed", dim="customers"),
    ]
)

ORACLE["warehouse_assertions"] = ORACLE["dq_warehouse"] + _union(
    ["", *(_check("exists", f"sales.{t}", "0", "(SELECT 1)") for t in ("customer", "order"))]
)

_RECONCILED = [
    "page_views", "sessions", "mrr", "active_subscribers", "new_subscribers",
    "churned_subscribers", "ad_revenue", "ad_impressions", "ad_clicks",
]


def _reconciled(raw_ads: bool) -> str:
    parts = []
    for n in _RECONCILED:
        fact, title, expression = _MEASURES[n]
        other = fact
        if raw_ads and fact == "fct_ad":
            other = "(SELECT * REPLACE (CAST(ad_revenue AS DECIMAL(18,2)) AS ad_revenue) FROM raw_ad_impressions)"
        parts.append(
            f"""SELECT '{title}' AS measure, (SELECT CAST({expression} AS DOUBLE) FROM {fact}) AS measured,
                       (SELECT CAST({expression} AS DOUBLE) FROM {other}) AS expected"""
        )
    return f"""SELECT measure, measured, expected,
                 CASE WHEN expected = 0 THEN measured = 0
                      ELSE abs(measured - expected) / abs(expected) <= 0.01 END AS passed
               FROM ({_union(parts)})"""


_star("reconcile", _reconciled(raw_ads=False))
_star("reconcile_drift", _reconciled(raw_ads=True))

_SUITE = [_empty(t) for t in _DIMS + _FACTS]
_SUITE += [_null(t, k) for t, k in _KEYS.items()]
_SUITE += [_gaps("dim_date", "full_date"), _CLICKS]
_SUITE += [
    _null(f, k) for f, _, k in _PAIRS if (f, k) != ("fct_engagement", "subscriber_key")
]
_SUITE += [_negative(f, c) for f, cols in _MEASURE_COLUMNS.items() for c in cols]
_SUITE += [_unique(t, k) for t, k in _KEYS.items()]
_SUITE += _LINKS
_star("dq_suite", _union(_SUITE))

_IDS = {"content": "content_id", "subscriptions": "subscriber_id", "engagement": "event_id",
        "ad_impressions": "impression_id"}
_LAYER_CHECKS = [_empty(t) for t in _BRONZE + _SILVER]
_LAYER_CHECKS += [_null(f"raw_{t}", c) for t, c in _IDS.items()]
_LAYER_CHECKS += [_unique(f"silver_{t}", c) for t, c in _IDS.items()]
_LAYER_CHECKS += [
    _null("silver_subscriptions", "signup_date"),
    _check(
        "expect",
        "silver_subscriptions.churn_after_signup",
        "count(*)",
        "silver_subscriptions WHERE churn_date < signup_date",
    ),
]
_star(
    "dq_summary",
    f"""SELECT count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed, bool_and(passed) AS passed
        FROM ({_union(_LAYER_CHECKS)})""",
)

ORACLE["dq_suite_observed"] = ORACLE["dq_suite"]
_sql(
    "dq_observed_faults",
    """WITH counted AS (
         SELECT count(*) AS rows, count(*) FILTER (WHERE l_shipdate IS NULL) AS nulls,
                count(*) FILTER (WHERE l_quantity < 0) AS negative,
                count(*) FILTER (WHERE NOT (l_discount <= l_tax)) AS broken
         FROM lineitem)
       SELECT "check", target, violations, violations = 0 AS passed, rows FROM (
         SELECT 'not_empty' AS "check", 'lineitem' AS target, CAST(CASE WHEN rows = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations, rows
         FROM counted
         UNION ALL SELECT 'no_nulls', 'lineitem.l_shipdate', nulls, rows FROM counted
         UNION ALL SELECT 'non_negative', 'lineitem.l_quantity', negative, rows FROM counted
         UNION ALL SELECT 'expect', 'lineitem.discount<=tax', broken, rows FROM counted)""",
)

_star(
    "stable_keys",
    """, first AS (
         SELECT subscriber_id, row_number() OVER (ORDER BY subscriber_id) AS first_key
         FROM silver_subscriptions WHERE signup_date < DATE '1996-01-01')
       SELECT subscriber_id, first_key, CASE WHEN first_key IS NOT NULL THEN first_key ELSE (SELECT count(*) FROM first)
         + row_number() OVER (PARTITION BY first_key IS NULL ORDER BY subscriber_id) END AS subscriber_key
       FROM silver_subscriptions LEFT JOIN first USING (subscriber_id)""",
)
_star(
    "stable_campaign_keys",
    """, loads AS (
         SELECT campaign_id, min(CASE WHEN year(impression_date) <= 1995 AND impressions >= 5000 THEN 1
                WHEN year(impression_date) <= 1998 AND impressions >= 2900 THEN 2
                WHEN impressions >= 100 THEN 3 END) AS batch
         FROM silver_ad_impressions GROUP BY 1)
       SELECT campaign_id, row_number() OVER (ORDER BY batch, campaign_id) AS campaign_key, CAST(batch AS INTEGER) AS batch
       FROM loads WHERE batch IS NOT NULL""",
)

_star(
    "late_day_refresh",
    """SELECT CAST(year * 100 + month AS INTEGER) AS date_month, count(*) AS rows, CAST(sum(ad_revenue) AS DOUBLE) AS ad_revenue,
              year = 1998 AND month = 3 AS rewritten
       FROM fct_ad JOIN dim_date USING (date_key) GROUP BY year, month""",
)
_sql(
    "published_versions",
    """SELECT step, CASE WHEN step = 'second' THEN (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')
              ELSE (SELECT count(*) FROM orders) END AS rows
       FROM (VALUES ('first'), ('broken'), ('second'), ('back')) AS t(step)""",
)
ORACLE["restarted_run"] = (
    "SELECT *, CAST(2 AS BIGINT) AS steps_before, CAST(1 AS BIGINT) AS steps_after FROM (" + ORACLE["layer_counts"] + ")"
)


def _doubles(*names: str) -> str:
    return ", ".join(f"CAST({_MEASURES[n][2]} AS DOUBLE) AS {n}" for n in names)


for _name, _column, _dim, _names in (
    ("sql_engagement_by_platform", "platform_name", "dim_platform", ("page_views", "sessions", "avg_time_on_page_sec")),
    ("sql_subscription_by_brand", "brand_name", "dim_brand", ("active_subscribers", "new_subscribers", "churned_subscribers",
     "churn_rate_pct", "mrr", "arpu", "new_subscriber_growth_pct")),
    ("sql_ad_by_campaign", "campaign_id", "dim_campaign", ("ad_revenue", "ad_impressions", "ad_clicks", "ctr_pct", "ecpm")),
):
    _star(_name, f"SELECT {_column}, {_doubles(*_names)} FROM {_MEASURES[_names[0]][0]} {_JOINS[_dim]} GROUP BY 1")
_star(
    "sql_ratio_of_a_query",
    """SELECT plan, CAST(sum(f.mrr) AS DOUBLE) / count(DISTINCT subscriber_key) AS arpu
       FROM fct_subscription f JOIN dim_subscriber USING (subscriber_key) GROUP BY 1""",
)
_star(
    "sql_measure_values",
    " UNION ALL ".join(
        f"SELECT '{n}' AS measure, coalesce(CAST({expression} AS DOUBLE), 0.0::DOUBLE) AS value FROM {fact}"
        for n, (fact, _, expression) in _MEASURES.items()
    ),
)
