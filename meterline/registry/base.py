"""Shared pieces of the query registry and of its SQL cross-checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.columns import plain, rounded
from meterline.registry.star import CLOUDS, PRICE_YEARS, SKU_SUFFIXES, VALUE_FACTORS, Star

AS_OF = "DATE '2001-06-30'"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Star], DataFrame]
    sql: str | None = None
    digits: int = 4

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.run(Star.of(spark, sf_dir)), self.digits)


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Plain types and doubles rounded by their decimal value (see ``rn``), as sums of doubles differ in the last bits between engines."""
    df = plain(df)
    return df.select(*[
        rounded(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- small text helpers for the SQL side --------------------------------------

def num(columns: str, digits: int = 4) -> str:
    return ", ".join(f"{rn(c, digits)} AS {c.split('.')[-1]}" for c in columns.split())


def rd(expression: str, digits: int = 2) -> str:
    """Rounding of a double through a decimal, so that ties go up as in Spark."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def r(expression: str, digits: int = 2) -> str:
    """Decimal rounding (half up), shown as a double."""
    return f"CAST(ROUND({expression}, {digits}) AS DOUBLE)"


def rn(expression: str, digits: int = 4) -> str:
    """The final rounding of ``tidy``."""
    return rd(f"CAST({expression} AS DOUBLE)", digits)


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def ago(days: int) -> str:
    return f"({AS_OF} - {days})"


def last(days: int, column: str = "usage_date") -> str:
    return f"{column} BETWEEN {ago(days)} AND {AS_OF}"


def days(a: str, b: str) -> str:
    return f"date_diff('day', {a}, {b})"


def month(column: str) -> str:
    return f"CAST(date_trunc('month', {column}) AS DATE)"


def half_even(x: str) -> str:
    """Two-digit rounding with ties to even, on decimals."""
    return f"(CASE WHEN abs({x} * 100 - trunc({x} * 100)) = 0.5 THEN (trunc({x} * 100) + trunc({x} * 100) % 2) / 100 ELSE ROUND({x}, 2) END)"


def grouped(x: str, digits: int = 0) -> str:
    return f"format('{{:,.{digits}f}}', CAST({x} AS DOUBLE))"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


# The published tiers, written out so that the SQL does not depend on the code it checks.
TIER_VALUES = """
  ('TIER_50K_1Y', 'Entry - 1 Year', 50000, 99999, 1, 0.05),
  ('TIER_50K_2Y', 'Entry - 2 Year', 50000, 99999, 2, 0.08),
  ('TIER_50K_3Y', 'Entry - 3 Year', 50000, 99999, 3, 0.1),
  ('TIER_50K_4Y', 'Entry - 4 Year', 50000, 99999, 4, 0.1),
  ('TIER_50K_5Y', 'Entry - 5 Year', 50000, 99999, 5, 0.1),
  ('TIER_100K_1Y', 'Standard - 1 Year', 100000, 249999, 1, 0.1),
  ('TIER_100K_2Y', 'Standard - 2 Year', 100000, 249999, 2, 0.15),
  ('TIER_100K_3Y', 'Standard - 3 Year', 100000, 249999, 3, 0.18),
  ('TIER_100K_4Y', 'Standard - 4 Year', 100000, 249999, 4, 0.18),
  ('TIER_100K_5Y', 'Standard - 5 Year', 100000, 249999, 5, 0.18),
  ('TIER_250K_1Y', 'Growth - 1 Year', 250000, 499999, 1, 0.15),
  ('TIER_250K_2Y', 'Growth - 2 Year', 250000, 499999, 2, 0.2),
  ('TIER_250K_3Y', 'Growth - 3 Year', 250000, 499999, 3, 0.25),
  ('TIER_250K_4Y', 'Growth - 4 Year', 250000, 499999, 4, 0.25),
  ('TIER_250K_5Y', 'Growth - 5 Year', 250000, 499999, 5, 0.25),
  ('TIER_500K_1Y', 'Scale - 1 Year', 500000, 999999, 1, 0.2),
  ('TIER_500K_2Y', 'Scale - 2 Year', 500000, 999999, 2, 0.25),
  ('TIER_500K_3Y', 'Scale - 3 Year', 500000, 999999, 3, 0.3),
  ('TIER_500K_4Y', 'Scale - 4 Year', 500000, 999999, 4, 0.3),
  ('TIER_500K_5Y', 'Scale - 5 Year', 500000, 999999, 5, 0.3),
  ('TIER_1M_1Y', 'Enterprise - 1 Year', 1000000, 4999999, 1, 0.25),
  ('TIER_1M_2Y', 'Enterprise - 2 Year', 1000000, 4999999, 2, 0.3),
  ('TIER_1M_3Y', 'Enterprise - 3 Year', 1000000, 4999999, 3, 0.35),
  ('TIER_1M_4Y', 'Enterprise - 4 Year', 1000000, 4999999, 4, 0.35),
  ('TIER_1M_5Y', 'Enterprise - 5 Year', 1000000, 4999999, 5, 0.35),
  ('TIER_5M_1Y', 'Strategic - 1 Year', 5000000, NULL, 1, 0.3),
  ('TIER_5M_2Y', 'Strategic - 2 Year', 5000000, NULL, 2, 0.35),
  ('TIER_5M_3Y', 'Strategic - 3 Year', 5000000, NULL, 3, 0.4),
  ('TIER_5M_4Y', 'Strategic - 4 Year', 5000000, NULL, 4, 0.4),
  ('TIER_5M_5Y', 'Strategic - 5 Year', 5000000, NULL, 5, 0.4)"""

_SKU = f"p_type || '_' || {_list(SKU_SUFFIXES)}[p_size % 8 + 1]"
_UNIT = "CASE WHEN p_size % 8 = 7 THEN 'GB' ELSE 'DBU' END"
_PRICE = "(2 + 1.5 * k + 0.25 * (y - 1995))"


def _enriched(lookback: int | None) -> str:
    return f"""
SELECT u.usage_date, u.account_id, a.customer_name, a.business_unit_l0, a.business_unit_l1, a.business_unit_l2, a.business_unit_l3,
  a.account_executive, a.solutions_architect, u.workspace_id, u.cloud AS cloud_provider, u.sku_name, u.usage_unit, u.usage_quantity,
  p.effective_price AS price_per_unit, u.usage_quantity * p.default_price AS list_cost, u.usage_quantity * p.effective_price AS actual_cost,
  CASE WHEN contains(u.sku_name, 'ALL_PURPOSE') THEN 'All Purpose Compute' WHEN contains(u.sku_name, 'JOBS') THEN 'Jobs Compute'
    WHEN regexp_matches(u.sku_name, 'DLT|DELTA_LIVE_TABLES') THEN 'Delta Live Tables' WHEN contains(u.sku_name, 'SQL') THEN 'SQL Warehouse'
    WHEN regexp_matches(u.sku_name, 'INFERENCE|MODEL_SERVING') THEN 'Model Serving' WHEN contains(u.sku_name, 'VECTOR_SEARCH') THEN 'Vector Search'
    WHEN contains(u.sku_name, 'SERVERLESS') THEN 'Serverless' ELSE 'Other' END AS product_category,
  u.job_id, u.job_name, u.job_run_id, u.warehouse_id, u.cluster_id, u.run_as, u.priority
FROM usage u
LEFT JOIN prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.usage_unit = u.usage_unit
  AND u.usage_end_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)
LEFT JOIN accounts a ON a.account_id = u.account_id
WHERE u.record_type = 'ORIGINAL' AND {'u.usage_date <= ' + AS_OF if lookback is None else last(lookback, 'u.usage_date')}"""


# name -> (tables it builds on, text)
TABLES: dict[str, tuple[str, str]] = {
    "usage": ("", f"""
SELECT c_mktsegment AS account_id, CASE WHEN l_suppkey % 5 = 1 AND l_shipdate >= DATE '2001-06-25' THEN 'week_' WHEN l_suppkey % 5 = 2 AND l_shipdate >= DATE '2001-06-05' THEN 'month_' ELSE '' END || l_suppkey AS workspace_id, {_SKU} AS sku_name,
  {_list(CLOUDS)}[l_suppkey % 3 + 1] AS cloud, l_shipdate AS usage_end_time, CAST(l_shipdate AS DATE) AS usage_date,
  o_orderpriority AS priority, {_UNIT} AS usage_unit,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,6)) AS usage_quantity,
  CASE WHEN p_size % 8 < 2 THEN 'cluster_' || (l_partkey % 30) END AS cluster_id,
  CASE WHEN p_size % 8 = 1 THEN 'job_' || (l_partkey % 50) END AS job_id,
  CASE WHEN p_size % 8 = 3 THEN 'wh_' || (l_partkey % 20) END AS warehouse_id,
  CASE WHEN p_size % 8 = 1 THEN l_orderkey END AS job_run_id,
  CASE WHEN p_size % 8 = 1 AND l_partkey % 50 >= 5 THEN 'nightly_' || (l_partkey % 50) END AS job_name,
  'user_' || (o_custkey % 40) AS run_as,
  CASE WHEN l_returnflag = 'R' THEN 'RETRACTION' ELSE 'ORIGINAL' END AS record_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""),
    "prices": ("", f"""
SELECT sku_name, cloud, usage_unit, make_date(CAST(y AS INT), 7, 1)::TIMESTAMP AS price_start_time,
  CASE WHEN y < {PRICE_YEARS[-1]} THEN make_date(CAST(y AS INT) + 1, 7, 1)::TIMESTAMP END AS price_end_time,
  CAST({_PRICE} AS DECIMAL(20,10)) AS default_price, CAST({_PRICE} * 0.9 AS DECIMAL(20,10)) AS effective_price
FROM (SELECT DISTINCT {_SKU} AS sku_name, {_UNIT} AS usage_unit, p_size % 8 AS k FROM part)
CROSS JOIN (SELECT unnest({_list(CLOUDS)}) AS cloud)
CROSS JOIN (SELECT unnest(range({PRICE_YEARS[0]}, {PRICE_YEARS[-1] + 1})) AS y)"""),
    "accounts": ("", f"""
SELECT account_id, account_id || ' Corp' AS customer_name, ['AMER', 'EMEA', 'APAC'][n % 3 + 1] AS business_unit_l0,
  'area_' || n AS business_unit_l1, CASE WHEN n % 2 = 1 THEN 'central' END AS business_unit_l2, substr(account_id, 1, 3) AS business_unit_l3,
  CASE WHEN account_id <> 'PROSPECT' THEN 'ae_' || substr(account_id, 1, 1) END AS account_executive,
  CASE WHEN n <> 10 THEN 'sa_' || substr(account_id, 2, 1) END AS solutions_architect,
  CAST(NULL AS VARCHAR) AS delivery_solutions_architect, 'region_' || (n % 2) AS region, account_id AS industry,
  {AS_OF}::TIMESTAMP - INTERVAL 400 DAY AS created_at, ({AS_OF} - CAST((n - 7) * 40 AS INT))::TIMESTAMP AS updated_at
FROM (SELECT account_id, length(account_id) AS n FROM (SELECT DISTINCT c_mktsegment AS account_id FROM customer UNION ALL SELECT 'PROSPECT'))"""),
    "dashboard": ("usage prices accounts", _enriched(365)),
    "long_history": ("usage prices accounts", _enriched(None)),
    "contracts": ("long_history", f"""
SELECT 'C' || lpad(CAST(i AS VARCHAR), 3, '0') AS contract_id, account_id, cloud_provider, s AS start_date, e AS end_date,
  CAST(ROUND(spent / ({days('s', AS_OF)} / CAST({days('s', 'e')} AS DOUBLE)) * f / 100) * 100 AS DECIMAL(18,2)) AS total_value,
  'USD' AS currency, 'SPEND' AS commitment_type, 'ACTIVE' AS status, 'sized x' || CAST(f AS VARCHAR) AS notes
FROM (SELECT *, DATE '2000-01-01' AS s, CASE WHEN i % 3 < 2 THEN DATE '2001-12-31' ELSE DATE '2002-12-31' END AS e,
        CAST({_list(VALUE_FACTORS)}[i % 5 + 1] AS DOUBLE) AS f
      FROM (SELECT account_id, cloud_provider, CAST(SUM(actual_cost) AS DOUBLE) AS spent,
              ROW_NUMBER() OVER (ORDER BY account_id, cloud_provider) AS i
            FROM long_history WHERE usage_date BETWEEN DATE '2000-01-01' AND {AS_OF} GROUP BY account_id, cloud_provider))
UNION ALL SELECT * FROM (VALUES
  ('C901', 'BUILDING', 'AWS', DATE '1999-01-01', DATE '1999-12-31', CAST(50000 AS DECIMAL(18,2)), 'USD', 'SPEND', 'EXPIRED', 'edge row'),
  ('C902', 'MACHINERY', 'GCP', DATE '2001-09-01', DATE '2003-08-31', 250000, 'USD', 'SPEND', 'PENDING', 'edge row'),
  ('C903', 'DORMANT', 'AWS', DATE '2001-01-01', DATE '2001-12-31', 60000, 'USD', 'SPEND', 'ACTIVE', 'edge row'),
  ('C904', 'BUILDING', 'AWS', DATE '2000-07-01', DATE '2001-05-31', 100000, 'USD', 'SPEND', 'ACTIVE', 'edge row'))"""),
    "tiers": ("", f"""
SELECT tier_id, tier_name, CAST(lo AS DECIMAL(18,2)) AS min_commitment, CAST(hi AS DECIMAL(18,2)) AS max_commitment, years AS duration_years,
  CAST(rate AS DECIMAL(5,4)) AS discount_rate FROM (VALUES {TIER_VALUES}) t(tier_id, tier_name, lo, hi, years, rate)"""),
    "burndown": ("contracts long_history", f"""
SELECT contract_id, cloud_provider, start_date, end_date, commitment, currency, commitment_type, notes, usage_date, daily_cost,
  SUM(daily_cost) OVER w AS cumulative_cost, commitment - SUM(daily_cost) OVER w AS remaining_budget,
  {days('start_date', 'usage_date')} * CAST(commitment AS DOUBLE) / GREATEST({days('start_date', 'end_date')}, 1) AS projected_linear_burn,
  {days('start_date', 'usage_date')} AS days_elapsed, {days('start_date', 'end_date')} AS total_contract_days,
  CAST(ROUND(CAST({days('start_date', 'usage_date')} * CAST(100.0 AS DOUBLE) / GREATEST({days('start_date', 'end_date')}, 1) AS DECIMAL(30,10)), 2) AS DOUBLE) AS time_pct_complete,
  CAST(ROUND(CAST(CAST(SUM(daily_cost) OVER w AS DOUBLE) / CAST(commitment AS DOUBLE) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS budget_pct_consumed
FROM (SELECT c.contract_id, c.cloud_provider, c.start_date, c.end_date, c.total_value AS commitment, c.currency, c.commitment_type, c.notes,
        d.usage_date, SUM(d.actual_cost) AS daily_cost
      FROM contracts c JOIN long_history d ON d.account_id = c.account_id AND d.cloud_provider = c.cloud_provider
        AND d.usage_date BETWEEN c.start_date AND c.end_date
      WHERE c.status = 'ACTIVE' GROUP BY ALL)
WINDOW w AS (PARTITION BY contract_id ORDER BY usage_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "summary": ("burndown", f"""
SELECT contract_id, cloud_provider, start_date, end_date, commitment, spent AS total_consumed, GREATEST(commitment - spent, 0) AS budget_remaining,
  CAST(ROUND(CAST(CAST(spent AS DOUBLE) / CAST(commitment AS DOUBLE) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS consumed_pct, d AS days_into_contract,
  {days(AS_OF, 'end_date')} AS days_remaining,
  CASE WHEN pct > share * 1.2 THEN 'OVER PACE' WHEN pct > share * 1.1 THEN 'ABOVE PACE' WHEN pct < share * 0.8 THEN 'UNDER PACE' ELSE 'ON PACE' END AS pace_status,
  LEAST(CASE WHEN spent > 0 AND d > 0 THEN start_date + CAST(LEAST(trunc(CAST(commitment AS DOUBLE) * d / CAST(spent AS DOUBLE)), 200000) AS INT)
    ELSE end_date END, DATE '2032-12-31') AS projected_end_date, last_usage_date
FROM (SELECT contract_id, cloud_provider, start_date, end_date, commitment, MAX(usage_date) AS last_usage_date, MAX(cumulative_cost) AS spent,
        MAX(days_elapsed) AS d, MAX(budget_pct_consumed) AS pct,
        MAX(days_elapsed) * CAST(100.0 AS DOUBLE) / NULLIF(MAX(total_contract_days), 0) AS share
      FROM burndown GROUP BY ALL)"""),
    "features": ("contracts long_history", f"""
SELECT s.contract_id, s.account_id, s.cloud_provider, s.contract_start, s.contract_end, s.contract_value, s.ds, COALESCE(d.cost, 0) AS y,
  dayofweek(s.ds) + 1 AS day_of_week, month(s.ds) AS month, quarter(s.ds) AS quarter, SUM(COALESCE(d.cost, 0)) OVER w AS cumulative_cost,
  {days('s.contract_start', 's.ds')} AS days_elapsed, s.contract_value - SUM(COALESCE(d.cost, 0)) OVER w AS remaining_budget,
  CASE WHEN d.cost IS NULL THEN 0 ELSE 1 END AS has_actual_data
FROM (SELECT contract_id, account_id, cloud_provider, contract_start, contract_end, contract_value,
        CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM (SELECT contract_id, account_id, cloud_provider, contract_start, contract_end, contract_value, MIN(usage_date) AS lo, MAX(usage_date) AS hi FROM contract_days GROUP BY ALL)) s
LEFT JOIN (SELECT contract_id, usage_date, daily_cost AS cost FROM contract_days) d ON d.contract_id = s.contract_id AND d.usage_date = s.ds
WINDOW w AS (PARTITION BY s.contract_id ORDER BY s.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "contract_days": ("contracts long_history", f"""
SELECT c.contract_id, c.account_id, c.cloud_provider, c.start_date AS contract_start, c.end_date AS contract_end, c.total_value AS contract_value,
  d.usage_date, SUM(d.actual_cost) AS daily_cost, COUNT(*) AS record_count
FROM contracts c JOIN long_history d ON d.account_id = c.account_id AND d.cloud_provider = c.cloud_provider
  AND d.usage_date BETWEEN c.start_date AND {AS_OF}
WHERE c.status = 'ACTIVE' GROUP BY ALL"""),
    "spent": ("burndown", """
SELECT contract_id, end_date, CAST(commitment AS DECIMAL(24,10)) AS value, CAST(MAX(cumulative_cost) AS DECIMAL(24,10)) AS spent, COUNT(*) AS n, MAX(usage_date) AS last_date
FROM burndown WHERE daily_cost IS NOT NULL GROUP BY ALL"""),
    "flat": ("spent", f"""
SELECT contract_id, last_date + CAST(i AS INT) AS ds, yhat, yhat * 0.8 AS yhat_lower, yhat * 1.2 AS yhat_upper, value, spent
FROM (SELECT *, CAST(CAST(spent AS DOUBLE) / n AS DECIMAL(24,10)) AS yhat, unnest(range(1, GREATEST({days('last_date', 'end_date')} + 90, 30) + 1)) AS i FROM spent)"""),
    "exhaustion": ("flat", f"""
SELECT contract_id, MIN(CASE WHEN left_over > 0 AND cu >= left_over THEN ds END) AS exhaustion_date_p10,
  MIN(CASE WHEN left_over > 0 AND cm >= left_over THEN ds END) AS exhaustion_date_p50,
  MIN(CASE WHEN left_over > 0 AND cl >= left_over THEN ds END) AS exhaustion_date_p90,
  CASE WHEN MAX(left_over) <= 0 THEN 0 ELSE {days('MIN(ds)', 'MIN(CASE WHEN left_over > 0 AND cm >= left_over THEN ds END)')} END AS days_to_exhaustion
FROM (SELECT contract_id, ds, value - spent AS left_over, SUM(yhat) OVER w AS cm, SUM(yhat_upper) OVER w AS cu, SUM(yhat_lower) OVER w AS cl
      FROM flat WINDOW w AS (PARTITION BY contract_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
GROUP BY contract_id"""),
}

_ORDER = ["usage", "prices", "accounts", "tiers", "dashboard", "long_history", "contracts", "burndown", "summary", "contract_days", "features",
          "spent", "flat", "exhaustion"]
TABLES["features"] = ("contract_days", TABLES["features"][1])


def extend(name: str, needs: str, text: str) -> None:
    TABLES[name] = (needs, text)
    _ORDER.append(name)


def sql(needs: str, body: str) -> str:
    """A standalone statement: the tables it needs as CTEs, then the body."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for child in TABLES[name][0].split():
                add(child)

    for name in needs.split():
        add(name)
    ctes = ",\n".join(f"{n} AS {'' if f'FROM {n})' in TABLES[n][1] else 'MATERIALIZED '}({TABLES[n][1]})" for n in _ORDER if n in wanted)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
