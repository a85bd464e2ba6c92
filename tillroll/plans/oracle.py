"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement runs on the driver tables registered as views.  The sales
view is re-derived in SQL from the base tables, so the oracle shares no
code path with the Spark side.
"""

from __future__ import annotations

SALES = """
sales AS (
  SELECT l.l_orderkey AS order_id,
         c.c_name AS customer_name,
         p.p_name AS product,
         p.p_type AS category,
         r.r_name AS region,
         CAST(l.l_quantity AS DOUBLE) AS quantity,
         CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2)))
              AS DECIMAL(18,4)) AS revenue,
         o.o_orderpriority AS payment_method,
         CASE WHEN l.l_returnflag = 'R' THEN 'Returned'
              WHEN o.o_orderstatus = 'P' AND l.l_linestatus = 'O' THEN 'Cancelled'
              WHEN o.o_orderstatus = 'P' THEN 'Pending'
              WHEN o.o_orderstatus = 'O' THEN 'Shipped'
              ELSE 'Delivered' END AS order_status,
         CAST(o.o_orderdate AS DATE) AS order_date
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def with_sales(body: str, *ctes: str) -> str:
    parts = [SALES] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


def rate(part: str, whole: str) -> str:
    return f"COALESCE((CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)) * 100.0, 0.0)"


ORACLE: dict[str, str] = {}

ORACLE["sales_view"] = with_sales("""
SELECT order_id, customer_name, product, category, region, quantity,
       CAST(revenue AS DOUBLE) AS revenue, payment_method, order_status, order_date
FROM sales""")

ORACLE["monthly_revenue"] = with_sales("""
SELECT strftime(order_date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1""")

ORACLE["revenue_by_category"] = with_sales("""
SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE category IS NOT NULL GROUP BY 1 ORDER BY 1""")

ORACLE["revenue_by_region"] = with_sales(f"""
SELECT region, CAST(r AS DOUBLE) AS revenue, {rate('r', 'SUM(r) OVER ()')} AS share_pct
FROM (SELECT region, SUM(revenue) AS r FROM sales WHERE region IS NOT NULL GROUP BY 1) t
ORDER BY 1""")

ORACLE["payment_method_counts"] = with_sales("""
SELECT payment_method, COUNT(*) AS orders FROM sales
WHERE payment_method IS NOT NULL GROUP BY 1 ORDER BY 1""")

ORACLE["order_status_counts"] = with_sales("""
SELECT order_status, COUNT(*) AS count FROM sales
WHERE order_status IS NOT NULL GROUP BY 1 ORDER BY 1""")

ORACLE["top_products"] = with_sales("""
SELECT product, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE product IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 10""")

ORACLE["daily_revenue"] = with_sales("""
SELECT order_date AS day, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1""")

ORACLE["region_category_matrix"] = with_sales("""
SELECT r.region, c.category, CAST(COALESCE(s.rev, 0) AS DOUBLE) AS revenue
FROM (SELECT DISTINCT region FROM sales WHERE region IS NOT NULL AND category IS NOT NULL) r
CROSS JOIN (SELECT DISTINCT category FROM sales WHERE category IS NOT NULL AND region IS NOT NULL) c
LEFT JOIN (SELECT region, category, SUM(revenue) AS rev FROM sales
           WHERE region IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2) s
  ON s.region = r.region AND s.category = c.category
ORDER BY 1, 2""")


def _top_sql(key: str, by_revenue: bool, k: int = 5) -> str:
    if by_revenue:
        agg = (f"SELECT {key} AS label, CAST(SUM(revenue) AS DOUBLE) AS value FROM sales "
               f"WHERE {key} IS NOT NULL GROUP BY 1")
    else:
        agg = (f"SELECT COALESCE(CAST({key} AS VARCHAR), 'Unknown') AS label, "
               f"CAST(COUNT(*) AS DOUBLE) AS value FROM sales GROUP BY 1")
    return (f"SELECT '{key}' AS dimension, CAST(ROW_NUMBER() OVER (ORDER BY value DESC, label) AS INTEGER) "
            f"AS rank, label, value FROM ({agg}) a ORDER BY value DESC, label LIMIT {k}")


ORACLE["top_items"] = with_sales(" UNION ALL ".join(
    f"SELECT * FROM ({q}) t{i}" for i, q in enumerate([
        _top_sql("product", True), _top_sql("category", True), _top_sql("region", True),
        _top_sql("payment_method", False), _top_sql("order_status", False)])))

ORACLE["preferred_payment"] = with_sales("""
SELECT payment_method, COUNT(*) AS transactions FROM sales WHERE payment_method IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")

ORACLE["best_product"] = with_sales("""
SELECT product, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")

ORACLE["leading_category"] = with_sales(f"""
SELECT category, CAST(rev AS DOUBLE) AS revenue,
       CASE WHEN t.total > 0 THEN {rate('rev', 't.total')} ELSE 0.0 END AS pct_of_total
FROM (SELECT category, SUM(revenue) AS rev FROM sales WHERE category IS NOT NULL
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) c,
     (SELECT CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS total FROM sales) t""")

ORACLE["leading_region"] = with_sales("""
SELECT region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE region IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")

ORACLE["region_cancellation"] = with_sales(f"""
SELECT region, cancelled, total, {rate('cancelled', 'total')} AS cancel_rate FROM (
  SELECT region, COUNT(*) FILTER (WHERE lower(order_status) = 'cancelled') AS cancelled,
         COUNT(*) AS total
  FROM sales WHERE region IS NOT NULL GROUP BY 1) t
WHERE cancelled > 0 ORDER BY cancel_rate DESC, region""")

ORACLE["monthly_history"] = with_sales("""
SELECT period, revenue FROM (
  SELECT strftime(order_date, '%Y-%m') AS period, CAST(format('{:.2f}', CAST(SUM(revenue) AS DOUBLE)) AS DOUBLE) AS revenue
  FROM sales WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 6) t
ORDER BY period""")

ORACLE["filter_options"] = with_sales("""
SELECT DISTINCT dimension, value FROM (
  SELECT 'category' AS dimension, category AS value FROM sales
  UNION ALL SELECT 'region', region FROM sales
  UNION ALL SELECT 'payment_method', payment_method FROM sales
  UNION ALL SELECT 'order_status', order_status FROM sales) t
WHERE value IS NOT NULL ORDER BY 1, 2""")


def _kpi_ctes(where: str = "TRUE") -> list[str]:
    return [f"f AS (SELECT * FROM sales WHERE {where})", """
tot AS (SELECT CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS tr, COUNT(*) AS n,
               COUNT(DISTINCT order_id) AS orders,
               COUNT(*) FILTER (WHERE lower(order_status) = 'cancelled') AS nc,
               COUNT(*) FILTER (WHERE lower(order_status) = 'returned') AS nr FROM f),
reg AS (SELECT region FROM f WHERE region IS NOT NULL GROUP BY 1
        ORDER BY CAST(SUM(revenue) AS DOUBLE) DESC, region LIMIT 1),
cat AS (SELECT category FROM f WHERE category IS NOT NULL GROUP BY 1
        ORDER BY CAST(SUM(revenue) AS DOUBLE) DESC, category LIMIT 1),
cust AS (SELECT COUNT(*) AS nc, COUNT(*) FILTER (WHERE k > 1) AS nret
         FROM (SELECT customer_name, COUNT(*) AS k FROM f WHERE customer_name IS NOT NULL GROUP BY 1) t),
bask AS (SELECT AVG(q) AS b FROM (SELECT order_id, COALESCE(SUM(quantity), 0) AS q FROM f
                                  WHERE order_id IS NOT NULL GROUP BY 1) t),
m AS (SELECT strftime(order_date, '%Y-%m') AS m, CAST(SUM(revenue) AS DOUBLE) AS r FROM f
      WHERE order_date IS NOT NULL GROUP BY 1),
ml AS (SELECT m, r, ROW_NUMBER() OVER (ORDER BY m DESC) AS rn FROM m),
g AS (SELECT MAX(r) FILTER (WHERE rn = 1) AS last, MAX(r) FILTER (WHERE rn = 2) AS prev, COUNT(*) AS nm FROM ml),
kpi AS (
SELECT tot.tr AS total_revenue,
       CAST(tot.orders AS BIGINT) AS total_orders,
       CASE WHEN tot.orders > 0 THEN tot.tr / CAST(tot.orders AS DOUBLE) ELSE 0.0 END AS aov,
       COALESCE((SELECT region FROM reg), 'N/A') AS top_region,
       COALESCE((SELECT category FROM cat), 'N/A') AS top_category,
       CASE WHEN g.nm >= 2 AND g.prev > 0 THEN ((g.last - g.prev) / g.prev) * 100.0 ELSE 0.0 END AS monthly_growth,
       CASE WHEN tot.n > 0 THEN (CAST(tot.nc AS DOUBLE) / CAST(tot.n AS DOUBLE)) * 100.0 ELSE 0.0 END AS cancellation_rate,
       CASE WHEN tot.n > 0 THEN (CAST(tot.nr AS DOUBLE) / CAST(tot.n AS DOUBLE)) * 100.0 ELSE 0.0 END AS return_rate,
       CASE WHEN cust.nc > 0 THEN (CAST(cust.nret AS DOUBLE) / CAST(cust.nc AS DOUBLE)) * 100.0 ELSE 0.0 END
         AS returning_customer_rate,
       tot.tr * 0.30 AS gross_profit,
       CASE WHEN tot.tr > 0 THEN ((tot.tr * 0.30) / tot.tr) * 100.0 ELSE 0.0 END AS profit_margin,
       COALESCE(CAST(bask.b AS DOUBLE), 0.0) AS avg_basket_size,
       COALESCE((SELECT m FROM m ORDER BY r DESC, m LIMIT 1), 'N/A') AS best_sales_month,
       COALESCE((SELECT m FROM m ORDER BY r ASC, m LIMIT 1), 'N/A') AS worst_sales_month
FROM tot, g, cust, bask)""".strip()]


def _kpi_sql(where: str = "TRUE") -> str:
    return with_sales("SELECT * FROM kpi", *_kpi_ctes(where))


E1_WHERE = ("order_date >= DATE '1996-01-01' AND order_date <= DATE '1999-06-30' "
            "AND category IN ('ECONOMY', 'PROMO') AND region IN ('ASIA', 'EUROPE') "
            "AND payment_method IN ('1-URGENT', '2-HIGH') "
            "AND order_status IN ('Delivered', 'Shipped', 'Cancelled')")
F10_WHERE = (E1_WHERE + " AND revenue >= 5000.0 AND revenue <= 80000.0 "
             "AND regexp_matches(lower(product), '^(red|blue|hot) ')")

ORACLE["kpis"] = _kpi_sql()
ORACLE["kpis_filtered"] = _kpi_sql(E1_WHERE)

ORACLE["filtered_orders"] = with_sales(f"""
SELECT order_id, customer_name, product, category, region, quantity,
       CAST(revenue AS DOUBLE) AS revenue, payment_method, order_status, order_date
FROM sales WHERE {F10_WHERE}""")

ORACLE["filtered_orders_long_list"] = with_sales("""
SELECT order_id, customer_name, product, category, region, quantity,
       CAST(revenue AS DOUBLE) AS revenue, payment_method, order_status, order_date
FROM sales WHERE revenue >= 50000 AND category IN (SELECT 'ECONOMY' UNION ALL SELECT 'PROMO' UNION ALL SELECT 'EXTRA ' || i FROM range(100000) r(i))""")

ORACLE["filtered_orders_literal"] = with_sales("""
SELECT order_id, customer_name, product, category, region, quantity,
       CAST(revenue AS DOUBLE) AS revenue, payment_method, order_status, order_date
FROM sales WHERE contains(lower(product), 'red widget') AND order_date >= DATE '1998-01-01'""")

ORACLE["date_presets"] = with_sales("""
SELECT label, date_start, date_end FROM (
  SELECT 1 AS ord, 'Last 7 days' AS label, strftime(a - INTERVAL 6 DAY, '%Y-%m-%d') AS date_start,
         strftime(a, '%Y-%m-%d') AS date_end FROM mx
  UNION ALL SELECT 2, 'This month', strftime(date_trunc('month', a), '%Y-%m-%d'), strftime(a, '%Y-%m-%d') FROM mx
  UNION ALL SELECT 3, 'Last quarter', strftime(date_trunc('quarter', a - INTERVAL 3 MONTH), '%Y-%m-%d'),
         strftime(last_day(date_trunc('quarter', a - INTERVAL 3 MONTH) + INTERVAL 2 MONTH), '%Y-%m-%d') FROM mx
  UNION ALL SELECT 4, 'This year', strftime(date_trunc('year', a), '%Y-%m-%d'), strftime(a, '%Y-%m-%d') FROM mx
) t ORDER BY ord""", "mx AS (SELECT MAX(order_date) AS a FROM sales HAVING MAX(order_date) IS NOT NULL)")

_FC_CTES = [
    "d AS (SELECT * FROM sales WHERE order_date IS NOT NULL)",
    """tp AS (SELECT product FROM d WHERE product IS NOT NULL GROUP BY 1
       ORDER BY CAST(COALESCE(SUM(quantity), 0) AS DOUBLE) DESC, product LIMIT 1)""",
    """tc AS (SELECT category FROM d WHERE category IS NOT NULL GROUP BY 1
       ORDER BY CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) DESC, category LIMIT 1)""",
    """m AS (SELECT date_trunc('month', order_date) AS month,
              CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS y_rev,
              CAST(COALESCE(SUM(CASE WHEN product = (SELECT product FROM tp) THEN quantity END), 0) AS DOUBLE) AS y_prod,
              CAST(COALESCE(SUM(CASE WHEN category = (SELECT category FROM tc) THEN revenue END), 0) AS DOUBLE) AS y_cat
       FROM d GROUP BY 1)""",
    "mx AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM m)",
    """fit AS (SELECT COUNT(*) AS n, MAX(month) AS last_month,
              regr_slope(y_rev, x) AS b_rev, regr_intercept(y_rev, x) AS a_rev,
              regr_slope(y_prod, x) AS b_prod, regr_intercept(y_prod, x) AS a_prod,
              regr_slope(y_cat, x) AS b_cat, regr_intercept(y_cat, x) AS a_cat
       FROM mx HAVING COUNT(*) >= 3)""",
]

ORACLE["forecast"] = with_sales("""
SELECT strftime(last_month + to_months(CAST(i AS INTEGER)), '%Y-%m') AS period,
       CAST(format('{:.2f}', GREATEST(0.0, a_rev + b_rev * CAST(n - 1 + i AS DOUBLE))) AS DOUBLE) AS predicted_revenue,
       (SELECT product FROM tp) AS top_product,
       CAST(ROUND_EVEN(GREATEST(0.0, a_prod + b_prod * CAST(n - 1 + i AS DOUBLE)), 0) AS BIGINT)
         AS predicted_product_demand,
       (SELECT category FROM tc) AS top_category,
       CAST(format('{:.2f}', GREATEST(0.0, a_cat + b_cat * CAST(n - 1 + i AS DOUBLE))) AS DOUBLE) AS predicted_category_revenue
FROM fit, generate_series(1, 3) s(i) ORDER BY period""", *_FC_CTES)

ORACLE["forecast_series"] = with_sales("""
SELECT strftime(last_month + to_months(CAST(i AS INTEGER)), '%Y-%m') AS period,
       CAST(format('{:.2f}', GREATEST(0.0, a_rev + b_rev * CAST(n - 1 + i AS DOUBLE))) AS DOUBLE) AS predicted_revenue
FROM fit, generate_series(1, 3) s(i) ORDER BY period""", *_FC_CTES)

ORACLE["trend_fit"] = with_sales("""
SELECT n AS n_months, ROUND(b_rev, 6) AS slope, ROUND(a_rev, 6) AS intercept FROM fit""",
                                 *[c.replace("HAVING COUNT(*) >= 3", "") for c in _FC_CTES])

ORACLE["forecast_confidence"] = with_sales("""
SELECT CAST(LEAST(observed, 6) AS BIGINT) AS month_count,
       CASE WHEN LEAST(observed, 6) >= 6 THEN 'Moderate' WHEN LEAST(observed, 6) >= 3 THEN 'Low'
            ELSE 'Unavailable' END AS confidence,
       CASE WHEN LEAST(observed, 6) >= 6
              THEN 'Forecast is based on multiple historical months, but it still uses a simple linear trend.'
            WHEN LEAST(observed, 6) >= 3
              THEN 'Forecast has the minimum history needed for trend regression. Treat it as directional.'
            ELSE 'At least 3 months of valid revenue history are required to generate a forecast.' END AS note,
       LEAST(observed, 6) >= 3 AND observed >= 3 AS has_enough_history
FROM (SELECT COUNT(DISTINCT date_trunc('month', order_date)) AS observed FROM sales
      WHERE order_date IS NOT NULL) t""")


def _forecast_by_sql(key: str) -> str:
    steady = lambda y: f"round(greatest(0.0, a_{y} + b_{y} * CAST(n - 1 + i AS DOUBLE)), 8)"
    fits = ", ".join(f"regr_slope(y_{y}, x) AS b_{y}, regr_intercept(y_{y}, x) AS a_{y}" for y in ("rev", "prod", "cat"))
    top = lambda name, v: (f"SELECT k, arg_min({name}, {{'v': -v, 'k': {name}}}) AS top FROM (SELECT {key} AS k, {name}, "  # noqa: E731
                           f"CAST(coalesce(sum({v}), 0) AS DOUBLE) AS v FROM d WHERE {name} IS NOT NULL GROUP BY 1, 2) GROUP BY k")
    return with_sales(f"""
SELECT k AS {key}, strftime(last_month + to_months(CAST(i AS INTEGER)), '%Y-%m') AS period,
       CAST(format('{{:.2f}}', {steady('rev')}) AS DOUBLE) AS predicted_revenue, top_product,
       CAST(round_even({steady('prod')}, 0) AS BIGINT) AS predicted_product_demand, top_category,
       CAST(format('{{:.2f}}', {steady('cat')}) AS DOUBLE) AS predicted_category_revenue
FROM fit, generate_series(1, 3) s(i)""",
                      f"d AS (SELECT * FROM sales WHERE order_date IS NOT NULL AND {key} IS NOT NULL)",
                      f"tp AS ({top('product', 'quantity')})", f"tc AS ({top('category', 'revenue')})",
                      f"""m AS (SELECT d.{key} AS k, tp.top AS top_product, tc.top AS top_category, date_trunc('month', order_date) AS month,
              CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS y_rev,
              CAST(coalesce(sum(CASE WHEN product = tp.top THEN quantity END), 0) AS DOUBLE) AS y_prod,
              CAST(coalesce(sum(CASE WHEN category = tc.top THEN revenue END), 0) AS DOUBLE) AS y_cat
       FROM d LEFT JOIN tp ON tp.k = d.{key} LEFT JOIN tc ON tc.k = d.{key} GROUP BY ALL)""",
                      "mx AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY month) - 1 AS DOUBLE) AS x FROM m)",
                      f"""fit AS (SELECT k, top_product, top_category, count(*) AS n, max(month) AS last_month, {fits}
       FROM mx GROUP BY ALL HAVING count(*) >= 3)""")


ORACLE["forecast_by_product"] = _forecast_by_sql("product")
ORACLE["forecast_by_region"] = _forecast_by_sql("region")


# --- dirty variant and the profiling / cleaning operators -----------------

NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DIRTY = [
    """dirty AS (
  SELECT order_id AS "Order ID", customer_name AS "Customer Name", product AS "Product Name",
         CASE WHEN order_id % 17 = 0 THEN NULL ELSE category END AS "Product Category",
         region AS "Region", quantity AS "Quantity",
         CASE WHEN order_id % 23 = 0 THEN 'n/a?'
              WHEN order_id % 37 = 0 THEN '-' || CAST(revenue AS VARCHAR)
              ELSE CAST(revenue AS VARCHAR) END AS "Sales",
         payment_method AS "Payment Method", order_status AS "Order Status",
         CASE WHEN order_id % 31 = 0 THEN '32-13-2023' ELSE CAST(order_date AS VARCHAR) END AS "Order Date",
         CAST(NULL AS VARCHAR) AS "Notes"
  FROM sales)""",
    """raw AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE "Order ID" % 29 = 0)""",
    f"""num AS (SELECT *, CASE WHEN regexp_full_match("Sales", '{NUMBER_RE}')
                          THEN TRY_CAST(trim("Sales") AS DOUBLE) END AS sales_num,
                     TRY_CAST(trim("Order Date") AS TIMESTAMP) AS date_ts FROM raw)""",
]
DIRTY_COLS = ["Order ID", "Customer Name", "Product Name", "Product Category", "Region", "Quantity",
              "Sales", "Payment Method", "Order Status", "Order Date", "Notes"]

_PROFILE = [
    "counts AS (SELECT COUNT(*) AS total_rows, "
    + " + ".join(f'(COUNT(*) - COUNT("{c}"))' for c in DIRTY_COLS) + " AS missing_cells, "
    + ", ".join(f'COUNT(*) - COUNT("{c}") AS m{i}' for i, c in enumerate(DIRTY_COLS)) + ", "
    """COUNT(*) FILTER (WHERE "Sales" IS NOT NULL AND sales_num IS NULL) AS bad_numbers,
       COUNT(*) FILTER (WHERE "Order Date" IS NOT NULL AND date_ts IS NULL) AS bad_dates,
       COUNT(*) FILTER (WHERE sales_num < 0) AS negatives FROM num)""",
    "dups AS (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_count FROM "
    "(SELECT COUNT(*) AS n FROM raw GROUP BY " + ", ".join(f'"{c}"' for c in DIRTY_COLS) + ") t)",
    """warn AS (SELECT * FROM (
       SELECT 0 AS k, 'Column ''Sales'' has ' || bad_numbers || ' non-numeric values that should be numbers.' AS w
         FROM counts WHERE bad_numbers > 0
       UNION ALL SELECT 1, 'Column ''Order Date'' has ' || bad_dates
         || ' values that could not be parsed as valid dates.' FROM counts WHERE bad_dates > 0
       UNION ALL SELECT 2, 'Column ''Sales'' has ' || negatives || ' negative values.' FROM counts WHERE negatives > 0) t)""",
    """prof AS (SELECT c.total_rows, c.missing_cells, d.duplicate_count, c.bad_dates, c.negatives,
                   (SELECT COUNT(*) FROM warn) AS warnings,
                   CAST(GREATEST(c.total_rows, 1) AS DOUBLE) AS n FROM counts c, dups d)""",
]

ORACLE["data_profile"] = with_sales("""
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good'
               WHEN quality_score >= 60 THEN 'Needs Review' ELSE 'Poor' END AS quality_grade
FROM scored""", *DIRTY, *_PROFILE, """scored AS (
SELECT CAST(total_rows AS BIGINT) AS total_rows, 11 AS total_columns,
       CAST(missing_cells AS BIGINT) AS missing_cells, duplicate_count,
       CAST(bad_dates AS BIGINT) AS invalid_date_count, CAST(negatives AS BIGINT) AS negative_revenue_count,
       CAST(warnings AS INTEGER) AS warning_count,
       0 AS missing_required,  -- the ten raw headers map onto the ten required names
       CAST(GREATEST(0, LEAST(100, 100 - 0
         - LEAST(20, round_even((missing_cells / n) * 8, 0))
         - LEAST(15, round_even((duplicate_count / n) * 100, 0))
         - LEAST(15, round_even((bad_dates / n) * 100, 0))
         - LEAST(15, round_even((negatives / n) * 100, 0))
         - LEAST(10, warnings * 2))) AS INTEGER) AS quality_score
FROM prof)""")

# The same defects in a day-first export: the text and its reading differ, nothing else.
DAY_FIRST = [DIRTY[0].replace("ELSE CAST(order_date AS VARCHAR) END", "ELSE strftime(order_date, '%d/%m/%Y') END"), DIRTY[1],
             DIRTY[2].replace("""TRY_CAST(trim("Order Date") AS TIMESTAMP)""", """try_strptime(trim("Order Date"), '%d/%m/%Y')""")]
ORACLE["data_profile_dayfirst"] = ORACLE["data_profile"].replace(DIRTY[0], DAY_FIRST[0]).replace(DIRTY[2], DAY_FIRST[2])

ORACLE["missing_by_column"] = with_sales(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS position, CAST(m{i} AS BIGINT) AS missing_count FROM counts"
                       for i, c in enumerate(DIRTY_COLS)), *DIRTY, *_PROFILE)

ORACLE["data_warnings"] = with_sales(
    "SELECT CAST(ROW_NUMBER() OVER (ORDER BY k) - 1 AS INTEGER) AS position, w AS warning FROM warn",
    *DIRTY, *_PROFILE)

ORACLE["cleaned_sales"] = with_sales("""
SELECT DISTINCT "Order ID" AS order_id, COALESCE("Customer Name", 'Unknown') AS customer_name,
       COALESCE("Product Name", 'Unknown') AS product, COALESCE("Product Category", 'Unknown') AS category,
       COALESCE("Region", 'Unknown') AS region, "Quantity" AS quantity,
       COALESCE(sales_num, (SELECT median(sales_num) FROM num)) AS revenue,
       COALESCE("Payment Method", 'Unknown') AS payment_method, COALESCE("Order Status", 'Unknown') AS order_status,
       date_ts AS order_date
FROM num""", *DIRTY)

ORACLE["cleaned_sales_dayfirst"] = ORACLE["cleaned_sales"].replace(DIRTY[0], DAY_FIRST[0]).replace(DIRTY[2], DAY_FIRST[2])


# --- insights ----------------------------------------------------------------

# Fixed values, written out here so that the SQL shares nothing with the engine.
CATEGORIES = ("Revenue Insights", "Product Insights", "Customer Insights", "Risk Alerts")

TEMPLATES = {
    "I0": "No data available to generate insights.",
    "I1": "Total revenue across all transactions is Rs {total_revenue:,.2f} with {total_orders:,} orders processed.",
    "I2": "The average order value is Rs {aov:,.2f}.",
    "I3": "Monthly revenue grew by {growth:.1f}% compared to the previous month.",
    "I4": "Monthly revenue declined by {decline:.1f}% compared to the previous month. "
          "Immediate attention is recommended.",
    "I5": "Estimated profit margin is {margin:.1f}% with gross profit of Rs {gross_profit:,.2f}.",
    "I6": "The {lead_category} category leads revenue with Rs {lead_category_revenue:,.2f} ({lead_category_pct:.1f}% of total).",
    "I7": "'{best_product}' is the best-selling product, generating Rs {best_product_revenue:,.2f}.",
    "I8": "Customers are purchasing an average of {basket:.1f} items per order.",
    "I9": "The {lead_region} region is the strongest market, contributing Rs {lead_region_revenue:,.2f}.",
    "I10": "Customer retention is strong at {retention:.1f}%. Loyalty programs are highly effective.",
    "I11": "Only {retention:.1f}% of customers are returning. Consider post-purchase engagement to boost loyalty.",
    "I12": "The preferred payment method is {payment} ({payment_count:,} transactions).",
    "I13c": "High Cancellation Rate: {cancel:.1f}% of orders are cancelled. Immediate investigation required.",
    "I13w": "Cancellation rate is {cancel:.1f}%. Consider reviewing inventory availability and checkout UX.",
    "I14c": "High Return Rate: {returns:.1f}% of items are being returned. Quality control review is strongly advised.",
    "I14w": "Return rate is {returns:.1f}%. Ensure product descriptions match the physical items.",
    "I15": "{worst_region} region is experiencing an abnormal cancellation rate of {worst_rate:.1f}%.",
}

BRIEF_LINES = (
    "Revenue: Rs {total_revenue:,.2f}",
    "Orders: {total_orders}",
    "Average Order Value: Rs {aov:,.2f}",
    "Cancellation Rate: {cancellation_rate:.2f}%",
    "Return Rate: {return_rate:.2f}%",
    "Returning Customer Rate: {returning_customer_rate:.2f}%",
    "Top Region: {top_region}",
    "Top Category: {top_category}",
)
BRIEF_SECTIONS = (
    ("Top Products:", "product", "revenue"),
    ("Top Categories:", "category", "revenue"),
    ("Region Sales:", "region", "revenue"),
    ("Payment Methods:", "payment_method", None),
    ("Order Status Summary:", "order_status", None),
)
BRIEF_VALUE_LINE = "- {label}: Rs {value:,.2f}"
BRIEF_COUNT_LINE = "- {label}: {value}"
BRIEF_MISSING = "- N/A"

def _fmt_sql(template: str, values: dict[str, str]) -> str:
    """Template -> DuckDB string expression using format()."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)(?::([^}]*))?\}", template):
        if m.start() > pos:
            parts.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        expr, spec = values[m.group(1)], m.group(2) or ""
        parts.append(f"format('{{:{spec}}}', {expr})" if spec else f"CAST({expr} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        parts.append("'" + template[pos:].replace("'", "''") + "'")
    return " || ".join(parts)


def _insights_sql(where: str = "TRUE") -> str:
    v = {"total_revenue": "total_revenue", "total_orders": "total_orders", "aov": "aov",
         "growth": "monthly_growth", "decline": "abs(monthly_growth)", "margin": "profit_margin",
         "gross_profit": "gross_profit", "basket": "avg_basket_size", "retention": "returning_customer_rate",
         "cancel": "cancellation_rate", "returns": "return_rate",
         "lead_category": "(SELECT k FROM lc)", "lead_category_revenue": "(SELECT v FROM lc)",
         "lead_category_pct": f"CASE WHEN total_revenue > 0 THEN {rate('(SELECT v FROM lc)', 'total_revenue')} ELSE 0.0 END",
         "best_product": "(SELECT k FROM bp)", "best_product_revenue": "(SELECT v FROM bp)",
         "lead_region": "(SELECT k FROM lr)", "lead_region_revenue": "(SELECT v FROM lr)",
         "payment": "(SELECT k FROM pm)", "payment_count": "(SELECT v FROM pm)",
         "worst_region": "(SELECT k FROM wr)", "worst_rate": "(SELECT v FROM wr)"}
    rules = [
        (0, 1, "good", "I1", "total_revenue > 0"), (0, 2, "good", "I2", "aov > 0"),
        (0, 3, "good", "I3", "monthly_growth > 0"), (3, 1, "critical", "I4", "monthly_growth < 0"),
        (0, 4, "good", "I5", "profit_margin > 0"),
        (1, 1, "good", "I6", "top_category <> 'N/A' AND (SELECT k FROM lc) IS NOT NULL"),
        (1, 2, "good", "I7", "(SELECT k FROM bp) IS NOT NULL"), (1, 3, "good", "I8", "avg_basket_size > 0"),
        (2, 1, "good", "I9", "top_region <> 'N/A' AND (SELECT k FROM lr) IS NOT NULL"),
        (2, 2, "good", "I10", "returning_customer_rate >= 30"),
        (2, 2, "warning", "I11", "returning_customer_rate > 0 AND returning_customer_rate < 30"),
        (2, 3, "good", "I12", "(SELECT k FROM pm) IS NOT NULL"),
        (3, 2, "critical", "I13c", "cancellation_rate > 15"),
        (3, 2, "warning", "I13w", "cancellation_rate > 8 AND cancellation_rate <= 15"),
        (3, 3, "critical", "I14c", "return_rate > 10"),
        (3, 3, "warning", "I14w", "return_rate > 5 AND return_rate <= 10"),
        (3, 4, "critical", "I15", "(SELECT v FROM wr) > 15"),
    ]
    branches = [f"SELECT {c} AS cat, {o} AS ord, '{CATEGORIES[c]}' AS category, '{sev}' AS severity, "
                f"{_fmt_sql(TEMPLATES[t], v)} AS text FROM kpi WHERE {cond}" for c, o, sev, t, cond in rules]
    ctes = _kpi_ctes(where) + [
        "lc AS (SELECT category AS k, CAST(SUM(revenue) AS DOUBLE) AS v FROM f WHERE category IS NOT NULL "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        "bp AS (SELECT product AS k, CAST(SUM(revenue) AS DOUBLE) AS v FROM f WHERE product IS NOT NULL "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        "lr AS (SELECT region AS k, CAST(SUM(revenue) AS DOUBLE) AS v FROM f WHERE region IS NOT NULL "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        "pm AS (SELECT payment_method AS k, COUNT(*) AS v FROM f WHERE payment_method IS NOT NULL "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        f"wr AS (SELECT region AS k, {rate('c', 't')} AS v FROM (SELECT region, "
        "COUNT(*) FILTER (WHERE lower(order_status) = 'cancelled') AS c, COUNT(*) AS t FROM f "
        "WHERE region IS NOT NULL GROUP BY 1) x WHERE c > 0 ORDER BY v DESC, k LIMIT 1)",
        "fired AS (" + " UNION ALL ".join(branches) + ")",
    ]
    return with_sales("""
SELECT category, CAST(ROW_NUMBER() OVER (PARTITION BY cat ORDER BY ord) - 1 AS INTEGER) AS position,
       severity, text FROM fired ORDER BY cat, ord""", *ctes)


def _brief_sql() -> str:
    v = {c: c for c in ["total_revenue", "total_orders", "aov", "cancellation_rate", "return_rate",
                        "returning_customer_rate", "top_region", "top_category"]}
    pieces = [_fmt_sql(t, v) for t in BRIEF_LINES]
    for title, key, value in BRIEF_SECTIONS:
        if value:
            agg = (f"SELECT {key} AS label, CAST(SUM({value}) AS DOUBLE) AS value FROM f "
                   f"WHERE {key} IS NOT NULL GROUP BY 1")
            line = _fmt_sql(BRIEF_VALUE_LINE, {"label": "label", "value": "value"})
        else:
            agg = (f"SELECT COALESCE(CAST({key} AS VARCHAR), 'Unknown') AS label, COUNT(*) AS value "
                   f"FROM f GROUP BY 1")
            line = _fmt_sql(BRIEF_COUNT_LINE, {"label": "label", "value": "value"})
        section = (f"(SELECT string_agg({line}, chr(10) ORDER BY value DESC, label) FROM "
                   f"(SELECT * FROM ({agg}) a ORDER BY value DESC, label LIMIT 5) t)")
        pieces += ["''", f"'{title}'", section]
    return with_sales("SELECT concat_ws(chr(10), " + ", ".join(pieces) + ") AS brief FROM kpi",
                      *_kpi_ctes())


ORACLE["insights"] = _insights_sql()
ORACLE["kpi_brief"] = _brief_sql()


# --- bundles, listings, exports, activity ------------------------------------

def _py_round(x: str) -> str:
    return f"CAST(format('{{:.2f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


CANON = ("order_id, customer_name, product, category, region, quantity, CAST(revenue AS DOUBLE) AS revenue, "
         "payment_method, order_status, order_date")
STABLE_ORDER = ("order_date ASC NULLS FIRST, order_id ASC NULLS FIRST, product ASC NULLS FIRST, "
                "customer_name ASC NULLS FIRST, category ASC NULLS FIRST, region ASC NULLS FIRST, "
                "quantity ASC NULLS FIRST, revenue ASC NULLS FIRST, payment_method ASC NULLS FIRST, "
                "order_status ASC NULLS FIRST")

ORACLE["orders_api"] = with_sales(f"""
SELECT {CANON} FROM sales
WHERE regexp_matches(lower(product), 'widget') AND category IN ('ECONOMY', 'SMALL')
ORDER BY {STABLE_ORDER} LIMIT 50""")

ORACLE["orders_page"] = with_sales(f"""
SELECT {CANON} FROM sales WHERE {E1_WHERE}
ORDER BY {STABLE_ORDER} LIMIT 10 OFFSET 20""")

ORACLE["orders_last_page"] = with_sales(f"""
SELECT {CANON} FROM sales
ORDER BY {STABLE_ORDER} LIMIT 10 OFFSET (SELECT 10 * greatest(CAST(ceil(count(*) / 10.0) AS BIGINT) - 1, 0) FROM sales)""")

ORACLE["preview_rows"] = with_sales(f"SELECT {CANON} FROM sales ORDER BY {STABLE_ORDER} LIMIT 15")

_ROLLUP = [
    ("month", "strftime(order_date, '%Y-%m')", "CAST(NULL AS VARCHAR)", "order_date IS NOT NULL"),
    ("day", "strftime(order_date, '%Y-%m-%d')", "CAST(NULL AS VARCHAR)", "order_date IS NOT NULL"),
    ("category", "category", "CAST(NULL AS VARCHAR)", "category IS NOT NULL"),
    ("region", "region", "CAST(NULL AS VARCHAR)", "region IS NOT NULL"),
    ("payment_method", "payment_method", "CAST(NULL AS VARCHAR)", "payment_method IS NOT NULL"),
    ("order_status", "order_status", "CAST(NULL AS VARCHAR)", "order_status IS NOT NULL"),
    ("region_category", "region", "category", "region IS NOT NULL AND category IS NOT NULL"),
    ("total", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "TRUE"),
]
ORACLE["dashboard_rollup"] = with_sales(" UNION ALL ".join(
    f"SELECT '{name}' AS breakdown, {k} AS key, {k2} AS key2, CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS revenue, "
    f"COUNT(*) AS row_count FROM sales WHERE {cond} GROUP BY 2, 3" for name, k, k2, cond in _ROLLUP))

_E2_WHERE = ("order_date >= DATE '1996-01-01' AND order_date <= DATE '1999-06-30' "
             "AND category IN ('ECONOMY', 'PROMO') AND region IN ('ASIA', 'EUROPE')")
ORACLE["charts_bundle"] = with_sales(f"""
SELECT 'monthly_trend' AS chart, strftime(order_date, '%Y-%m') AS label, CAST(SUM(revenue) AS DOUBLE) AS value
FROM e2 WHERE order_date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'category_rev', category, CAST(SUM(revenue) AS DOUBLE) FROM e2 WHERE category IS NOT NULL GROUP BY 2
UNION ALL SELECT 'region_rev', region, CAST(SUM(revenue) AS DOUBLE) FROM e2 WHERE region IS NOT NULL GROUP BY 2
UNION ALL SELECT 'payment_methods', payment_method, CAST(COUNT(*) AS DOUBLE) FROM e2
  WHERE payment_method IS NOT NULL GROUP BY 2""", f"e2 AS (SELECT * FROM sales WHERE {_E2_WHERE})")

ORACLE["workbook_summary"] = with_sales(f"""
SELECT v.position, v.metric, x.value_number, x.value_text
FROM (VALUES (0, 'Total Revenue (Rs)'), (1, 'Total Orders'), (2, 'Average Order Value (Rs)'),
             (3, 'Top Region'), (4, 'Top Category'), (5, 'Cancellation Rate (%)'),
             (6, 'Returning Customer Rate (%)')) v(position, metric)
JOIN (SELECT 0 AS p, {_py_round('total_revenue')} AS value_number, CAST(NULL AS VARCHAR) AS value_text FROM kpi
      UNION ALL SELECT 1, CAST(total_orders AS DOUBLE), NULL FROM kpi
      UNION ALL SELECT 2, {_py_round('aov')}, NULL FROM kpi
      UNION ALL SELECT 3, NULL, top_region FROM kpi
      UNION ALL SELECT 4, NULL, top_category FROM kpi
      UNION ALL SELECT 5, {_py_round('cancellation_rate')}, NULL FROM kpi
      UNION ALL SELECT 6, {_py_round('returning_customer_rate')}, NULL FROM kpi) x ON x.p = v.position""",
                                       *_kpi_ctes())

ORACLE["report_kpi_table"] = with_sales("""
SELECT position, metric, value FROM (
  SELECT 0 AS position, 'Total Revenue' AS metric, 'Rs ' || format('{:,.2f}', total_revenue) AS value FROM kpi
  UNION ALL SELECT 1, 'Total Orders', format('{:,}', total_orders) FROM kpi
  UNION ALL SELECT 2, 'Average Order Value (AOV)', 'Rs ' || format('{:,.2f}', aov) FROM kpi
  UNION ALL SELECT 3, 'Top Performing Region', top_region FROM kpi
  UNION ALL SELECT 4, 'Top Performing Category', top_category FROM kpi
  UNION ALL SELECT 5, 'Order Cancellation Rate', format('{:.2f}', cancellation_rate) || '%' FROM kpi
  UNION ALL SELECT 6, 'Returning Customer Rate', format('{:.2f}', returning_customer_rate) || '%' FROM kpi) t""",
                                        *_kpi_ctes())

ORACLE["report_top_products"] = with_sales("""
SELECT product, 'Rs ' || format('{:,.2f}', revenue) AS revenue_text, revenue FROM (
  SELECT product, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t""")

ORACLE["recent_activity"] = """
SELECT e.event_id, e.ts AS created_at, COALESCE(c.c_name, 'system') AS actor, e.event_type AS action,
       e.event_type AS action_label, trim(COALESCE(c.c_name, 'system') || ': ' || e.event_type || ' ' || COALESCE(e.props, '')) AS shown,
       e.props AS details
FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 25) e
LEFT JOIN customer c ON e.user_id = c.c_custkey
ORDER BY created_at DESC, event_id"""

ORACLE["user_activity_counts"] = """
SELECT (SELECT COUNT(*) FROM customer) AS total_users,
       (SELECT COUNT(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) AS active_users"""

REPORT_WHERE = "order_date >= DATE '1997-01-01' AND order_date <= DATE '1998-12-31'"
ORACLE["report_insights"] = _insights_sql(REPORT_WHERE)

ORACLE["document_previews"] = """
SELECT doc_id, CASE WHEN length(t) > 180 THEN substring(t, 1, 180) || '...' ELSE t END AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) d"""

# The CSV round trip must profile exactly like the dirty variant itself.
ORACLE["csv_profile"] = ORACLE["data_profile"]


# --- catalog, exports, the rules that the whole table does not fire -----------------

def _cleaned_kpis(cleaned: str) -> str:
    """The KPI card over the cleaned table, in place of the stored one, at two decimals."""
    names = {"total_orders", *_NAMES}
    card = ", ".join(m if m in names else f"round({m}, 2) AS {m}" for m in _METRICS)
    ctes = ",\n".join(_kpi_ctes()).replace("FROM sales WHERE TRUE", "FROM cleaned")
    return f"WITH cleaned AS ({cleaned}),\n{ctes}\nSELECT {card} FROM kpi"


_METRICS = ["total_revenue", "total_orders", "aov", "top_region", "top_category", "monthly_growth", "cancellation_rate", "return_rate",
            "returning_customer_rate", "gross_profit", "profit_margin", "avg_basket_size", "best_sales_month", "worst_sales_month"]
_NAMES = ("top_region", "top_category", "best_sales_month", "worst_sales_month")

ORACLE["active_sales_kpis"] = _cleaned_kpis(ORACLE["cleaned_sales_dayfirst"])


def _uploaded(name: str, profile: str, cleaned: str, active: bool) -> str:
    return (f"SELECT '{name}' AS name, 'ops' AS owner, (SELECT count(*) FROM ({cleaned}) c) AS row_count, 10 AS column_count, p.quality_score, "
            f"p.quality_grade, {active} AS is_active, p.total_rows AS raw_rows, p.duplicate_count AS duplicates, "
            f"(SELECT missing_count FROM ({ORACLE['missing_by_column']}) m WHERE column_name = 'Product Category') AS missing_categories, "
            f"p.warning_count AS warnings FROM ({profile}) p")


ORACLE["dataset_catalog"] = (_uploaded("export", ORACLE["data_profile"], ORACLE["cleaned_sales"], False) + " UNION ALL "
                             + _uploaded("export-dayfirst", ORACLE["data_profile_dayfirst"], ORACLE["cleaned_sales_dayfirst"], True))
ORACLE["newest_datasets"] = (f"SELECT 1 AS place, 'export-dayfirst' AS name, count(*) AS row_count FROM ({ORACLE['cleaned_sales_dayfirst']}) a "
                             f"UNION ALL SELECT 2, 'export', count(*) FROM ({ORACLE['cleaned_sales']}) b")
ORACLE["catalog_counts"] = f"SELECT *, 2 AS total_datasets, 1 AS active_datasets FROM ({ORACLE['user_activity_counts']}) u"

ORACLE["required_columns"] = with_sales(" UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS required_column, {source} > 0 AS present, {source} AS value_count FROM raw"
    for i, (name, source) in enumerate([
        ("order_id", 'count("Order ID")'), ("customer_name", 'count("Customer Name")'), ("product", 'count("Product Name")'),
        ("category", 'count("Product Category")'), ("region", "0 * count(*)"), ("quantity", 'count("Quantity")'), ("revenue", 'count("Sales")'),
        ("payment_method", 'count("Payment Method")'), ("order_status", 'count("Order Status")'), ("order_date", 'count("Order Date")')])), *DIRTY)

ORACLE["insights_no_data"] = _insights_sql("order_date BETWEEN DATE '1890-01-01' AND DATE '1890-12-31'").replace(
    "SELECT category, CAST(ROW_NUMBER()", "SELECT 'Risk Alerts' AS category, 0 AS position, 'critical' AS severity, "
    "'No data available to generate insights.' AS text WHERE (SELECT count(*) FROM f) = 0\nUNION ALL "
    "SELECT category, CAST(ROW_NUMBER()").replace("FROM fired ORDER BY cat, ord", "FROM fired WHERE (SELECT count(*) FROM f) > 0")
ORACLE["insights_risks"] = _insights_sql(
    "order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND order_status IN ('Cancelled', 'Shipped', 'Pending') AND revenue >= 90000")

ORACLE["order_status_json"] = f"""
SELECT '{{"order_status":"' || order_status || '","count":' || count || '}}' AS json FROM ({ORACLE['order_status_counts']}) s"""

_REPORT_SALES = SALES[:-1] + f"  WHERE {REPORT_WHERE.replace('order_date', 'CAST(o.o_orderdate AS DATE)')}\n)"
ORACLE["exported_report"] = f"""
SELECT 'kpis' AS part, metric AS key, value FROM ({ORACLE['report_kpi_table'].replace(SALES, _REPORT_SALES)}) k
UNION ALL SELECT 'top_products', product, revenue_text FROM ({ORACLE['report_top_products'].replace(SALES, _REPORT_SALES)}) p
UNION ALL SELECT 'rows', region, n || ' / ' || q FROM (WITH {_REPORT_SALES}
  SELECT region, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS q FROM sales GROUP BY 1) r"""


# --- the whole dashboard -------------------------------------------------------

def _dashboard_sql(where: str | None = None) -> str:
    limited = SALES if where is None else SALES[:-1] + f"  WHERE {where}\n)"
    of = lambda name: "(" + ORACLE[name].replace(SALES, limited) + ")"

    def panel(name: str, source: str, position="NULL", key="NULL", key2="NULL", value="NULL", text="NULL") -> str:
        return (f"SELECT '{name}' AS panel, CAST({position} AS INTEGER) AS position, CAST({key} AS VARCHAR) AS key, "
                f"CAST({key2} AS VARCHAR) AS key2, CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text FROM {source} t")

    parts = [panel("kpis", of("kpis"), str(i), f"'{m}'", value="NULL" if m in _NAMES else m, text=m if m in _NAMES else "NULL")
             for i, m in enumerate(_METRICS)]
    parts += [
        panel("monthly_trend", of("monthly_revenue"), key="month", value="revenue"),
        panel("daily_trend", of("daily_revenue"), key="day", value="revenue"),
        panel("category_rev", of("revenue_by_category"), key="category", value="revenue"),
        panel("region_rev", of("revenue_by_region"), key="region", value="revenue"),
        panel("payment_methods", of("payment_method_counts"), key="payment_method", value="orders"),
        panel("order_status", of("order_status_counts"), key="order_status", value="count"),
        panel("top_products", f"(SELECT *, row_number() OVER (ORDER BY revenue DESC, product) AS r FROM {of('top_products')} p)", "r", "product", value="revenue"),
        panel("heatmap", of("region_category_matrix"), key="region", key2="category", value="revenue"),
        panel("filter_options", f"({ORACLE['filter_options']})", key="dimension", key2="value"),
        panel("date_presets", f"({ORACLE['date_presets']})", key="date_start", key2="date_end", text="label"),
        panel("insights", of("insights"), "position", "category", "severity", text="text"),
        panel("forecast_revenue", of("forecast"), key="period", value="predicted_revenue"),
        panel("forecast_product", of("forecast"), key="period", value="predicted_product_demand", text="top_product"),
        panel("forecast_category", of("forecast"), key="period", value="predicted_category_revenue", text="top_category"),
        panel("forecast_meta", of("forecast_confidence"), key="confidence", key2="has_enough_history", value="month_count", text="note"),
    ]
    return "\nUNION ALL ".join(parts)


ORACLE["dashboard"] = _dashboard_sql()
ORACLE["dashboard_1997"] = _dashboard_sql("o.o_orderdate >= DATE '1997-01-01' AND o.o_orderdate < DATE '1998-01-01'")
