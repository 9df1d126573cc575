"""SQL twins of the catalogue, written for DuckDB over the same tables."""

from __future__ import annotations

TX = """
tx AS (
  SELECT CAST(l_shipdate AS DATE) AS d,
         p_name || ' ' || p_brand AS descr,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END
              AS DECIMAL(18,2)) AS amt,
         CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'INR'
                     WHEN 'AFRICA' THEN 'GBP' WHEN 'MIDDLE EAST' THEN 'AUD' END AS cur,
         CASE WHEN p_name LIKE '%cold%' THEN 'Seasonal'
              WHEN p_name LIKE '%bolt%' OR p_name LIKE '%rod%' THEN 'Hardware'
              WHEN p_name LIKE '%gear%' OR p_name LIKE '%anvil%' THEN 'Machinery'
              WHEN p_name LIKE '%ring%' THEN 'Jewellery'
              WHEN p_name LIKE '%plate%' THEN 'Kitchen'
              ELSE 'Uncategorized' END AS cat
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
)"""

EV = """
ev AS (
  SELECT CAST(ts AS DATE) AS d, 'event ' || event_id AS descr,
         CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END * CAST(value AS DECIMAL(18,2)) AS amt,
         event_type AS cat
  FROM events
  UNION ALL
  SELECT CAST(max(ts) AS DATE), 'rare event', -CAST(max(value) AS DECIMAL(18,2)), 'rare' FROM events
  UNION ALL
  SELECT DATE '2024-01-15', 'flat ' || n_name,
         CAST(CASE WHEN n_name = 'NATION_24' THEN -99 ELSE -10 END AS DECIMAL(18,2)), 'flat'
  FROM nation
),
x AS (SELECT *, CAST(-amt AS DOUBLE) AS v, CAST(-amt * 100 AS BIGINT) AS c FROM ev WHERE amt < 0),
med AS (SELECT cat, 2 * median(c) AS m, stddev_samp(v) AS s, count(*) AS n FROM x GROUP BY cat),
mad AS (SELECT x.cat, 2 * median(abs(2 * c - m)) AS a FROM x JOIN med ON x.cat = med.cat GROUP BY x.cat),
gmed AS (SELECT 2 * median(c) AS m, stddev_samp(v) AS s FROM x),
gmad AS (SELECT 2 * median(abs(2 * c - m)) AS a FROM x, gmed),
st AS (
  SELECT med.cat,
         CASE WHEN n >= 3 THEN med.m ELSE gmed.m END AS m,
         CASE WHEN n >= 3 THEN mad.a ELSE gmad.a END AS a,
         CASE WHEN n >= 3 THEN med.s ELSE gmed.s END AS s
  FROM med JOIN mad ON med.cat = mad.cat, gmed, gmad
),
z AS (
  SELECT x.d, x.descr, x.amt, x.cat, x.v,
         CASE WHEN a <> 0 THEN CAST(0.6745 AS DOUBLE) * (2 * (2 * c - m)) / a
              WHEN s > 0 THEN (2 * c - m) / CAST(200 AS DOUBLE) / s ELSE 0 END AS z
  FROM x JOIN st ON x.cat = st.cat
)"""


def _rounded(value: str, places: int) -> str:
    """Round the decimal text of a double, half away from zero."""
    exact = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18))"
    return f"(CAST(round({exact}, {places}) AS DOUBLE) + 0.0)"


SQL: dict[str, str] = {}


def _tx(body: str) -> str:
    return f"WITH {TX} {body}"


def _last(months: int, scope: str = "tx") -> str:
    return f"d > (SELECT max(d) - INTERVAL {months} MONTH FROM {scope})"


LISTED = (
    'CAST(d AS VARCHAR) AS "Date", descr AS "Description", CAST(amt AS DOUBLE) AS "Amount", cat AS "Category"'
)

# Sources and cleaning

SQL["ingest_hdfc"] = """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date",
  'ORDER ' || o_custkey || CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN ''
                                ELSE ' | Ref: ' || o_orderkey END AS "Description",
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DOUBLE) AS "Amount",
  'INR' AS "Currency"
FROM orders"""

_GENERIC = """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date",
  o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS "Description",
  CAST(CASE WHEN o_orderstatus IN ('F', 'P') THEN o_totalprice ELSE -o_totalprice END AS DOUBLE) AS "Amount",
  'GBP' AS "Currency"
FROM orders"""
SQL["ingest_generic"] = _GENERIC

_RAW = """
raw AS (
  SELECT month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS pd,
         o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS memo,
         format('{:,.2f}', o_totalprice) AS price,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS plain,
         o_orderstatus AS st, o_orderpriority AS pr
  FROM orders
)"""
_SPELLED = """CASE st WHEN 'F' THEN '£' || price WHEN 'O' THEN price || ' dr'
              WHEN 'P' THEN ' $ ' || plain || 'CR ' ELSE '-' || plain END"""
SQL["dedupe_rows"] = f"WITH {_RAW} SELECT DISTINCT pd AS post_date, memo, {_SPELLED} AS amount FROM raw"
SQL["dedupe_removed"] = _tx(
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT d, descr, amt, cur FROM tx)) AS BIGINT)"
    " AS removed FROM tx"
)
SQL["keep_first"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_extendedprice, l_partkey) AS rn
  FROM lineitem) WHERE rn = 1"""
_DAMAGED = f"""{_RAW},
bad AS (
  SELECT DISTINCT CASE WHEN pr = '5-LOW' THEN '31/31/' || pd ELSE pd END AS raw_date, memo,
         CASE WHEN pr = '4-NOT SPECIFIED' THEN '(' || plain || ')' ELSE {_SPELLED} END AS raw_amount, pr
  FROM raw)"""
SQL["reject_counts"] = f"""WITH {_DAMAGED}
SELECT CASE WHEN pr = '5-LOW' THEN 'date' ELSE 'amount' END AS reject_reason, count(*) AS n
FROM bad WHERE pr IN ('5-LOW', '4-NOT SPECIFIED') GROUP BY 1"""
SQL["date_rejects"] = f"""WITH {_DAMAGED}
SELECT memo AS "Description", raw_date, 'GBP' AS "Currency" FROM bad WHERE pr = '5-LOW'"""
SQL["amount_rejects"] = f"""WITH {_DAMAGED}
SELECT memo AS "Description", raw_amount, 'GBP' AS "Currency" FROM bad WHERE pr = '4-NOT SPECIFIED'"""
SQL["accepted_rows"] = _GENERIC + " WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')"
# Card numbers are cut out as whole matches of a plain pattern; the last four digits are picked from the match.
SQL["mask_card_numbers"] = r"""
WITH c AS (SELECT doc_id, text,
    regexp_extract_all(text, '\b(?:[0-9]{4}[ \t\n\x0b\f\r-]?){3}[0-9]{0,4}\b') AS found,
    regexp_split_to_array(text, '\b(?:[0-9]{4}[ \t\n\x0b\f\r-]?){3}[0-9]{0,4}\b') AS rest FROM documents),
m AS (SELECT doc_id, text, list_transform(found, lambda x: '****' || right(regexp_replace(x, '[^0-9]', '', 'g'), 4)) AS put, rest FROM c),
w AS (SELECT doc_id, text, CASE WHEN len(put) = 0 THEN text ELSE
    list_aggregate(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || coalesce(put[i], '')), 'string_agg', '') END AS masked FROM m)
SELECT doc_id, masked, text <> masked AS changed FROM w"""

SQL["ingest_timestamps"] = """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date", 'order ' || o_orderkey AS "Description",
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS "Amount" FROM orders"""
SQL["csv_round_trip"] = f"""
WITH {TX}, u AS (SELECT DISTINCT d, descr, amt FROM tx)
SELECT strftime(d, '%Y-%m') AS month, count(*) AS rows, CAST(sum(amt) AS DOUBLE) AS total,
  max('Café "' || descr || '", etc.') AS last FROM u GROUP BY 1"""
SQL["rules_round_trip"] = """
WITH u AS (SELECT DISTINCT p_brand AS category, string_split(p_name, ' ')[-1] AS keyword FROM part)
SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS cat_order, keyword,
  CAST(row_number() OVER (PARTITION BY category ORDER BY keyword) - 1 AS INTEGER) AS kw_order FROM u"""
SQL["budgets_round_trip"] = """
SELECT p_brand AS category, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS budget FROM part GROUP BY 1"""

# Rules

SQL["classify_rules"] = _tx(f"SELECT {LISTED} FROM tx")
SQL["classify_long_rules"] = SQL["classify_rules"]
SQL["classify_coverage"] = _tx(
    "SELECT count(*) AS total, count(*) FILTER (cat <> 'Uncategorized') AS classified,"
    " count(*) FILTER (cat = 'Uncategorized') AS uncategorized FROM tx"
)
SQL["merged_rules"] = """
SELECT category, CAST(cat_order AS INTEGER) AS cat_order, keyword, CAST(kw_order AS INTEGER) AS kw_order
FROM (VALUES ('Seasonal', 0, 'cold', 0), ('Hardware', 1, 'bolt', 0), ('Hardware', 1, 'rod', 1),
             ('Machinery', 2, 'gear', 0), ('Machinery', 2, 'anvil', 1), ('Jewellery', 3, 'ring', 0),
             ('Kitchen', 4, 'plate', 0)) r(category, cat_order, keyword, kw_order)
UNION ALL
SELECT DISTINCT 'Widgets', 5, 'widget', 0 FROM part WHERE p_name LIKE '%widget%'"""
SQL["apply_corrections"] = _tx(
    """SELECT CAST(d AS VARCHAR) AS "Date", descr AS "Description", CAST(amt AS DOUBLE) AS "Amount",
    CASE WHEN cat <> 'Uncategorized' THEN cat WHEN descr LIKE '%widget%' THEN 'Widgets'
         WHEN descr LIKE '%gizmo Brand#1' THEN 'Gadgets' ELSE cat END AS "Category" FROM tx"""
)

# Totals

_IN = "CAST(coalesce(sum(amt) FILTER (amt > 0), 0) AS DOUBLE)"
_OUT = "CAST(coalesce(-sum(amt) FILTER (amt < 0), 0) AS DOUBLE)"
_NET = "CAST(coalesce(sum(amt), 0) AS DOUBLE)"
SQL["period"] = _tx(
    "SELECT CAST(min(d) AS VARCHAR) AS period_start, CAST(max(d) AS VARCHAR) AS period_end FROM tx"
)
SQL["summary_totals"] = _tx(f"SELECT {_IN} AS income, {_OUT} AS expenses, {_NET} AS net FROM tx")
SQL["cover_statistics"] = _tx(
    f"SELECT {_IN} AS income, {_OUT} AS expenses, {_NET} AS net, count(*) AS transactions,"
    " count(*) FILTER (cat = 'Uncategorized') AS uncategorized FROM tx"
)
_CATS = "SELECT cat AS category, CAST(sum(-amt) AS DOUBLE) AS total FROM tx WHERE amt < 0 GROUP BY cat"
SQL["category_totals"] = _tx(_CATS)
SQL["nq_categories"] = _tx(_CATS)
SQL["category_share"] = _tx(
    "SELECT category, total, round(total / (SELECT CAST(sum(-amt) AS DOUBLE) FROM tx WHERE amt < 0) * 100, 1)"
    f" AS pct_of_total FROM ({_CATS})"
)
SQL["top_merchants"] = _tx(
    "SELECT descr AS merchant, CAST(sum(-amt) AS DOUBLE) AS total, substr(descr, 1, 40) AS short_name"
    " FROM tx WHERE amt < 0 GROUP BY descr ORDER BY sum(-amt) DESC, descr LIMIT 10"
)
SQL["currency_totals"] = _tx(
    f"SELECT cur AS currency, {_IN} AS income, {_OUT} AS expenses, {_NET} AS net,"
    " CASE cur WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' WHEN 'INR' THEN '₹'"
    " WHEN 'AUD' THEN 'A$' END AS label FROM tx GROUP BY cur"
)
SQL["currency_codes"] = _tx(
    "SELECT string_agg(cur, ',' ORDER BY cur) AS codes, count(*) > 1 AS multi_currency,"
    " 'Mixed currencies' AS label FROM (SELECT DISTINCT cur FROM tx)"
)
SQL["monthly_totals"] = _tx(
    f"""SELECT strftime(d, '%Y-%m') AS "Month", {_OUT} AS "Expenses", {_IN} AS "Income"
    FROM tx WHERE amt <> 0 GROUP BY 1"""
)
_UNCAT = """SELECT CAST(d AS VARCHAR) AS "Date", descr AS "Description", CAST(amt AS DOUBLE) AS "Amount"
    FROM tx WHERE cat = 'Uncategorized'"""
SQL["uncategorized_rows"] = _tx(_UNCAT)
SQL["uncategorized_sample"] = _tx(_UNCAT + " ORDER BY d, descr, amt LIMIT 5")
_MONTHS = """,
m AS (SELECT cat, strftime(d, '%Y-%m') AS mon, CAST(sum(-amt) AS DOUBLE) AS t FROM tx WHERE amt < 0 GROUP BY 1, 2),
cm AS (SELECT max(mon) AS c FROM m),
pm AS (SELECT max(mon) AS p FROM m, cm WHERE mon < c),
mm AS (SELECT cat, c, p, coalesce(sum(t) FILTER (mon = c), 0) AS cur, coalesce(sum(t) FILTER (mon = p), 0) AS prev
       FROM m, cm, pm WHERE mon = c OR mon = p GROUP BY cat, c, p)"""
SQL["mom_comparison"] = _tx(
    _MONTHS
    + """ SELECT c AS current_month, p AS previous_month, cat AS category, cur AS current, prev AS previous,
    CAST(CAST(cur AS DECIMAL(18,2)) - CAST(prev AS DECIMAL(18,2)) AS DOUBLE) AS diff,
    CASE WHEN prev <> 0 THEN round((cur - prev) / prev * 100, 1) END AS pct_change FROM mm"""
)
SQL["full_summary"] = _tx(
    f""",
c AS (SELECT cat, sum(-amt) AS t FROM tx WHERE amt < 0 GROUP BY cat),
mer AS (SELECT descr, sum(-amt) AS t FROM tx WHERE amt < 0 GROUP BY descr ORDER BY t DESC, descr LIMIT 10),
cu AS (SELECT cur, sum(amt) AS net FROM tx GROUP BY cur)
SELECT CAST(min(d) AS VARCHAR) AS period_start, CAST(max(d) AS VARCHAR) AS period_end,
  {_IN} AS total_income, {_OUT} AS total_expenses, {_NET} AS net,
  count(*) FILTER (cat = 'Uncategorized') AS uncategorized_count,
  (SELECT string_agg(cat || '=' || t, '; ' ORDER BY t DESC, cat) FROM c) AS categories,
  (SELECT string_agg(descr || '=' || t, '; ' ORDER BY t DESC, descr) FROM mer) AS merchants,
  (SELECT string_agg(cur, ',' ORDER BY cur) FROM cu) AS currencies,
  (SELECT string_agg(cur || '=' || net, '; ' ORDER BY cur) FROM cu) AS currency_nets,
  CAST(least(5, count(*) FILTER (cat = 'Uncategorized')) AS BIGINT) AS sampled
FROM tx"""
)

SQL["summary_json"] = _tx(
    f"""SELECT CAST(min(d) AS VARCHAR) AS period_start, CAST(max(d) AS VARCHAR) AS period_end, {_IN} AS income,
    CAST(-sum(amt) FILTER (amt < 0 AND cat = 'Hardware') AS DOUBLE) AS hardware,
    CAST(-sum(amt) FILTER (amt < 0 AND cur = 'EUR') AS DOUBLE) AS eur_expenses,
    (SELECT descr FROM tx WHERE amt < 0 GROUP BY descr ORDER BY sum(-amt) DESC, descr LIMIT 1) AS first_merchant,
    count(*) FILTER (cat = 'Uncategorized') AS uncategorized FROM tx"""
)

# Recurring, anomalies, budgets


def _recurring(rows: str, least: int, tolerance: float) -> str:
    """``rows`` gives d, descr, amt, cat."""
    return f"""WITH {rows},
g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY descr ORDER BY d), d) AS gap FROM r),
p AS (SELECT descr, count(*) AS n, CAST(sum(amt) * 100 AS HUGEINT) AS cents, median(CAST(amt AS DOUBLE)) AS med,
        CAST(min(amt) AS DOUBLE) AS lo, CAST(max(amt) AS DOUBLE) AS hi, median(CAST(gap AS DOUBLE)) AS mg,
        min(d) AS f, max(d) AS l, count(DISTINCT d) AS days FROM g GROUP BY descr),
mode AS (SELECT descr, cat FROM (
   SELECT descr, cat, row_number() OVER (PARTITION BY descr ORDER BY count(*) DESC, cat) AS rn
   FROM r GROUP BY descr, cat) WHERE rn = 1)
SELECT p.descr AS "Description", mode.cat AS "Category",
  CAST((CASE WHEN cents < 0 THEN -1 ELSE 1 END) * ((2 * abs(cents) + n) // (2 * n)) AS DOUBLE) / 100 AS "Avg_Amount",
  round(mg, 1) AS "Median_Days",
  CASE WHEN mg BETWEEN 4 AND 10 THEN 'Weekly' WHEN mg BETWEEN 11 AND 18 THEN 'Biweekly'
       WHEN mg BETWEEN 25 AND 35 THEN 'Monthly' WHEN mg BETWEEN 85 AND 95 THEN 'Quarterly'
       WHEN mg BETWEEN 350 AND 380 THEN 'Annual' ELSE 'Irregular' END AS "Frequency",
  n AS "Occurrences", CAST(f AS VARCHAR) AS "First_Date", CAST(l AS VARCHAR) AS "Last_Date"
FROM p JOIN mode ON p.descr = mode.descr
WHERE n >= {least} AND days >= 2 AND (med = 0 OR greatest(hi - med, med - lo) / abs(med) <= {tolerance})"""


SQL["recurring_charges"] = _recurring(
    """r AS (SELECT CAST(l_shipdate AS DATE) AS d, p_name || ' #' || p_partkey AS descr,
    CAST(-p_retailprice AS DECIMAL(18,2)) AS amt, p_type AS cat
    FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    2,
    0.10,
)
SQL["recurring_wide_tolerance"] = _recurring(TX + ", r AS (SELECT d, descr, amt, cat FROM tx)", 3, 6.0)
SQL["mad_scores"] = f"WITH {EV} SELECT {LISTED}, {_rounded('z', 4)} AS z FROM z"
SQL["anomalies"] = f"""WITH {EV} SELECT {LISTED}, {_rounded('z', 2)} AS "Z_Score" FROM z WHERE z > 3.5"""
SQL["anomaly_scatter"] = f"""WITH {EV} SELECT CAST(d AS VARCHAR) AS "Date", substr(descr, 1, 35) AS short_name,
v AS magnitude, cat AS "Category", {_rounded('z', 2)} AS "Z_Score", z > 3.5 AS is_anomaly FROM z"""


def _budgets(values: str, months: str, warn: float) -> str:
    return _tx(
        f""",
b(category, budget) AS (VALUES {values}),
k AS (SELECT {months} AS n FROM tx),
t AS (SELECT category, CAST(budget AS DOUBLE) AS budget, n,
        coalesce((SELECT sum(-amt) FROM tx WHERE amt < 0 AND cat = category), 0) AS total FROM b, k)
SELECT category, budget,
  CAST((2 * CAST(total * 100 AS HUGEINT) + n) // (2 * n) AS DOUBLE) / 100 AS monthly_avg,
  round(CAST(total AS DOUBLE) / n / budget * 100, 2) AS pct_used,
  CASE WHEN CAST(total AS DOUBLE) / n / budget * 100 >= 100 THEN 'EXCEEDED'
       WHEN CAST(total AS DOUBLE) / n / budget * 100 >= {warn} * 100 THEN 'APPROACHING' ELSE 'OK' END AS status,
  CAST(n AS BIGINT) AS num_months
FROM t"""
    )


_SPAN = "(year(max(d)) - year(min(d))) * 12 + month(max(d)) - month(min(d)) + 1"
_BASE = "('Hardware', 6000000), ('Machinery', 5200000), ('Jewellery', 100), ('Garden', 50.5)"
SQL["budget_alerts"] = _budgets(_BASE, _SPAN, 0.80)
SQL["budget_vs_actual"] = _budgets(_BASE, "count(DISTINCT strftime(d, '%Y-%m'))", 0.80)
SQL["budget_override"] = _budgets(
    "('Hardware', 6000000), ('Machinery', 5200000), ('Jewellery', 9000000), ('Garden', 50.5),"
    " ('Seasonal', 4500000.75)",
    _SPAN,
    0.5,
)

# Named queries

SQL["nq_show"] = _tx(f"SELECT {LISTED} FROM tx WHERE {_last(6)} AND lower(cat) = 'jewellery'")
SQL["nq_top"] = _tx(f"SELECT {LISTED} FROM tx WHERE amt < 0 ORDER BY amt, d, descr LIMIT 25")
SQL["nq_top_category"] = _tx(
    f"SELECT {LISTED} FROM tx WHERE {_last(12)} AND cat = 'Kitchen' AND amt < 0 ORDER BY amt, d, descr LIMIT 10"
)
_SUM = "SELECT min(cat) AS category, CAST(sum(-amt) AS DOUBLE) AS total, count(*) AS transactions FROM "
SQL["nq_sum"] = _tx(_SUM + f"tx WHERE {_last(24)} AND cat = 'Hardware' AND amt < 0 HAVING count(*) > 0")
SQL["nq_average"] = _tx(
    """, m AS (SELECT strftime(d, '%Y-%m') AS mon, CAST(sum(-amt) * 100 AS HUGEINT) AS c
       FROM tx WHERE cat = 'Machinery' AND amt < 0 GROUP BY 1)
    SELECT 'Machinery' AS category, CAST((2 * sum(c) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS average,
      CAST(sum(c) AS DOUBLE) / 100 AS total, count(*) AS months FROM m HAVING count(*) > 0"""
)
SQL["nq_monthly"] = _tx(
    "SELECT strftime(d, '%Y-%m') AS month, CAST(sum(-amt) AS DOUBLE) AS total FROM tx"
    f" WHERE {_last(18)} AND cat = 'Seasonal' AND amt < 0 GROUP BY 1"
)
SQL["nq_biggest"] = _tx(
    f"SELECT {LISTED} FROM tx WHERE cat = 'Hardware' AND amt < 0 ORDER BY amt, d, descr LIMIT 1"
)
SQL["nq_compare"] = _tx(
    """, s AS (SELECT cat, coalesce(sum(-amt) FILTER (strftime(d, '%Y-%m') = '1998-02'), 0) AS a,
        coalesce(sum(-amt) FILTER (strftime(d, '%Y-%m') = '1998-12'), 0) AS b
        FROM tx WHERE amt < 0 AND strftime(d, '%Y-%m') IN ('1998-02', '1998-12') GROUP BY cat)
    SELECT cat AS category, CAST(a AS DOUBLE) AS month_a, CAST(b AS DOUBLE) AS month_b,
      CAST(b - a AS DOUBLE) AS diff FROM s"""
)
SQL["nq_search"] = _tx(
    f"SELECT {LISTED} FROM tx WHERE {_last(9)} AND contains(lower(descr), 'gizmo brand#1')"
)
SQL["nq_between"] = _tx(
    ", sc AS (SELECT * FROM tx WHERE d BETWEEN DATE '1997-03-15' AND DATE '1999-06-30') "
    + _SUM
    + f"sc WHERE {_last(3, 'sc')} AND cat = 'Jewellery' AND amt < 0 HAVING count(*) > 0"
)
SQL["nq_last_n"] = _tx(f"SELECT {LISTED} FROM tx WHERE {_last(3)}")
SQL["nq_catalogue"] = _tx(
    """SELECT (SELECT string_agg(cat, ',' ORDER BY cat) FROM (SELECT DISTINCT cat FROM tx)) AS categories,
    CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM tx"""
)

# Labelled history

SQL["training_set"] = _tx(
    """SELECT DISTINCT descr AS "Description", cat AS "Category" FROM tx WHERE cat <> 'Uncategorized'"""
)
SQL["stored_by_month"] = _tx(
    """SELECT strftime(d, '%Y-%m') AS month, cat AS "Category", CAST(sum(amt) AS DOUBLE) AS total,
    count(*) AS rows FROM tx WHERE amt < 0 GROUP BY 1, 2"""
)
SQL["stored_twice"] = _tx(
    "SELECT strftime(d, '%Y-%m') AS month, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS rows FROM tx GROUP BY 1"
)
SQL["classify_alike_rules"] = """
SELECT coalesce('nation ' || CAST(c_nationkey AS VARCHAR), 'Uncategorized') AS "Category", count(*) AS rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_custkey % 7 <> 0 GROUP BY 1"""
SQL["classify_repeated_category"] = _tx(
    """, c AS (SELECT amt, CASE WHEN lower(descr) LIKE '%cold%' THEN 'Frost' WHEN lower(descr) LIKE '%brand#1%' THEN 'Brand'
    WHEN lower(descr) LIKE '%ring%' OR lower(descr) LIKE '%gear%' THEN 'Frost' ELSE 'Uncategorized' END AS c FROM tx)
    SELECT way, c AS "Category", count(*) AS rows, CAST(sum(amt) AS DOUBLE) AS total
    FROM c, (VALUES ('inline'), ('joined')) w(way) GROUP BY 1, 2"""
)
SQL["ml_features"] = _tx(
    r""", t AS (SELECT DISTINCT descr FROM tx WHERE cat <> 'Uncategorized'),
    w AS (SELECT descr, ' ' || unnest(string_split_regex(lower(descr), '\s+')) || ' ' AS p FROM t),
    s AS (SELECT descr, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(n)),
    tf AS (SELECT descr, substr(p, i, n) AS gram, count(*) AS c FROM s GROUP BY ALL),
    df AS (SELECT gram, count(*) AS k FROM tf GROUP BY gram),
    x AS (SELECT descr, gram, c * (ln((1.0 + (SELECT count(*) FROM t)) / (1.0 + k)) + 1) AS v FROM tf JOIN df USING (gram))
    SELECT descr AS "Description", gram, round(v / sqrt(sum(v * v) OVER (PARTITION BY descr)), 6) AS weight FROM x"""
)
SQL["ml_optimum"] = "SELECT true AS flat"
SQL["ml_predict"] = _tx(
    """SELECT DISTINCT descr AS "Description", true AS same, true AS labelled_if_sure FROM tx WHERE cat = 'Uncategorized'"""
)
SQL["ml_two_stage"] = _tx(
    """SELECT CASE cat WHEN 'Uncategorized' THEN '(left to the model)' ELSE cat END AS settled, count(*) AS rows,
    0 AS odd_labels FROM tx GROUP BY 1"""
)
SQL["ml_retrain"] = _tx(
    """, t AS (SELECT DISTINCT descr, cat FROM tx WHERE cat <> 'Uncategorized')
    SELECT count(*) AS n_samples, (SELECT string_agg(cat, ',' ORDER BY cat) FROM (SELECT DISTINCT cat FROM t))
    AS classes, false AS stale FROM t"""
)

# Several banks, one format a source, versions, counts while writing

SQL["ingest_mixed_banks"] = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, * FROM orders),
r AS (
  SELECT 'statement' AS kind, 'INR' AS cur, d,
    'ORDER ' || o_custkey || CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '' ELSE ' | Ref: ' || o_orderkey END AS descr,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amt FROM o
  UNION ALL
  SELECT 'card', 'GBP', d, o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN o_totalprice ELSE -o_totalprice END FROM o
  UNION ALL
  SELECT 'plain', 'EUR', CAST(ts AS DATE), 'event ' || event_id, CAST(value AS DECIMAL(18,2)) FROM events
)
SELECT kind, cur AS "Currency", strftime(d, '%Y-%m') AS month, count(DISTINCT (descr, d, amt)) AS rows, max(descr) AS last
FROM r GROUP BY ALL"""
SQL["ingest_ambiguous_dates"] = """
WITH o AS (
  SELECT CAST(o_orderdate AS DATE) AS d, 'order ' || o_orderkey AS descr, o_custkey % 2 = 0 AS df,
    CASE WHEN o_custkey % 2 = 0 THEN 'day-' ELSE 'month-' END || (day(o_orderdate) // 4) AS src FROM orders),
w AS (SELECT *, CASE WHEN df THEN day(d) ELSE month(d) END AS one, CASE WHEN df THEN month(d) ELSE day(d) END AS two FROM o),
f AS (SELECT src, sum(CASE WHEN one > 12 THEN 1 ELSE 0 END) AS not_month_first, sum(CASE WHEN two > 12 THEN 1 ELSE 0 END) AS not_day_first
      FROM w GROUP BY src)
SELECT CAST(make_date(year(d), CASE WHEN not_month_first <= not_day_first THEN one ELSE two END,
            CASE WHEN not_month_first <= not_day_first THEN two ELSE one END) AS VARCHAR) AS "Date",
  descr AS "Description", src AS source_file FROM w JOIN f USING (src)"""
SQL["amounts_three_decimals"] = """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) / 10.0) AS DOUBLE) AS total, count(*) AS rows,
  CAST(count(*) FILTER (CAST(l_extendedprice AS DECIMAL(18,2)) * 100 % 10 <> 0) AS BIGINT) AS lost FROM lineitem"""
SQL["ingest_extra_columns"] = """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date",
  'ORDER ' || o_custkey || CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '' ELSE ' | Ref: ' || o_orderkey END AS "Description",
  strftime(CAST(o_orderdate AS DATE), '%d/%m/%y') AS value_date, '0' AS balance
FROM (SELECT DISTINCT o_orderdate, o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 0 ELSE o_orderkey END AS o_orderkey,
        CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '5-LOW' ELSE '' END AS o_orderpriority,
        o_orderstatus = 'F' AS paid_in, o_totalprice FROM orders)"""
SQL["explicit_mapping"] = """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date", CAST(o_orderkey AS VARCHAR) AS "Description",
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS "Amount", 'USD' AS "Currency" FROM orders"""
SQL["column_guards"] = """
SELECT name, rows, name || ': DataFrame is missing columns: [''Amount'', ''Date'', ''Description'']' AS message
FROM (SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem)"""
SQL["rejects_while_writing"] = f"""WITH {_DAMAGED},
n AS (SELECT count(*) FILTER (pr IN ('5-LOW', '4-NOT SPECIFIED')) AS rejected, count(*) FILTER (pr = '5-LOW') AS d,
        count(*) FILTER (pr = '4-NOT SPECIFIED') AS a, count(*) AS n FROM bad)
SELECT rejected, n - rejected AS clean, n - rejected AS uncategorized, n - rejected AS stored,
  'Cannot parse ' || rejected || ' row(s): {{''date'': ' || d || ', ''amount'': ' || a || '}}.' AS refused FROM n"""
SQL["stored_corrected"] = _tx(
    """SELECT strftime(d, '%Y-%m') AS tx_month, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS rows,
    count(DISTINCT amt < 0) AS sources FROM tx WHERE amt >= 0 OR month(d) <> 3 GROUP BY 1"""
)
SQL["coverage_while_writing"] = SQL["classify_coverage"]
SQL["recurring_view"] = f"""
WITH r AS ({SQL["recurring_charges"]})
SELECT substr("Description", 1, 40) AS short_name, "Category", abs("Avg_Amount") AS amount_per_cycle, "Frequency", "Occurrences", "Last_Date"
FROM r"""
SQL["report_files"] = _tx(
    f"""SELECT 'report_' || min(d) || '_to_' || max(d) AS folder,
    count(DISTINCT cat) FILTER (amt < 0) AS categories, {_OUT} AS expenses, count(*) AS transactions, CAST(4 AS BIGINT) AS budgets FROM tx"""
)
SQL["ml_guards"] = _tx(
    """SELECT 'few' AS name, CAST(least(19, count(DISTINCT (descr, cat))) AS VARCHAR) AS refused FROM tx WHERE cat <> 'Uncategorized'
    UNION ALL SELECT 'one class', '1'"""
)

SQL["ml_features_hashed"] = SQL["ml_features"]
SQL["mad_scores_incremental"] = SQL["mad_scores"]
SQL["sketched_months"] = _tx(
    """SELECT cat AS "Category", count(*) AS rows, true AS median_ok, true AS distinct_ok FROM tx WHERE amt < 0 GROUP BY cat"""
)
