"""The SQL surface: what a user may type, one query per relational operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans.sql import run_sql, table_profile
from gleaner.queries.common import load

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

# Statements both engines read alike.
_SHARED = {
    # R1
    "sql_project_distinct": """
SELECT DISTINCT o_orderstatus AS status, substring(o_orderpriority, 1, 1) AS prio, o_custkey % 10 AS bucket FROM orders""",
    # R2
    "sql_filter": """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'N') AND NOT (l_discount > 0.05 OR l_tax IS NULL)
  AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    # R3
    "sql_join_inner": """
SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name, r_name""",
    "sql_join_using": """
SELECT k, count(*) AS pairs FROM (SELECT o_custkey AS k, o_orderkey FROM orders) o
JOIN (SELECT c_custkey AS k, c_name FROM customer) c USING (k) GROUP BY k""",
    "sql_join_natural": """
SELECT k, n_name, supplier_count FROM (SELECT n_nationkey AS k, n_name FROM nation) n
NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS supplier_count FROM supplier GROUP BY s_nationkey) s""",
    # R4
    "sql_join_left": """
SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
    "sql_join_right": """
SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal < 0) s RIGHT JOIN nation ON s_nationkey = n_nationkey""",
    "sql_join_full": """
SELECT coalesce(a.k, b.k) AS k, a.n AS rich, b.n AS poor
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 1000 GROUP BY s_nationkey) b ON a.k = b.k""",
    # R5: a grid of two aggregated lists, filled from the facts
    "sql_join_cross": """
SELECT s.c_mktsegment AS segment, p.o_orderpriority AS priority, coalesce(f.n, 0) AS orders
FROM (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
LEFT JOIN (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
           GROUP BY c_mktsegment, o_orderpriority) f
  ON f.c_mktsegment = s.c_mktsegment AND f.o_orderpriority = p.o_orderpriority""",
    # R6: bands from a five-row table
    "sql_join_theta": """
SELECT b.band, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN (SELECT r_regionkey AS band, r_regionkey * 100000 AS low, (r_regionkey + 1) * 100000 AS high FROM region) b
  ON o.o_totalprice >= b.low AND o.o_totalprice < b.high
GROUP BY b.band""",
    # R7
    "sql_join_semi": """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
  AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)""",
    # R8
    "sql_join_anti": """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "sql_not_in": """
SELECT n_nationkey, n_name FROM nation
WHERE n_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000 AND s_nationkey IS NOT NULL)""",
    # R9
    "sql_join_self": """
SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS next_line, round(b.l_quantity - a.l_quantity, 2) AS change
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    # R10
    "sql_agg_group": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price,
  min(l_discount) AS lowest, max(l_tax) AS highest, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    # R11
    "sql_agg_distinct": """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS key_sum
FROM orders GROUP BY o_orderpriority""",
    # R12
    "sql_agg_filter": """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  round(sum(value) FILTER (WHERE event_type <> 'error'), 2) AS good_value FROM events GROUP BY user_id""",
    # R13
    "sql_agg_total": """
SELECT n_name, coalesce(round(sum(s_acctbal), 2), 0.0) AS total
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name""",
    # R15
    "sql_having": """
SELECT o_custkey, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders
GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 300000""",
    # R16
    "sql_window_rank": """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk,
  CAST(dense_rank() OVER v AS BIGINT) AS dr FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""",
    # R17
    "sql_window_distribution": """
SELECT o_custkey, o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
  CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    # R18
    "sql_window_lag_lead": """
SELECT user_id, event_id, round(value - lag(value, 1, 0.0) OVER w, 4) AS change, lead(event_type) OVER w AS next_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    # R19
    "sql_window_first_last": """
SELECT l_orderkey, l_linenumber, l_partkey, first_value(l_partkey) OVER w AS first_part, last_value(l_partkey) OVER w AS last_part,
  nth_value(l_partkey, 2) OVER w AS second_part
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    # R20
    "sql_window_rows": """
SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
FROM events""",
    # R21
    "sql_window_range": """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (
    PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders""",
    # R23
    "sql_union_all": """
SELECT c_nationkey AS k, 'c' AS kind, c_acctbal AS balance FROM customer
UNION ALL SELECT s_nationkey, 's', s_acctbal FROM supplier""",
    "sql_union": """
SELECT c_nationkey AS k, c_acctbal > 0 AS positive FROM customer UNION SELECT s_nationkey, s_acctbal > 0 FROM supplier""",
    # R24
    "sql_intersect": """
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    # R25
    "sql_except": """
(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000)
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    # R26
    "sql_order_nulls": """
SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment ASC NULLS FIRST, c_custkey DESC""",
    # R27: a top-k report with an offset
    "sql_order_limit": """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5""",
    # R28
    "sql_subquery_scalar": """
SELECT o_orderkey, o_totalprice, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)""",
    # R29
    "sql_subquery_correlated": """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders o
WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    # R30
    "sql_cte": """
WITH per_part AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey),
     brands AS (SELECT p_brand, round(sum(qty), 2) AS qty, count(*) AS parts FROM per_part JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT p_brand, qty, parts FROM brands WHERE qty > (SELECT avg(qty) FROM brands)""",
    # R31: days from the first event, one month of buckets joined to the facts
    "sql_recursive": """
WITH RECURSIVE steps(n) AS (SELECT 0 AS n UNION ALL SELECT n + 1 FROM steps WHERE n < 30)
SELECT n, count(e.event_id) AS events, round(coalesce(sum(e.value), 0), 2) AS total
FROM steps LEFT JOIN events e ON CAST(e.user_id % 31 AS INT) = n GROUP BY n""",
    # R32
    "sql_values": """
SELECT v.label, count(*) AS orders FROM orders
JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) AS v(code, label) ON o_orderstatus = v.code GROUP BY v.label""",
    # R33
    "sql_scalar_null": """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
  nullif(p_type, 'SMALL') AS type_or_null, coalesce(nullif(p_type, 'SMALL'), p_brand) AS either,
  ifnull(nullif(p_size, 11), -1) AS size_or, if(p_retailprice > 950, 1, 0) AS dear FROM part""",
    # R34
    "sql_scalar_cast": """
SELECT p_partkey, TRY_CAST(p_name AS INT) AS garbage, TRY_CAST(substring(p_brand, 7, 3) AS BIGINT) AS brand_no,
  CAST(p_size AS STRING) AS size_text, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part""",
}

# Statements whose spelling differs: (for Spark, for the twin).
_PAIRS = {
    # R14
    "sql_agg_group_concat": (
        "SELECT l_orderkey, listagg(CAST(l_partkey AS STRING), ';') WITHIN GROUP (ORDER BY l_linenumber, l_partkey) AS parts "
        "FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey",
    ),
    # R22: groups frame as a range over the dense rank
    "sql_window_groups": (
        """
SELECT l_orderkey, l_linenumber, g, round(sum(l_quantity) OVER (
    PARTITION BY l_orderkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS qty
FROM (SELECT l_orderkey, l_linenumber, l_quantity,
             CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS g FROM lineitem)""",
        """
SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g,
  round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS qty
FROM lineitem""",
    ),
    # R35
    "sql_scalar_string": (
        """
SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, upper(p_name) AS u, lower(p_brand) AS l, trim(concat('  ', p_type, ' ')) AS t,
  replace(p_brand, '#', '-') AS r, CAST(instr(p_name, 'r') AS BIGINT) AS at_r, substr(p_name, 2, 3) AS s, p_type || '/' || p_brand AS c,
  concat_ws('|', p_name, p_type) AS w, hex(p_brand) AS h, CAST(ascii(p_name) AS BIGINT) AS a, char(65 + p_size % 26) AS ch,
  format_string('%05d:%s', p_size, p_type) AS f, ltrim(concat(' ', p_name)) AS lt, rtrim(concat(p_name, ' ')) AS rt FROM part""",
        """
SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_type || ' ') AS t,
  replace(p_brand, '#', '-') AS r, instr(p_name, 'r') AS at_r, substr(p_name, 2, 3) AS s, p_type || '/' || p_brand AS c,
  concat_ws('|', p_name, p_type) AS w, hex(p_brand) AS h, ascii(p_name)::BIGINT AS a, chr(65 + p_size % 26) AS ch,
  printf('%05d:%s', p_size, p_type) AS f, ltrim(' ' || p_name) AS lt, rtrim(p_name || ' ') AS rt FROM part""",
    ),
    # R36
    "sql_scalar_pattern": (
        "SELECT p_partkey, p_name ILIKE '%RED%' AS has_red, p_brand RLIKE '^Brand#1[0-9]?$' AS brand_one, p_name LIKE '_l%' AS second_l FROM part",
        "SELECT p_partkey, p_name ILIKE '%RED%' AS has_red, p_brand GLOB 'Brand#1' OR p_brand GLOB 'Brand#1[0-9]' AS brand_one, "
        "p_name LIKE '_l%' AS second_l FROM part",
    ),
    # R37
    "sql_scalar_math": (
        """
SELECT o_orderkey, abs(o_orderkey - 500) AS a, round(o_totalprice, 1) AS r, CAST(sign(o_orderkey - 500) AS BIGINT) AS sg,
  least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi, mod(o_orderkey, 7) AS m, round(pow(o_custkey, 2), 3) AS p,
  round(sqrt(o_totalprice), 6) AS sq, round(exp(o_orderkey % 5), 6) AS e, round(ln(o_totalprice), 6) AS l, round(log10(o_totalprice), 6) AS l10,
  CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, round(sin(o_orderkey % 10), 6) AS s, round(pi(), 6) AS pi,
  o_orderkey div 7 AS whole, round(try_divide(o_totalprice, o_orderkey % 4), 4) AS safe FROM orders""",
        """
SELECT o_orderkey, abs(o_orderkey - 500) AS a, round(o_totalprice, 1) AS r, sign(o_orderkey - 500)::BIGINT AS sg,
  least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi, o_orderkey % 7 AS m, round(pow(o_custkey, 2), 3) AS p,
  round(sqrt(o_totalprice), 6) AS sq, round(exp(o_orderkey % 5), 6) AS e, round(ln(o_totalprice), 6) AS l, round(log10(o_totalprice), 6) AS l10,
  ceil(o_totalprice)::BIGINT AS c, floor(o_totalprice)::BIGINT AS f, round(sin(o_orderkey % 10), 6) AS s, round(pi(), 6) AS pi,
  o_orderkey // 7 AS whole, round(o_totalprice / nullif(o_orderkey % 4, 0), 4) AS safe FROM orders""",
    ),
    # R38
    "sql_scalar_date": (
        """
SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS d, date_format(ts, 'HH:mm:ss') AS t, CAST(hour(ts) AS BIGINT) AS h,
  CAST(dayofyear(ts) AS BIGINT) AS doy, date_format(date_add(to_date(ts), 7), 'yyyy-MM-dd') AS week_later,
  CAST(datediff(to_date(ts), DATE '2024-01-01') AS BIGINT) AS age, date_format(date_trunc('MONTH', ts), 'yyyy-MM-dd') AS month FROM events""",
        """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, hour(ts) AS h, dayofyear(ts) AS doy,
  strftime(ts::DATE + 7, '%Y-%m-%d') AS week_later, date_diff('day', DATE '2024-01-01', ts::DATE) AS age,
  strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM events""",
    ),
    # R39
    "sql_scalar_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS absent FROM events",
        "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.none' AS absent FROM events",
    ),
    # R40
    "sql_json_each": (
        "SELECT key, count(*) AS n, sum(CAST(value AS BIGINT)) AS total FROM (SELECT explode(from_json(props, 'map<string,string>')) "
        "AS (key, value) FROM events) GROUP BY key",
        "SELECT key, count(*) AS n, sum(json_extract_string(props, '$.' || key)::BIGINT)::BIGINT AS total FROM "
        "(SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    ),
    # Q5: names that users bring along
    "sql_dialect_string": (
        """
SELECT p_partkey, glob('*red*', p_name) AS has_red, glob('Brand#[1-3]', p_brand) AS low_brand, glob('?l*', p_name) AS second_l, glob('[^a-m]*', p_name) AS late,
  iif(p_size > 25, 'big', p_type) AS kind, iif(p_size > 25, p_size, 0) AS size_or_0, unicode(p_name) AS first_code,
  max(p_size, 10, p_partkey % 40) AS most, min(p_retailprice, nullif(p_size, 7)) AS least FROM part""",
        """
SELECT p_partkey, p_name GLOB '*red*' AS has_red, p_brand GLOB 'Brand#[1-3]' AS low_brand, p_name GLOB '?l*' AS second_l, NOT p_name GLOB '[a-m]*' AS late,
  CASE WHEN p_size > 25 THEN 'big' ELSE p_type END AS kind, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS size_or_0,
  unicode(p_name) AS first_code,
  greatest(p_size, 10, p_partkey % 40) AS most, CASE WHEN p_size <> 7 THEN least(p_retailprice, p_size) END AS least FROM part""",
    ),
    "sql_dialect_date": (
        """
SELECT event_id, strftime('%Y/%m week %W day %j, %H:%M:%S %%', ts) AS said, strftime('%w-%u-%s', ts) AS numbers, date(ts, '+1 day') AS tomorrow,
  date(ts, '-2 months') AS before, date(ts, 'start of month', '+1 month', '-1 day') AS month_end, time(ts, '+90 minutes') AS later,
  datetime(ts, 'start of year', '+3.5 hours') AS new_year, date(ts, 'weekday 1') AS monday, round(julianday(ts), 4) AS julian, unixepoch(ts) AS seconds,
  datetime(unixepoch(ts), 'unixepoch') AS back, julianday('2024-03-01') - julianday('2024-02-01') AS days FROM events""",
        """
SELECT event_id, strftime(ts, '%Y/%m week %W day %j, %H:%M:%S %%') AS said,
  dayofweek(ts) || '-' || isodow(ts) || '-' || epoch(date_trunc('second', ts))::BIGINT AS numbers, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS tomorrow,
  strftime(date_trunc('month', ts) - INTERVAL 2 MONTH + (ts - date_trunc('month', ts)), '%Y-%m-%d') AS before,
  strftime(last_day(ts), '%Y-%m-%d') AS month_end, strftime(ts + INTERVAL 90 MINUTE, '%H:%M:%S') AS later,
  strftime(date_trunc('year', ts) + INTERVAL 210 MINUTE, '%Y-%m-%d %H:%M:%S') AS new_year,
  strftime(ts + to_days(((8 - dayofweek(ts)) % 7)::INT), '%Y-%m-%d') AS monday, round(epoch_us(ts) / 86400000000 + 2440587.5, 4) AS julian,
  epoch(date_trunc('second', ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back, 29.0::DOUBLE AS days FROM events""",
    ),
    "sql_dialect_json": (
        """
SELECT event_id, e.key, e.value, e.type, json_extract(props, '$.' || e.key) AS again, json_valid(props) AS good, json_valid(props || '}') AS bad,
  json_type(props) AS kind FROM events, LATERAL json_each(props) AS e""",
        """
SELECT event_id, key, props->>('$.' || key) AS value, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'real' ELSE 'integer' END AS type,
  props->>('$.' || key) AS again, json_valid(props) AS good, json_valid(props || '}') AS bad, lower(json_type(props)) AS kind
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    ),
    "sql_dialect_aggregate": (
        """
SELECT l_orderkey, total(l_partkey) AS parts, total(l_partkey) FILTER (WHERE l_quantity > 45) AS large_parts,
  group_concat(l_linenumber, '; ' ORDER BY l_linenumber DESC) AS lines, group_concat(DISTINCT l_returnflag ORDER BY l_returnflag) AS flags,
  group_concat(nullif(l_linestatus, l_linestatus)) AS nothing, max(max(l_partkey), 1000) AS most, iif(total(l_linenumber) > 10, 'long', 'short') AS size
FROM lineitem GROUP BY l_orderkey""",
        """
SELECT l_orderkey, sum(l_partkey)::DOUBLE AS parts, coalesce(sum(l_partkey) FILTER (l_quantity > 45), 0)::DOUBLE AS large_parts,
  string_agg(l_linenumber::VARCHAR, '; ' ORDER BY l_linenumber DESC) AS lines, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
  NULL::VARCHAR AS nothing, greatest(max(l_partkey), 1000) AS most, CASE WHEN sum(l_linenumber) > 10 THEN 'long' ELSE 'short' END AS size
FROM lineitem GROUP BY l_orderkey""",
    ),
    "sql_json_group": (
        "SELECT l_orderkey, to_json(array_sort(collect_list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, to_json(list(l_partkey ORDER BY l_partkey))::VARCHAR AS parts FROM lineitem GROUP BY l_orderkey",
    ),
}


def _register(spark, root) -> None:
    for name in _TABLES:
        load(spark, root, name).createOrReplaceTempView(name)


def _statement(text: str):
    def run(spark, root):
        _register(spark, root)
        return run_sql(spark, text, rows=None)

    return run


def sql_limited(spark, root):
    """The fetch cap of the typed-SQL feature: 50 rows of an ordered result."""
    _register(spark, root)
    return run_sql(spark, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")


def table_profile_query(spark, root):
    names = ("nation", "orders", "lineitem")
    profile = table_profile({n: load(spark, root, n) for n in names})
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return profile.select("table_name", "column", F.coalesce(known[F.col("type")], "type").alias("type"), "rows")


QUERIES = {name: _statement(text) for name, text in _SHARED.items()}
QUERIES |= {name: _statement(pair[0]) for name, pair in _PAIRS.items()}
QUERIES |= {"sql_limited": sql_limited, "table_profile": table_profile_query}

ORACLES = dict(_SHARED)
ORACLES |= {name: pair[1] for name, pair in _PAIRS.items()}
ORACLES |= {
    "sql_limited": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50",
    "table_profile": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, column_name AS \"column\", data_type AS type, (SELECT count(*) FROM {n}) AS rows "
        f"FROM duckdb_columns() WHERE table_name = '{n}'"
        for n in ("nation", "orders", "lineitem")
    ),
}
