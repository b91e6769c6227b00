"""The registered queries of the engine, each through a session: source registration, the SQL gate, lazy tables.

One text serves Spark and the oracle, unless their dialects differ.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from millrace import session_queries, snapshot_queries
from millrace.session import Session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name: query. Grouped as sources and projection, filters, subqueries, joins, aggregates, windows, order, sets, functions.
SQL: dict[str, str] = {
    "wide_export": """
        WITH item AS (
          SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS position
          FROM lineitem l),
        kept AS (SELECT * FROM item WHERE position = 1 OR l_returnflag IN ('R', 'A'))
        SELECT k.l_orderkey, k.l_linenumber, k.position, o.o_orderstatus, o.o_orderpriority, c.c_name, c.c_mktsegment, n.n_name, r.r_name,
               p.p_brand, p.p_type, s.s_name, k.l_quantity, k.l_extendedprice,
               k.l_extendedprice * (1 - k.l_discount) AS revenue,
               CASE WHEN k.l_returnflag = 'R' THEN 'returned' WHEN k.l_returnflag = 'A' THEN 'accepted' ELSE 'none' END AS return_state,
               CASE WHEN o.o_totalprice > 200000 THEN 3 WHEN o.o_totalprice > 100000 THEN 2 ELSE 1 END AS price_band
        FROM kept k JOIN orders o ON k.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
             LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
             LEFT JOIN part p ON k.l_partkey = p.p_partkey LEFT JOIN supplier s ON k.l_suppkey = s.s_suppkey""",
    "d3_literal": "SELECT 1 AS a, 'x' AS b, CAST(NULL AS bigint) AS c",
    "d4_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "d5_generate_series": "SELECT value AS n FROM generate_series(1, 20) AS g",
    "d7_project": "SELECT o.*, o_totalprice * 2 AS doubled FROM orders o",
    "d8_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus IN ('F', 'O') AND NOT o_totalprice < 1000) OR o_orderpriority IS NULL",
    "d9_in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "d10_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "d10_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "d10_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "d10_correlated": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice >= (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "d10_like_between": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%STEEL%' OR p_size BETWEEN 10 AND 15",
    "d11_cte_shadow": "WITH orders AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000) SELECT k FROM orders",
    "d12_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 30) SELECT n FROM t",
    "d13_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "d14_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "d15_left_conjunct": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "d16_anti_by_left": "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "d17_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "d17_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "d17_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "d17_natural_using": "SELECT r_regionkey, n FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1) x USING (r_regionkey)",
    "d17_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "d17_lateral": "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x",
    "d19_count": "SELECT count(*) AS n, count(o_orderpriority) AS m FROM orders",
    "d20_conditional_sum": "SELECT l_shipdate, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines FROM lineitem GROUP BY l_shipdate",
    "d21_count_distinct": "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey || '-' || l_suppkey) AS pairs, count(DISTINCT l_returnflag) AS flags FROM lineitem",
    "d22_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "d23_group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "d23_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag",
    "d23_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_discount), 6) AS cr, round(covar_samp(l_quantity, l_tax), 6) AS cv, round(regr_slope(l_tax, l_quantity), 8) AS sl FROM lineitem GROUP BY l_returnflag",
    "d23_median": "SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag",
    "d23_bool_bit": "SELECT p_brand, bool_and(p_size > 0) AS every_one, bool_or(p_size > 45) AS some, bit_or(p_size) AS bits, bit_and(p_size) AS common FROM part GROUP BY p_brand",
    "d23_min_max_by": "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS top, min_by(o_orderkey, o_totalprice) AS low FROM orders GROUP BY o_orderstatus",
    "d23_rollup": "SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "d23_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "d23_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "d24_top_of_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) x WHERE n = 1",
    "d25_ranks": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)",
    "d25_values": "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "d25_frames": "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS back FROM lineitem",
    "d27_order": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name ASC NULLS LAST",
    "d28_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
    "d29_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "d30_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "d30_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "d30_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "d31_empty": "SELECT o_orderkey FROM orders WHERE 1 = 0",
    "e1_arithmetic": "SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_linenumber % 2 - 1 AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem",
    "e3_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS bigint) AS b, o_orderdate >= date '1995-06-01' AS late FROM orders",
    "e4_case": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 15 THEN 'middle' ELSE 'small' END AS class FROM part",
    "e5_concat": "SELECT n_nationkey, n_name || ':' || n_regionkey AS label FROM nation",
    "e6_regexp_replace": "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '', 'g') AS t, length(p_type) AS n FROM part",
    "g_strings": "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, trim('  x ') AS t, lpad(c_mktsegment, 12, '*') AS p, substring(c_name, 3, 4) AS s, replace(c_name, '0', 'o') AS r, reverse(c_mktsegment) AS v, left(c_name, 3) AS a, repeat('ab', 2) AS d FROM customer",
    "g_dates": "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, date_trunc('month', o_orderdate) AS first_day, o_orderdate + INTERVAL '1' DAY AS next_day FROM orders",
    "g_math": "SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 8) AS s, round(ln(p_size + 1), 8) AS l, power(p_size, 2) AS q, sign(p_size - 20) AS g, round(exp(p_size / 50.0), 6) AS e FROM part",
    "g_conditional": "SELECT p_partkey, coalesce(nullif(p_size, 10), -1) AS c, greatest(p_size, 20) AS g, least(p_size, 20) AS l FROM part",
    "g_distinct_from": "SELECT p_partkey FROM part WHERE nullif(p_size, 10) IS DISTINCT FROM 20",
    "g_event_rollup": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
    "d10_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "d17_natural": "SELECT n_nationkey, n_name, n_regionkey FROM nation NATURAL JOIN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) x",
    "d17_semi": "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) o ON c_custkey = o_custkey",
    "d17_anti": "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) o ON c_custkey = o_custkey",
    "d17_range": "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_size BETWEEN s_nationkey AND s_nationkey + 1 AND p_partkey <= 200",
    "d17_hints": "SELECT /*+ MERGE(orders) */ o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "d23_collecting": "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, count(DISTINCT substring(n_name, 1, 1)) AS letters FROM nation GROUP BY n_regionkey",
    "d23_string_agg": "SELECT n_regionkey, string_agg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "d23_array_agg": "SELECT o_custkey, array_size(array_agg(o_orderkey)) AS n, sort_array(array_agg(o_orderkey))[0] AS least FROM orders GROUP BY o_custkey",
    "d23_more_statistics": "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(covar_pop(l_quantity, l_tax), 7) AS cp, regr_count(l_tax, l_quantity) AS rc, round(regr_intercept(l_tax, l_quantity), 8) AS ri, round(regr_r2(l_tax, l_quantity), 8) AS r2 FROM lineitem GROUP BY l_returnflag",
    "d23_percentile": "SELECT l_returnflag, percentile(l_quantity, 0.25) AS q1, percentile(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    "d23_distinct_sum": "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, count_if(l_quantity > 40) AS many, bit_xor(l_linenumber) AS x, any_value(l_returnflag) AS a FROM lineitem GROUP BY l_returnflag",
    "d23_approximate": "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS near, abs(percentile_approx(o_totalprice, 0.5, 10000) - median(o_totalprice)) <= 0.02 * median(o_totalprice) AS middle FROM orders",
    "d26_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "d26_qualify_alias": "SELECT n_regionkey, max(n) AS most FROM (SELECT n_regionkey, n_name, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS n FROM nation WHERE n_nationkey > 1 QUALIFY n <= 3 AND n_name <> 'qualify') x GROUP BY n_regionkey",
    "d30_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "d30_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 4",
    "e2_division": "SELECT p_partkey, p_size / 7 AS q, (p_size + 1) / (p_size / 3 + 1) AS n, p_size / 4.0D AS f, '/' AS s, p_retailprice / p_size AS u FROM part",
    "e1_whole_division": "SELECT p_partkey, p_size div 7 AS q, p_size % 7 AS r, p_size / 4.0D AS f FROM part",
    "e7_float_literal": "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS float) > 150000.5 AND o_totalprice <> 3.3",
    "e8_nested": "SELECT c_custkey, x.a AS a, x.b[1] AS b FROM (SELECT c_custkey, named_struct('a', c_nationkey, 'b', array(c_name, c_mktsegment)) AS x FROM customer) y",
    "e9_current": "SELECT current_date() >= date '2020-01-01' AS d, current_timestamp() IS NOT NULL AS t FROM region",
    "g_arrays": "SELECT n_nationkey, array_contains(a, 3) AS c, array_size(a) AS n, array_max(a) AS m, array_join(array_distinct(a), '-') AS d, element_at(a, 2) AS e, array_join(slice(a, 2, 2), ',') AS s, aggregate(a, 0L, (x, y) -> x + y) AS t, array_join(transform(a, x -> x * 2), ',') AS f, array_join(filter(a, x -> x > 2), ',') AS g FROM (SELECT n_nationkey, array(1L, n_nationkey, n_regionkey, 3L) AS a FROM nation) x",
    "g_array_sets": "SELECT n_nationkey, array_join(sort_array(array_union(a, b)), ',') AS u, array_join(sort_array(array_intersect(a, b)), ',') AS i, array_join(sort_array(array_except(a, b)), ',') AS e, arrays_overlap(a, b) AS o, array_position(a, 2) AS p FROM (SELECT n_nationkey, array(1, 2, n_regionkey) AS a, array(2, 4) AS b FROM nation) x",
    "g_explode": "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(1, n_regionkey + 1)) t AS x",
    "g_maps": "SELECT n_nationkey, m['name'] AS a, array_join(map_keys(m), ',') AS k, size(m) AS n, map_contains_key(m, 'none') AS c FROM (SELECT n_nationkey, map('name', n_name, 'region', CAST(n_regionkey AS string)) AS m FROM nation) x",
    "g_json": "SELECT n_nationkey, get_json_object(j, '$.name') AS name, CAST(get_json_object(j, '$.region') AS int) AS region, json_array_length('[1, 2, 3]') AS n, from_json(j, 'name string, region int').region + 1 AS next FROM (SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS j FROM nation) x",
    "g_hashes": "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, typeof(c_custkey) = 'bigint' AS t, try_cast(c_name AS int) IS NULL AS n FROM customer",
    "g_regex": "SELECT p_partkey, regexp_like(p_type, '^[A-Z]+ ') AS l, regexp_extract(p_type, '([A-Z]+)$', 1) AS e, regexp_replace(p_brand, '[0-9]', 'x') AS r, regexp_count(p_type, 'E') AS c, p_type RLIKE 'STEEL|TIN' AS k FROM part",
    "g_more_strings": "SELECT c_custkey, initcap('aB cd') AS i, concat_ws('-', c_mktsegment, 'x') AS w, split_part(c_name, '#', 2) AS p, rpad(c_mktsegment, 12, '.') AS r, right(c_name, 4) AS e, translate(c_mktsegment, 'ABC', 'abc') AS t, position('U' IN c_mktsegment) AS o, startswith(c_name, 'Cust') AS s, ascii(c_mktsegment) AS a, octet_length('é') AS b, c_mktsegment ILIKE 'b%' AS k, ltrim('  x') AS y, rtrim('x  ') AS z, contains(c_name, '1') AS v FROM customer",
    "g_more_dates": "SELECT o_orderkey, date_add(CAST(o_orderdate AS date), 5) AS a, datediff(CAST(o_orderdate AS date), date '1995-01-01') AS n, quarter(o_orderdate) AS q, last_day(CAST(o_orderdate AS date)) AS l, hour(o_orderdate) AS h, dayofyear(o_orderdate) AS y, weekofyear(o_orderdate) AS w, to_date('2020-02-03') AS t, date_format(o_orderdate, 'yyyy-MM') AS f, add_months(CAST(o_orderdate AS date), 1) AS m FROM orders",
    "g_more_math": "SELECT p_partkey, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(cbrt(p_size), 8) AS b, round(log10(p_size + 1), 8) AS l, round(sin(p_size), 8) AS s, round(atan2(p_size, 2), 8) AS t, round(degrees(1.0D), 8) AS d, pmod(-p_size, 7) AS m, factorial(5) AS k, round(pi(), 8) AS p, p_size & 7 AS x, p_size | 8 AS o, isnan(p_retailprice) AS n, round(log2(p_size + 1), 8) AS g FROM part",
    "g_more_conditional": "SELECT p_partkey, ifnull(nullif(p_size, 10), -1) AS i, nvl2(nullif(p_size, 10), 1, 0) AS n, if(p_size > 20, 'a', 'b') AS f, p_size <=> 10 AS e, try_divide(p_retailprice, 0) IS NULL AS t FROM part",
    "g_windows_more": "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(o_orderkey) OVER (PARTITION BY o_custkey) AS a, max(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders",
    "g_pivot": "SELECT * FROM (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem) PIVOT (count(n) FOR s IN ('O' AS open_lines, 'F' AS filled))",
    "g_subquery_select": "SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n, (SELECT max(n_name) FROM nation) AS top FROM region",
}

#: Where the oracle spells it otherwise.
ORACLE: dict[str, str] = {
    "d5_generate_series": "SELECT generate_series AS n FROM generate_series(1, 20)",
    "d11_cte_shadow": "WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000) SELECT k FROM o",
    "g_math": SQL["g_math"].replace("sign(p_size - 20)", "CAST(sign(p_size - 20) AS double)"),
    "d17_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
    "d17_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
    "d23_collecting": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT substring(n_name, 1, 1)) AS letters FROM nation GROUP BY n_regionkey",
    "d23_string_agg": "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "d23_array_agg": "SELECT o_custkey, count(*)::int AS n, min(o_orderkey) AS least FROM orders GROUP BY o_custkey",
    "d23_percentile": "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    "d23_approximate": "SELECT true AS near, true AS middle",
    "e2_division": "SELECT p_partkey, p_size / 7 AS q, (p_size + 1) / (p_size / 3 + 1) AS n, p_size / 4.0D AS f, '/' AS s, p_retailprice / p_size AS u FROM part",
    "e1_whole_division": "SELECT p_partkey, (p_size // 7)::bigint AS q, p_size % 7 AS r, p_size / 4.0 AS f FROM part",
    "e2_division": "SELECT p_partkey, (p_size // 7)::bigint AS q, ((p_size + 1) // (p_size // 3 + 1))::bigint AS n, p_size / 4.0 AS f, '/' AS s, p_retailprice / p_size AS u FROM part",
    "e8_nested": "SELECT c_custkey, c_nationkey AS a, c_mktsegment AS b FROM customer",
    "e9_current": "SELECT true AS d, true AS t FROM region",
    "g_arrays": "SELECT n_nationkey, list_contains(a, 3) AS c, len(a)::int AS n, list_max(a) AS m, array_to_string([x FOR x, i IN a IF list_position(a, x) = i], '-') AS d, a[2] AS e, array_to_string(a[2:3], ',') AS s, list_sum(a)::bigint AS t, array_to_string([x * 2 FOR x IN a], ',') AS f, array_to_string([x FOR x IN a IF x > 2], ',') AS g FROM (SELECT n_nationkey, [1::bigint, n_nationkey, n_regionkey, 3] AS a FROM nation) x",
    "g_array_sets": "SELECT n_nationkey, array_to_string(list_sort(list_distinct(a || b)), ',') AS u, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS i, array_to_string(list_sort(list_distinct([x FOR x IN a IF NOT list_contains(b, x)])), ',') AS e, list_has_any(a, b) AS o, list_position(a, 2)::bigint AS p FROM (SELECT n_nationkey, [1, 2, n_regionkey] AS a, [2, 4] AS b FROM nation) x",
    "g_explode": "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1))::int AS x FROM nation",
    "g_maps": "SELECT n_nationkey, n_name AS a, 'name,region' AS k, 2 AS n, false AS c FROM nation",
    "g_json": "SELECT n_nationkey, n_name AS name, n_regionkey AS region, 3 AS n, n_regionkey + 1 AS next FROM nation",
    "g_hashes": "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, true AS t, true AS n FROM customer",
    "g_regex": "SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+ ') AS l, regexp_extract(p_type, '([A-Z]+)$', 1) AS e, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r, length(p_type) - length(replace(p_type, 'E', '')) AS c, regexp_matches(p_type, 'STEEL|TIN') AS k FROM part",
    "g_more_strings": "SELECT c_custkey, 'Ab Cd' AS i, concat_ws('-', c_mktsegment, 'x') AS w, split_part(c_name, '#', 2) AS p, rpad(c_mktsegment, 12, '.') AS r, right(c_name, 4) AS e, translate(c_mktsegment, 'ABC', 'abc') AS t, position('U' IN c_mktsegment)::int AS o, starts_with(c_name, 'Cust') AS s, ascii(c_mktsegment) AS a, 2 AS b, c_mktsegment ILIKE 'b%' AS k, 'x' AS y, 'x' AS z, contains(c_name, '1') AS v FROM customer",
    "g_more_dates": "SELECT o_orderkey, o_orderdate::date + 5 AS a, (o_orderdate::date - date '1995-01-01')::int AS n, quarter(o_orderdate)::int AS q, last_day(o_orderdate::date) AS l, hour(o_orderdate)::int AS h, dayofyear(o_orderdate)::int AS y, weekofyear(o_orderdate)::int AS w, date '2020-02-03' AS t, strftime(o_orderdate, '%Y-%m') AS f, (o_orderdate::date + INTERVAL 1 MONTH)::date AS m FROM orders",
    "g_more_math": "SELECT p_partkey, ceil(p_retailprice)::bigint AS c, floor(p_retailprice)::bigint AS f, round(cbrt(p_size), 8) AS b, round(log10(p_size + 1), 8) AS l, round(sin(p_size), 8) AS s, round(atan2(p_size, 2), 8) AS t, round(degrees(1.0), 8) AS d, ((-p_size % 7) + 7) % 7 AS m, 120::bigint AS k, round(pi(), 8) AS p, p_size & 7 AS x, p_size | 8 AS o, isnan(p_retailprice) AS n, round(log2(p_size + 1), 8) AS g FROM part",
    "g_more_conditional": "SELECT p_partkey, ifnull(nullif(p_size, 10), -1) AS i, CASE WHEN p_size = 10 THEN 0 ELSE 1 END AS n, CASE WHEN p_size > 20 THEN 'a' ELSE 'b' END AS f, p_size IS NOT DISTINCT FROM 10 AS e, true AS t FROM part",
    "g_pivot": "SELECT l_returnflag AS f, nullif(count(l_linenumber) FILTER (WHERE l_linestatus = 'O'), 0) AS open_lines, nullif(count(l_linenumber) FILTER (WHERE l_linestatus = 'F'), 0) AS filled FROM lineitem GROUP BY 1",
    "d17_hints": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
}


def session(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> Session:
    """A session with the tables registered; each is read when a query does."""
    s = Session(spark)
    for name in tables:
        s.register(name, s.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return s


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if t in sql]
        return session(spark, sf_dir, used).table_from_sql(sql).df

    return run


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived tables on derived tables (A12, A14): revenue by nation over an alias that others share."""
    s = session(spark, sf_dir, ["orders", "customer", "nation"])
    s.table_from_sql("SELECT o.*, c_nationkey FROM orders o JOIN customer c ON o_custkey = c_custkey").alias("placed")
    s.table_from_sql("SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM placed GROUP BY c_nationkey").alias("by_nation")
    return s.table_from_sql("SELECT n_name, b.n, b.total FROM by_nation b JOIN nation ON c_nationkey = n_nationkey").df


def planned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column plans of a dry run (B5, B7, C12, C14) as rows."""
    s = session(spark, sf_dir, ["orders"])
    out = s.table_from_sql("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS date) AS o_date FROM orders").to_target("dbo", "orders", "create_and_load")
    columns = s.dry_run(out)["outputs"][0]["columns"]
    return spark.createDataFrame([(i, c["name"], c["type"]) for i, c in enumerate(columns)], "position int, name string, target string")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the user (E10, E11): scalar and aggregate ones over Arrow batches, and one that returns tables."""

    @pandas_udf("bigint")
    def odd(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    @pandas_udf("double")
    def total(x: pd.Series) -> float:
        return float(x.sum())

    class Twice:
        def eval(self, n: int):
            yield n, "first"
            yield n, "second"

    s = session(spark, sf_dir, ["nation"])
    s.register_function("odd", odd)
    s.register_function("total_of", total)
    s.register_function("twice", Twice, "n int, word string")
    s.table_from_sql("SELECT n_regionkey, total_of(odd(n_nationkey)) AS total FROM nation GROUP BY n_regionkey").alias("totals")
    s.table_from_sql("SELECT n_regionkey, count(t.word) AS words FROM nation, LATERAL twice(n_nationkey) t GROUP BY n_regionkey").alias("words")
    return s.table_from_sql("SELECT n_regionkey, total, words FROM totals JOIN words USING (n_regionkey)").df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sql) for name, sql in SQL.items()} | {"a14_layered": layered, "b7_planned_output": planned_output, "e10_functions": functions} | snapshot_queries.queries() | session_queries.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | ORACLE | snapshot_queries.oracle_sql() | session_queries.oracle_sql() | {
        "e10_functions": "SELECT n_regionkey, sum(n_nationkey * 2 + 1)::double AS total, count(*) * 2 AS words FROM nation GROUP BY n_regionkey",
        "a14_layered": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "b7_planned_output": "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_orderstatus', 'nvarchar(max)'), (2, 'o_totalprice', 'float'), (3, 'o_date', 'date')) t(position, name, target)",
    }
