"""Queries over the star-schema graph: the query text, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import star_graph
from . import compile as C

#: name: (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "match_scan": ("MATCH (n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation"),
    "label_and_inline": ("MATCH (c:Customer {c_mktsegment:'BUILDING'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "one_hop": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS segment, count(*) AS orders, round(sum(o.o_totalprice)) AS total ORDER BY total DESC",
        "SELECT c_mktsegment AS segment, count(*) AS orders, CAST(floor(sum(o_totalprice) + 0.5) AS BIGINT) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "incoming": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, count(n) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"),
    "undirected": ("MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "alternation": ("MATCH (s:Supplier)<-[:SUPPLIED_BY|OF]-(x) RETURN s.s_name AS s, count(*) AS c", "SELECT s_name AS s, count(*) AS c FROM supplier JOIN (SELECT l_suppkey FROM lineitem UNION ALL SELECT l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) ON s_suppkey = l_suppkey GROUP BY 1"),
    "two_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN r.r_name AS r, count(c) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "comma_pattern": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN id(n) AS n, count(*) AS pairs", "SELECT 'Nation:' || c_nationkey AS n, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1"),
    "rel_uniqueness": (
        "MATCH (a:Supplier)-[:IN_NATION]->(n)<-[:IN_NATION]-(b:Supplier) RETURN id(n) AS n, count(*) AS pairs",
        "SELECT 'Nation:' || a.s_nationkey AS n, count(*) AS pairs FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1",
    ),
    "two_match_reuse": ("MATCH (a:Supplier)-[r1:IN_NATION]->(n) MATCH (b:Supplier)-[r2:IN_NATION]->(n) RETURN count(*) AS pairs", "SELECT count(*) AS pairs FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey"),
    "parallel_edges": (
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WITH o, p, count(r) AS k WHERE k > 1 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)",
    ),
    "edge_ids": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN count(DISTINCT r) AS n, count(DISTINCT id(r)) AS ids", "SELECT count(*) AS n, count(*) AS ids FROM lineitem"),
    "sign_filter": ("MATCH (o)-[r:CONTAINS]->(p) WHERE r.sign = -1 RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "explicit_positive": ("MATCH (u:User)-[r:DID]->(e) WHERE r.sign = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM events WHERE event_type <> 'error'"),
    "stubs": ("MATCH (n) WHERE n.stub = true RETURN count(n) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE p_size > 25"),
    "not_stubs": (
        "MATCH (n) WHERE NOT n.stub RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part WHERE p_size <= 25) + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) AS n",
    ),
    "stub_edges": ("MATCH (o:Order)-[r:CONTAINS]->(p) WHERE p.stub RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25"),
    "multi_label": ("MATCH (e:Event:click) RETURN count(*) AS n, size(labels(e)) AS k", "SELECT count(*) AS n, 2 AS k FROM events WHERE event_type = 'click'"),
    "label_predicate": ("MATCH (u:User)-[:DID]->(e) WHERE e:purchase RETURN count(*) AS n", "SELECT count(*) AS n FROM events WHERE event_type = 'purchase'"),
    "inline_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o {o_orderstatus:null}) RETURN c.c_mktsegment AS s, count(c) AS n, count(o) AS k", "SELECT c_mktsegment AS s, count(*) AS n, 0 AS k FROM customer GROUP BY 1"),
    "missing_type": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:NOWHERE]->(b) RETURN c.c_mktsegment AS s, count(c) AS n, count(b) AS k", "SELECT c_mktsegment AS s, count(*) AS n, 0 AS k FROM customer GROUP BY 1"),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1",
    ),
    "anti_via_optional": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c, o WHERE o IS NULL RETURN count(c) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 5 RETURN count(*) AS c", "SELECT count(*) AS c FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 5)"),
    "with_topk_then_match": (
        "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o) RETURN c.c_custkey AS k, count(*) AS n",
        "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) GROUP BY 1",
    ),
    "distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 5 LIMIT 7", "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 7 OFFSET 5"),
    "order_nulls": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier {s_suppkey: 3}) WITH n, s.s_name AS s ORDER BY s DESC, n.n_nationkey LIMIT 3 RETURN n.n_nationkey AS k, s AS s",
        "SELECT n_nationkey AS k, s_name AS s FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey = 3) ON n_nationkey = s_nationkey ORDER BY s_name DESC NULLS FIRST, n_nationkey LIMIT 3",
    ),
    "agg_all": (
        "MATCH (c:Customer) RETURN count(*) AS n, round(sum(c.c_acctbal)) AS s, round(avg(c.c_acctbal)) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, size(collect(c.c_name)) AS k",
        "SELECT count(*) AS n, CAST(floor(sum(c_acctbal) + 0.5) AS BIGINT) AS s, CAST(floor(avg(c_acctbal) + 0.5) AS BIGINT) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_name) AS k FROM customer",
    ),
    "agg_empty": ("MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, size(collect(c.c_name)) AS k", "SELECT 0 AS n, CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a, 0 AS k"),
    "agg_distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN count(DISTINCT n) AS n, count(DISTINCT c.c_mktsegment) AS s, size(collect(DISTINCT c.c_mktsegment)) AS k", "SELECT count(DISTINCT c_nationkey) AS n, count(DISTINCT c_mktsegment) AS s, count(DISTINCT c_mktsegment) AS k FROM customer"),
    "agg_mixed": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, c.c_mktsegment + ':' + count(*) AS t", "SELECT c_mktsegment AS s, c_mktsegment || ':' || count(*) AS t FROM customer GROUP BY 1"),
    "order_by_aggregate": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.n_nationkey AS k ORDER BY count(*) DESC, k LIMIT 5", "SELECT c_nationkey AS k FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5"),
    "var_length_bounded": (
        "MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..3]->(x) RETURN id(x) AS id, count(*) AS n",
        "SELECT 'Nation:' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'Region:' || n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "var_length_exact": ("MATCH (c:Customer)-[:IN_NATION|IN_REGION*2]->(x) RETURN x.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "var_length_zero": ("MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM nation"),
    "var_length_trail": (
        "MATCH (a:Nation)-[r:IN_REGION*1..4]-(b) RETURN size(r) AS k, count(*) AS n",
        """WITH RECURSIVE e AS (SELECT n_nationkey AS i, 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS t FROM nation),
        b AS (SELECT i, s, t FROM e UNION ALL SELECT i, t, s FROM e),
        w(pos, used, k) AS (SELECT t, [i], 1 FROM b WHERE starts_with(s, 'Nation:') UNION ALL SELECT b.t, list_append(w.used, b.i), w.k + 1 FROM w JOIN b ON b.s = w.pos WHERE w.k < 4 AND NOT list_contains(w.used, b.i))
        SELECT k, count(*) AS n FROM w GROUP BY k""",
    ),
    "path_functions": (
        "MATCH p = (c:Customer)-[:IN_NATION]->()-[:IN_REGION]->() RETURN length(p) AS l, size(nodes(p)) AS n, size(relationships(p)) AS r, count(*) AS c",
        "SELECT 2 AS l, 3 AS n, 2 AS r, count(*) AS c FROM customer",
    ),
    "expand_from_few": (
        "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o)-[r:CONTAINS]->(p) RETURN c.c_custkey AS k, count(*) AS n, round(sum(r.l_quantity)) AS q, count(DISTINCT p) AS parts",
        "SELECT o_custkey AS k, count(*) AS n, CAST(floor(sum(l_quantity) + 0.5) AS BIGINT) AS q, count(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) GROUP BY 1",
    ),
    "var_length_deep": (
        "MATCH (a:Nation)-[r:IN_NATION|IN_REGION*1..6]-(b) RETURN size(r) AS k, count(*) AS n",
        """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS i, 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS t FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier),
        b AS (SELECT i, s, t FROM e UNION ALL SELECT i, t, s FROM e),
        w(pos, used, k) AS (SELECT t, [i], 1 FROM b WHERE starts_with(s, 'Nation:') UNION ALL SELECT b.t, list_append(w.used, b.i), w.k + 1 FROM w JOIN b ON b.s = w.pos WHERE w.k < 6 AND NOT list_contains(w.used, b.i))
        SELECT k, count(*) AS n FROM w GROUP BY k""",
    ),
    "path_elements": (
        "MATCH p = (c:Customer)-[:IN_NATION]->()-[:IN_REGION]->() RETURN nodes(p)[1].n_name AS n, last(nodes(p)).r_name AS r, nodes(p)[5].r_name AS none, count(*) AS k",
        "SELECT n_name AS n, r_name AS r, CAST(NULL AS VARCHAR) AS none, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    ),
    "rel_elements": (
        "MATCH (c:Customer)-[r:PLACED|CONTAINS*2]->(p) RETURN r[1].l_returnflag AS f, count(*) AS n, round(sum(r[0].o_totalprice)) AS t, min(last(r).l_quantity) AS q",
        "SELECT l_returnflag AS f, count(*) AS n, CAST(floor(sum(o_totalprice) + 0.5) AS BIGINT) AS t, min(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "collect_elements": (
        "MATCH (c:Customer)-[:IN_NATION]->(n) WITH c.c_mktsegment AS s, n, count(c) AS k RETURN n.n_nationkey AS n, head(collect(n)).n_name AS a, collect(n)[1].n_regionkey AS b, sum(k) AS k",
        "SELECT n_nationkey AS n, n_name AS a, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN n_regionkey END AS b, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, n_regionkey",
    ),
    "collect_in_order": (
        "MATCH (c:Customer)-[:IN_NATION]->(n) WITH c, n ORDER BY c.c_acctbal DESC, c.c_custkey RETURN n.n_nationkey AS k, toString(head(collect(c.c_custkey))) + ' ' + toString(collect(c.c_custkey)[1]) + ' ' + toString(last(collect(c.c_custkey))) AS v, head(collect(DISTINCT c.c_mktsegment)) AS s",
        "SELECT k, l[1] || ' ' || l[2] || ' ' || l[-1] AS v, m[1] AS s FROM (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_acctbal DESC, c_custkey) AS l, list(c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS m FROM customer GROUP BY 1)",
    ),
    "cycle": ("MATCH (o:Order)-[:CONTAINS]->(p)-[:OF]->(s)<-[:SUPPLIED_BY]-(o) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) f ON a.l_partkey = f.l_partkey JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_suppkey = f.l_suppkey"),
    "edge_properties": ("MATCH (:Order)-[r:CONTAINS {l_linestatus:'O'}]->() WHERE r.l_quantity >= 10 RETURN r.l_returnflag AS f, count(*) AS n", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 10 GROUP BY 1"),
    "inline_from_bound": ("MATCH (n:Nation), (s:Supplier {s_nationkey: n.n_nationkey}) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "boolean_logic": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier {s_suppkey: 3}) WITH s.s_acctbal > 0 AS a, n.n_nationkey < 5 AS b RETURN a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS w, count(*) AS n",
        "SELECT a AND b AS x, a OR b AS y, a <> b AS z, NOT a AS w, count(*) AS n FROM (SELECT s_acctbal > 0 AS a, n_nationkey < 5 AS b FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey = 3) ON n_nationkey = s_nationkey) GROUP BY 1, 2, 3, 4",
    ),
    "comparisons": ("MATCH (c:Customer) WHERE c.c_acctbal <= 5000 AND c.c_custkey <> 4 RETURN c.c_custkey AS k, c.c_name > 'Customer#000000005' AS g, c.c_custkey = '1' AS e, c.c_custkey < 'a' AS l", "SELECT c_custkey AS k, c_name > 'Customer#000000005' AS g, FALSE AS e, CAST(NULL AS BOOLEAN) AS l FROM customer WHERE c_acctbal <= 5000 AND c_custkey <> 4"),
    "in_list": ("MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN count(*) AS n, 1 IN [2, null] AS u, 1 IN [] AS e", "SELECT count(*) AS n, CAST(NULL AS BOOLEAN) AS u, FALSE AS e FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "string_predicates": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' AND p.p_type CONTAINS 'A' OR p.p_brand ENDS WITH '3' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'P') AND contains(p_type, 'A') OR ends_with(p_brand, '3')"),
    "arithmetic": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey / 2 AS h, n.n_nationkey % 4 AS m, n.n_nationkey * 3 - 1 AS t, n.n_nationkey ^ 2 AS q, -n.n_nationkey AS g", "SELECT n_nationkey AS k, n_nationkey / 2.0 AS h, CAST(n_nationkey % 4 AS DOUBLE) AS m, CAST(n_nationkey * 3 - 1 AS BIGINT) AS t, CAST(n_nationkey AS DOUBLE) ** 2 AS q, -n_nationkey AS g FROM nation"),
    "fn_strings": (
        "MATCH (n:Nation) RETURN toLower(n.n_name) AS lo, toUpper(n.n_name) AS up, substring(n.n_name, 1, 3) AS su, left(n.n_name, 2) AS le, right(n.n_name, 2) AS ri, replace(n.n_name, 'A', '_') AS re, size(split(n.n_name, 'N')) AS sp, reverse(n.n_name) AS rv, trim('  ' + n.n_name + ' ') AS tr, size(n.n_name) AS si",
        "SELECT lower(n_name) AS lo, upper(n_name) AS up, substr(n_name, 2, 3) AS su, left(n_name, 2) AS le, right(n_name, 2) AS ri, replace(n_name, 'A', '_') AS re, len(string_split(n_name, 'N')) AS sp, reverse(n_name) AS rv, n_name AS tr, length(n_name) AS si FROM nation",
    ),
    "fn_convert": ("MATCH (n:Nation) RETURN toString(n.n_nationkey) AS s, toInteger('12.7') AS i, toFloat('2.5') AS f, toInteger('x') AS b, toBoolean('TRUE') AS t, toString(2.0) AS w", "SELECT CAST(n_nationkey AS VARCHAR) AS s, CAST(12 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS b, TRUE AS t, '2' AS w FROM nation"),
    "fn_math": ("MATCH (s:Supplier) RETURN s.s_suppkey AS k, abs(-s.s_suppkey) AS a, floor(s.s_acctbal) AS f, ceil(s.s_acctbal) AS c, round(-2.5) AS r, sign(s.s_acctbal) AS g", "SELECT s_suppkey AS k, s_suppkey AS a, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(-2 AS BIGINT) AS r, CAST(sign(s_acctbal) AS INTEGER) AS g FROM supplier"),
    "fn_lists": ("MATCH (r:Region) RETURN r.r_name AS n, head([1, 2, 3]) AS h, last([1, 2, 3]) AS l, [1, 2, 3][1] AS i, [1, 2][9] AS o, size([1] + 2) AS p, coalesce(null, r.r_name) AS c", "SELECT r_name AS n, 1 AS h, 3 AS l, 2 AS i, CAST(NULL AS INTEGER) AS o, 2 AS p, r_name AS c FROM region"),
    "fn_id_labels": ("MATCH (n:Nation)-[r:IN_REGION]->(g) RETURN id(n) AS n, type(r) AS t, id(r) AS r, head(labels(n)) AS l, startNode(r).id AS a, endNode(r).id AS b, size(keys(n)) AS k", "SELECT 'Nation:' || n_nationkey AS n, 'IN_REGION' AS t, 'Nation:' || n_nationkey || '#IN_REGION#Region:' || n_regionkey || '#0' AS r, 'Nation' AS l, 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b, 3 AS k FROM nation"),
    "properties_map": ("MATCH (n:Nation) RETURN properties(n).n_name AS a, {x: n.n_name}.x AS b", "SELECT n_name AS a, n_name AS b FROM nation"),
    "zero_division": ("MATCH (c:Customer) RETURN toString(1 / (c.c_custkey - c.c_custkey)) AS a, toString(-1 / 0) AS b, toString(c.c_custkey % 0) AS c, count(*) AS n", "SELECT 'Infinity' AS a, '-Infinity' AS b, 'NaN' AS c, count(*) AS n FROM customer"),
}

#: Text, number or truth by customer: its value as given out, and in SQL its order (text, truth, number).
_MIXED = "CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name WHEN c.c_custkey % 3 = 1 THEN c.c_acctbal ELSE c.c_acctbal > 0 END"
_MIXED_TEXT = "CASE WHEN c_custkey % 3 = 0 THEN '\"' || c_name || '\"' WHEN c_custkey % 3 = 2 THEN (c_acctbal > 0)::VARCHAR WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::DOUBLE::VARCHAR END"
_MIXED_RANK = "(2 * c_custkey) % 3, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, CASE WHEN c_custkey % 3 = 2 THEN (c_acctbal > 0)::INT::DOUBLE ELSE c_acctbal::DOUBLE END"

#: Beyond the reference's grammar: only with extended=True.
EXTENDED: dict[str, tuple[str, str]] = {
    "unwind": ("MATCH (c:Customer) UNWIND [1, c.c_nationkey, 3] AS x RETURN c.c_mktsegment AS s, sum(x * 2) AS y, count(*) AS n", "SELECT c_mktsegment AS s, CAST(sum(2 * (4 + c_nationkey)) AS BIGINT) AS y, 3 * count(*) AS n FROM customer GROUP BY 1"),
    "case_when": ("MATCH (p:Part) RETURN CASE WHEN p.p_size > 25 THEN 'big' ELSE 'small' END AS s, count(*) AS n", "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s, count(*) AS n FROM part GROUP BY 1"),
    "mixed_order": (
        f"MATCH (c:Customer) RETURN {_MIXED} AS v, c.c_custkey AS k ORDER BY v, k SKIP 10 LIMIT 1000",
        f"SELECT {_MIXED_TEXT} AS v, c_custkey AS k FROM customer ORDER BY {_MIXED_RANK}, c_custkey OFFSET 10 LIMIT 1000",
    ),
    "mixed_order_down": (
        f"MATCH (c:Customer) RETURN {_MIXED} AS v, c.c_custkey AS k ORDER BY v DESC, k LIMIT 1000",
        f"SELECT {_MIXED_TEXT} AS v, c_custkey AS k FROM customer ORDER BY {_MIXED_RANK.replace(', CASE', ' DESC, CASE')} DESC, c_custkey LIMIT 1000",
    ),
    "mixed_groups": (
        f"MATCH (c:Customer) WITH c.c_mktsegment AS s, {_MIXED} AS v RETURN s AS s, count(DISTINCT v) AS n, min(v) AS lo, max(v) AS hi, count(v) AS k",
        "SELECT c_mktsegment AS s, count(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_acctbal::VARCHAR ELSE (c_acctbal > 0)::VARCHAR END) AS n, '\"' || min(c_name) FILTER (c_custkey % 3 = 0) || '\"' AS lo, "
        "CASE WHEN max(c_acctbal) FILTER (c_custkey % 3 = 1) = floor(max(c_acctbal) FILTER (c_custkey % 3 = 1)) THEN (max(c_acctbal) FILTER (c_custkey % 3 = 1))::BIGINT::VARCHAR ELSE (max(c_acctbal) FILTER (c_custkey % 3 = 1))::DOUBLE::VARCHAR END AS hi, count(*) AS k FROM customer GROUP BY 1",
    ),
    "mixed_lists": (
        "MATCH (c:Customer) WITH c, [c.c_custkey % 5, c.c_mktsegment, c.c_acctbal > 0, null] AS l RETURN l[0] AS a, l[1] AS b, c.c_mktsegment IN l AS i, 3 IN l AS j, count(*) AS n",
        "SELECT (c_custkey % 5)::VARCHAR AS a, '\"' || c_mktsegment || '\"' AS b, TRUE AS i, CASE WHEN c_custkey % 5 = 3 THEN TRUE END AS j, count(*) AS n FROM customer GROUP BY ALL",
    ),
    "union_distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.n_name AS n UNION MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS n", "SELECT n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "regex_match": ("MATCH (n:Nation) WHERE n.n_name =~ '.*[AEIOU]' RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE regexp_full_match(n_name, '.*[AEIOU]')"),
    "stdev_percentile": ("MATCH (p:Part) RETURN round(stdev(p.p_retailprice) * 1000) AS s, percentileCont(p.p_size, 0.5) AS m", "SELECT CAST(floor(stddev_samp(p_retailprice) * 1000 + 0.5) AS BIGINT) AS s, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS m FROM part"),
}


#: These look at stubs, so they run on the graph without large parts.
PARTIAL = {"stubs", "not_stubs", "stub_edges"}


def _query(name: str, text: str, extended: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: C.run(star_graph(spark, sf_dir, small_parts_only=name in PARTIAL), text, extended=extended).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(k, q, False) for k, (q, _) in QUERIES.items()} | {k: _query(k, q, True) for k, (q, _) in EXTENDED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (QUERIES | EXTENDED).items()}
