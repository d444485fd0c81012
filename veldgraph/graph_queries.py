"""Registered graph queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from .operators.lower import query
from .sources.tables import NAMESPACE, catalog

N = NAMESPACE

# name: (graph query, SQL)
GRAPH: dict[str, tuple[str, str]] = {
    "class_scan": ("SELECT ?c ?name WHERE { ?c a :Customer ; :name ?name }", "SELECT c_custkey AS c, c_name AS name FROM customer"),
    "superclass_scan": ("SELECT ?p ?name ?b WHERE { ?p a :Party ; :name ?name ; :acctbal ?b }", f"SELECT '{N}Customer/' || c_custkey AS p, c_name AS name, c_acctbal AS b FROM customer UNION ALL SELECT '{N}Supplier/' || s_suppkey, s_name, s_acctbal FROM supplier"),
    "identifier_lookup": (f"SELECT ?o ?s WHERE {{ VALUES ?o {{ <{N}Order/1> <{N}Order/7> <{N}Order/32> }} ?o a :Order ; :status ?s }}", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderkey IN (1, 7, 32)"),
    "required_slot": ("SELECT ?o ?p WHERE { ?o a :Order ; :priority ?p }", "SELECT o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderpriority IS NOT NULL"),
    "inline_literal": ('SELECT ?o ?t WHERE { ?o a :Order ; :status "F" ; :totalPrice ?t }', "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'F'"),
    "inline_reference": (f"SELECT ?c ?name WHERE {{ ?c a :Customer ; :nation <{N}Nation/3> ; :name ?name }}", "SELECT c_custkey AS c, c_name AS name FROM customer WHERE c_nationkey = 3"),
    "const_subject": (f"SELECT ?name ?seg WHERE {{ <{N}Customer/5> :name ?name ; :segment ?seg }}", "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 5"),
    "class_inference": ("SELECT ?x ?b WHERE { ?x :brand ?b ; :size ?s . FILTER(?s = 10) }", "SELECT p_partkey AS x, p_brand AS b FROM part WHERE p_size = 10"),
    "repeated_slot": ("SELECT ?o ?a ?b WHERE { ?o a :Order ; :status ?a ; :status ?b ; :priority ?p . FILTER(?p = '1-URGENT') }", "SELECT o_orderkey AS o, o_orderstatus AS a, o_orderstatus AS b FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "filter_eq": ("SELECT ?c WHERE { ?c a :Customer ; :segment ?s . FILTER(?s = 'BUILDING') }", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_range": ("SELECT ?o ?t WHERE { ?o a :Order ; :totalPrice ?t . FILTER(?t >= 1000 && ?t < 50000.5) }", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000.5"),
    "filter_in": ("SELECT ?o ?s WHERE { ?o a :Order ; :status ?s . FILTER(?s IN ('F', 'P')) }", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "filter_not_in": ("SELECT ?c ?s WHERE { ?c a :Customer ; :segment ?s . FILTER(?s NOT IN ('BUILDING', 'MACHINERY') || ?c = <" + N + "Customer/1>) }", "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_custkey = 1"),
    "filter_regex": ("SELECT ?p ?n WHERE { ?p a :Part ; :name ?n ; :type ?t . FILTER(REGEX(?t, '^[A-M]') && REGEX(?n, 'A.*E', 'i')) }", "SELECT p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_type, '^[A-M]') AND regexp_matches(p_name, 'A.*E', 'i')"),
    "filter_date": ('SELECT ?o WHERE { ?o a :Order ; :orderDate ?d . FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime) }', "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"),
    "filter_error": ("SELECT ?c WHERE { ?c a :Customer ; :name ?n ; :acctbal ?b . FILTER(?n > 5 || ?b > 5000) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 5000"),
    "values_one": ("SELECT ?c ?s WHERE { ?c a :Customer ; :segment ?s . VALUES ?s { 'BUILDING' 'FURNITURE' } }", "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')"),
    "values_multi": ("SELECT ?o WHERE { ?o a :Order ; :status ?s ; :priority ?p . VALUES (?s ?p) { ('F' '1-URGENT') ('O' '5-LOW') } }", "SELECT o_orderkey AS o FROM orders JOIN (VALUES ('F', '1-URGENT'), ('O', '5-LOW')) v(s, p) ON o_orderstatus = s AND o_orderpriority = p"),
    "values_undef": ("SELECT ?o ?s ?p WHERE { ?o a :Order ; :status ?s ; :priority ?p . VALUES (?s ?p) { ('F' UNDEF) (UNDEF '5-LOW') } }", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders JOIN (VALUES ('F', NULL), (NULL, '5-LOW')) v(s, p) ON (v.s IS NULL OR o_orderstatus = v.s) AND (v.p IS NULL OR o_orderpriority = v.p)"),
    "fk_inner": ("SELECT ?o ?name WHERE { ?o a :Order ; :customer ?c . ?c a :Customer ; :name ?name }", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "fk_reverse": ("SELECT ?name ?q WHERE { ?p a :Part ; :name ?name ; :size 7 . ?l :part ?p ; :quantity ?q }", "SELECT p_name AS name, l_quantity AS q FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 7"),
    "chain3": ("SELECT ?c ?r WHERE { ?c a :Customer ; :nation ?n . ?n :region ?g . ?g a :Region ; :name ?r }", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "fan_out": ("SELECT ?p ?s ?q WHERE { ?l a :LineItem ; :part ?pp ; :supplier ?ss ; :quantity ?q . ?pp :brand ?p . ?ss a :Supplier ; :name ?s . FILTER(?q > 45) }", "SELECT p_brand AS p, s_name AS s, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45"),
    "value_join": ("SELECT ?c ?s WHERE { ?c a :Customer ; :nation ?n ; :segment 'BUILDING' . ?s a :Supplier ; :nation ?n }", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "theta_self_join": ("SELECT ?a ?b WHERE { ?a a :Supplier ; :nation ?n . ?b a :Supplier ; :nation ?n . FILTER(?a != ?b) }", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    "cross_join": ("SELECT ?r ?s WHERE { ?x a :Region ; :name ?r . VALUES ?s { 'BUILDING' 'MACHINERY' } }", "SELECT r_name AS r, s FROM region, (VALUES ('BUILDING'), ('MACHINERY')) v(s)"),
    "optional_star": ("SELECT ?o ?q WHERE { ?o a :Order ; :status 'P' . OPTIONAL { ?l a :LineItem ; :order ?o ; :quantity ?q } }", "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'"),
    "optional_attr": ("SELECT ?o ?p WHERE { ?o a :Order ; :status 'F' . OPTIONAL { ?o :priority ?p } }", "SELECT o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'"),
    "optional_filter": ("SELECT ?c ?o WHERE { ?c a :Customer ; :acctbal ?b . OPTIONAL { ?o a :Order ; :customer ?c ; :totalPrice ?t . FILTER(?t > 200000 && ?b > 0) } }", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0"),
    "optional_nested": (
        "SELECT ?c ?o ?q WHERE { ?c a :Customer ; :segment 'BUILDING' . OPTIONAL { ?o a :Order ; :customer ?c ; :status 'F' . OPTIONAL { ?l a :LineItem ; :order ?o ; :returnFlag 'R' ; :quantity ?q } } }",
        "SELECT c_custkey AS c, o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R') ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE c_mktsegment = 'BUILDING'",
    ),
    "optional_disconnected": ("SELECT ?r ?n WHERE { ?x a :Region ; :name ?r . OPTIONAL { ?y a :Nation ; :name ?n . FILTER(?n = 'NOWHERE') } }", "SELECT r_name AS r, NULL::VARCHAR AS n FROM region"),
    "optional_then_join": (
        "SELECT ?c ?o ?t WHERE { ?c a :Customer ; :segment 'MACHINERY' . OPTIONAL { ?o a :Order ; :customer ?c ; :status 'P' } ?o a :Order ; :totalPrice ?t ; :priority '5-LOW' }",
        "SELECT c_custkey AS c, o2.o_orderkey AS o, o2.o_totalprice AS t FROM customer LEFT JOIN orders o1 ON o1.o_custkey = c_custkey AND o1.o_orderstatus = 'P' JOIN orders o2 ON (o1.o_orderkey IS NULL OR o2.o_orderkey = o1.o_orderkey) WHERE c_mktsegment = 'MACHINERY' AND o2.o_orderpriority = '5-LOW' AND c_custkey < 100000",
    ),
    "exists_semi": ("SELECT ?c WHERE { ?c a :Customer . FILTER EXISTS { ?o a :Order ; :customer ?c ; :status 'P' } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "not_exists_anti": ("SELECT ?o WHERE { ?o a :Order . FILTER NOT EXISTS { ?l a :LineItem ; :order ?o } }", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "exists_outer_filter": ("SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b . FILTER EXISTS { ?o a :Order ; :customer ?c ; :totalPrice ?t . FILTER(?t > ?b * 20) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)"),
    "exists_in_or": ("SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b . FILTER(?b > 9000 || EXISTS { ?o a :Order ; :customer ?c ; :status 'P' }) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "minus": ("SELECT ?c WHERE { ?c a :Customer . MINUS { ?o a :Order ; :customer ?c ; :priority '1-URGENT' } }", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "minus_disjoint": ("SELECT ?r WHERE { ?x a :Region ; :name ?r . MINUS { ?y a :Nation } }", "SELECT r_name AS r FROM region"),
    "union": ("SELECT ?n ?b WHERE { { ?c a :Customer ; :name ?n ; :acctbal ?b . FILTER(?b < 0) } UNION { ?s a :Supplier ; :name ?n } }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name, NULL FROM supplier"),
    "bind": ("SELECT ?o ?net WHERE { ?l a :LineItem ; :order ?o ; :extendedPrice ?p ; :discount ?d ; :quantity ?q . BIND(?p * (1 - ?d) AS ?net) FILTER(?q > 48) }", "SELECT l_orderkey AS o, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48"),
    "order_topk": ("SELECT ?o ?t WHERE { ?o a :Order ; :totalPrice ?t } ORDER BY DESC(?t) ?o LIMIT 10", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 10"),
    "offset_limit": ("SELECT ?c ?n WHERE { ?c a :Customer ; :name ?n } ORDER BY ?c OFFSET 5 LIMIT 7", "SELECT c_custkey AS c, c_name AS n FROM customer ORDER BY c LIMIT 7 OFFSET 5"),
    "distinct": ("SELECT DISTINCT ?s ?p WHERE { ?o a :Order ; :status ?s ; :priority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "reduced": ("SELECT REDUCED ?s WHERE { ?o a :Order ; :status ?s }", "SELECT o_orderstatus AS s FROM orders"),
    "subselect": ("SELECT ?name ?n WHERE { ?c a :Customer ; :name ?name . { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o a :Order ; :customer ?c } GROUP BY ?c HAVING (COUNT(*) > 15) } }", "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15) ON o_custkey = c_custkey"),
    "path_sequence": ("SELECT ?c ?r WHERE { ?c a :Customer ; :nation/:region/:name ?r }", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("SELECT ?n ?c WHERE { ?n a :Nation . ?n ^:nation ?c . ?c a :Customer }", "SELECT c_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "path_alternative": (f"SELECT ?x WHERE {{ <{N}Nation/3> (:name|:region/:name) ?x }}", "SELECT n_name AS x FROM nation WHERE n_nationkey = 3 UNION ALL SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3"),
    "path_plus": (f"SELECT ?x WHERE {{ <{N}Customer/5> (:nation|:region)+ ?x }}", f"SELECT '{N}Nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 5 UNION ALL SELECT '{N}Region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5"),
    "path_star": (f"SELECT ?x WHERE {{ <{N}Customer/5> (:nation|:region)* ?x }}", f"SELECT '{N}Customer/5' AS x UNION ALL SELECT '{N}Nation/' || c_nationkey FROM customer WHERE c_custkey = 5 UNION ALL SELECT '{N}Region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5"),
    "path_zero_or_one": (f"SELECT ?x WHERE {{ <{N}Nation/3> :region? ?x }}", f"SELECT '{N}Nation/3' AS x UNION ALL SELECT '{N}Region/' || n_regionkey FROM nation WHERE n_nationkey = 3"),
    "path_both_ends": ("SELECT ?a ?b WHERE { ?a (:nation/:region)+ ?b }", f"SELECT '{N}Customer/' || c_custkey AS a, '{N}Region/' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{N}Supplier/' || s_suppkey, '{N}Region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_backward": (f"SELECT ?x WHERE {{ ?x (:nation|:region)+ <{N}Region/1> }}", f"SELECT '{N}Nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{N}Customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT '{N}Supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"),
    "path_negated": (f"SELECT ?x WHERE {{ <{N}Nation/3> !(:name|a) ?x }}", f"SELECT '{N}Region/' || n_regionkey AS x FROM nation WHERE n_nationkey = 3"),
    "minus_optional": ("SELECT ?c ?p WHERE { ?c a :Customer ; :segment 'BUILDING' . OPTIONAL { ?o a :Order ; :customer ?c ; :status 'P' ; :priority ?p } MINUS { VALUES ?p { '1-URGENT' '2-HIGH' } } }", "SELECT c_custkey AS c, o_orderpriority AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING' AND (o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))"),
    "filter_decimal": ("SELECT ?o ?t WHERE { ?o a :Order ; :totalPrice ?t . FILTER(?t >= 1000.10 && ?t * 2 < 60000.5) }", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice >= 1000.10 AND o_totalprice * 2 < 60000.5"),
    "tagged_literals": ("SELECT ?r (LANG(STRLANG(?r, 'en-GB')) AS ?g) (LANG('oui'@fr) AS ?f) (LANGMATCHES(LANG('oui'@fr-BE), 'fr') AS ?m) WHERE { ?x a :Region ; :name ?r }", "SELECT r_name AS r, 'en-gb' AS g, 'fr' AS f, true AS m FROM region"),
    "zoned_times": (
        'SELECT ?o (TZ("2020-01-01T00:00:00-05:30"^^xsd:dateTime) AS ?z) (TIMEZONE("2020-01-01T00:00:00-05:30"^^xsd:dateTime) AS ?i) (TZ(?d) AS ?none) WHERE { ?o a :Order ; :orderDate ?d . FILTER(?d >= "1997-06-01T02:00:00+02:00"^^xsd:dateTime) }',
        "SELECT o_orderkey AS o, '-05:30' AS z, '-PT5H30M' AS i, '' AS none FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'",
    ),
    "variable_predicate": (f"SELECT ?p ?o WHERE {{ <{N}Order/7> ?p ?o }}", f"SELECT p, o FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{N}status', '{N}priority', '{N}customer', '{N}orderDate']) AS p, unnest(['{N}Order', o_orderstatus, o_orderpriority, '{N}Customer/' || o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')]) AS o FROM orders WHERE o_orderkey = 7) UNION ALL SELECT '{N}totalPrice', o_totalprice::VARCHAR FROM orders WHERE o_orderkey = 7"),
    "type_variable": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?x a ?t ; :acctbal ?b } GROUP BY ?t", f"SELECT '{N}Customer' AS t, count(*) AS n FROM customer UNION ALL SELECT '{N}Supplier', count(*) FROM supplier"),
    "multivalued_slot": ("SELECT ?e ?x WHERE { ?e a :Embedding ; :vector ?x ; :label 3 }", "SELECT vec_id AS e, unnest(embedding) AS x FROM embeddings WHERE label = 3"),
    "ask": ("ASK { ?o a :Order ; :totalPrice ?t . FILTER(?t > 100000) }", "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 100000"),
    "ask_empty": ("ASK { ?o a :Order ; :status 'NONE' }", "SELECT false AS answer"),
    "construct": ("CONSTRUCT { ?c :buysFrom ?r } WHERE { ?c a :Customer ; :nation ?n ; :segment 'BUILDING' . ?n :region ?x . ?x :name ?r }", f"""SELECT DISTINCT '<{N}Customer/' || c_custkey || '>' AS s, '<{N}buysFrom>' AS p, '"' || r_name || '"' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'"""),
    "describe": (f"DESCRIBE <{N}Nation/4>", f"""SELECT '<{N}Nation/4>' AS s, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{N}name>', '<{N}region>']) AS p, unnest(['<{N}Nation>', '"' || n_name || '"', '<{N}Region/' || n_regionkey || '>']) AS o FROM nation WHERE n_nationkey = 4"""),
    "count_group": ("SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o a :Order ; :status ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY s"),
    "sum_avg": ("SELECT ?f (SUM(?q) AS ?sum) (AVG(?q) AS ?avg) WHERE { ?l a :LineItem ; :returnFlag ?f ; :quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_quantity) AS sum, avg(l_quantity) AS avg FROM lineitem GROUP BY f"),
    "min_max": ("SELECT ?s (MIN(?t) AS ?lo) (MAX(?t) AS ?hi) (SAMPLE(?s) AS ?any) WHERE { ?o a :Order ; :status ?s ; :totalPrice ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, o_orderstatus AS any FROM orders GROUP BY o_orderstatus"),
    "count_distinct": ("SELECT ?n (COUNT(DISTINCT ?c) AS ?k) WHERE { ?o a :Order ; :customer ?c . ?c :nation ?n } GROUP BY ?n", "SELECT c_nationkey AS n, count(DISTINCT o_custkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY n"),
    "having": ("SELECT ?c (SUM(?t) AS ?total) WHERE { ?o a :Order ; :customer ?c ; :totalPrice ?t } GROUP BY ?c HAVING (SUM(?t) > 1500000)", "SELECT o_custkey AS c, sum(o_totalprice) AS total FROM orders GROUP BY c HAVING sum(o_totalprice) > 1500000"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x a :Nation ; :name ?n ; :region ?g . ?g :name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r"),
    "global_agg": ("SELECT (COUNT(*) AS ?n) (SUM(?q) AS ?s) (SUM(?q) / COUNT(*) AS ?m) WHERE { ?l a :LineItem ; :quantity ?q ; :returnFlag 'N' }", "SELECT count(*) AS n, sum(l_quantity) AS s, sum(l_quantity) / count(*) AS m FROM lineitem WHERE l_returnflag = 'N'"),
    "empty_agg": ("SELECT (SUM(?q) AS ?s) (COUNT(?q) AS ?n) (MAX(?q) AS ?m) WHERE { ?l a :LineItem ; :quantity ?q . FILTER(?q < 0) }", "SELECT 0::DOUBLE AS s, 0::BIGINT AS n, NULL::DOUBLE AS m"),
    "group_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o a :Order ; :orderDate ?d } GROUP BY (YEAR(?d) AS ?y) ORDER BY ?y", "SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY y"),
    "str_funcs": (
        "SELECT ?c (STRLEN(?n) AS ?len) (UCASE(?s) AS ?up) (LCASE(?s) AS ?low) (SUBSTR(?n, 3, 4) AS ?sub) (STRBEFORE(?n, '#') AS ?b) (STRAFTER(?n, '#') AS ?a) (CONCAT(?s, '-', ?n) AS ?cat) (REPLACE(?s, 'I', 'i') AS ?rep) (ENCODE_FOR_URI(?n) AS ?enc) (STR(?c) AS ?iri) WHERE { ?c a :Customer ; :name ?n ; :segment ?s . FILTER(CONTAINS(?s, 'U') && STRSTARTS(?n, 'C') && !STRENDS(?n, '9')) }",
        f"SELECT c_custkey AS c, length(c_name)::INTEGER AS len, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, substr(c_name, 3, 4) AS sub, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, 1, instr(c_name, '#') - 1) ELSE '' END AS b, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS a, c_mktsegment || '-' || c_name AS cat, replace(c_mktsegment, 'I', 'i') AS rep, url_encode(c_name) AS enc, '{N}Customer/' || c_custkey AS iri FROM customer WHERE contains(c_mktsegment, 'U') AND starts_with(c_name, 'C') AND NOT ends_with(c_name, '9')",
    ),
    "num_funcs": ("SELECT ?c (ABS(?b) AS ?abs) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(?b) AS ?near) (?b / 0 AS ?none) (-?b AS ?neg) (xsd:integer(?b) AS ?int) WHERE { ?c a :Customer ; :acctbal ?b }", "SELECT c_custkey AS c, abs(c_acctbal) AS abs, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, floor(c_acctbal + 0.5) AS near, NULL::DOUBLE AS none, -c_acctbal AS neg, trunc(c_acctbal)::BIGINT AS int FROM customer"),
    "date_parts": ("SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?day) (HOURS(?d) AS ?h) WHERE { ?o a :Order ; :orderDate ?d ; :status 'P' }", "SELECT o_orderkey AS o, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS day, hour(o_orderdate)::INTEGER AS h FROM orders WHERE o_orderstatus = 'P'"),
    "if_coalesce": ("SELECT ?c (IF(?b < 0, 'debt', 'ok') AS ?state) (COALESCE(?none, ?b / 0, -1.0) AS ?first) (BOUND(?none) AS ?has) (?b IN (1, 2) AS ?one) WHERE { ?c a :Customer ; :acctbal ?b }", "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state, '-1.0' AS first, false AS has, c_acctbal IN (1, 2) AS one FROM customer"),
    "hash_funcs": ("SELECT ?r (MD5(?r) AS ?m) (SHA1(?r) AS ?s) (SHA256(?r) AS ?t) WHERE { ?x a :Region ; :name ?r }", "SELECT r_name AS r, md5(r_name) AS m, sha1(r_name) AS s, sha256(r_name) AS t FROM region"),
    "term_funcs": ("SELECT ?o (isIRI(?o) AS ?i) (isLiteral(?s) AS ?l) (isNumeric(?t) AS ?n) (STR(DATATYPE(?t)) AS ?d) (LANG(?s) AS ?g) (sameTerm(?s, ?s) AS ?same) WHERE { ?o a :Order ; :status ?s ; :totalPrice ?t ; :priority '2-HIGH' }", "SELECT o_orderkey AS o, true AS i, true AS l, true AS n, 'http://www.w3.org/2001/XMLSchema#double' AS d, '' AS g, true AS same FROM orders WHERE o_orderpriority = '2-HIGH'"),
}

FLAGSHIP = "SELECT ?name (COUNT(?o) AS ?orders) (SUM(?t) AS ?total) WHERE { ?c a :Customer ; :name ?name . OPTIONAL { ?o a :Order ; :customer ?c ; :status 'F' ; :totalPrice ?t } } GROUP BY ?name"
FLAGSHIP_SQL = "SELECT c_name AS name, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_name"
GRAPH["flagship"] = FLAGSHIP, FLAGSHIP_SQL


def _runner(text: str):
    return lambda spark, sf_dir: query(spark, catalog(spark, sf_dir), text)


QUERIES = {name: _runner(text) for name, (text, _) in GRAPH.items()}
SQL = {name: sql for name, (_, sql) in GRAPH.items()}
