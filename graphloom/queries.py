"""The engine's queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .models import revisions, warehouse
from .operators import drift as drifts
from .operators import discover, infer, profile, versions
from .operators.catalog import LOOKS, Catalog
from .functions.types import parse_type
from .operators.audit import plan_audit
from .operators.graph import PropertyGraph, checkpoint_folder, remove_path, to_model
from .operators.incremental import AuditStore
from .operators.match import match, reachable
from .operators.migrate import Step, apply_steps, change_impact, lost_values, migrate_graph, step_impact, uncarried
from .sources import triples
from .streaming import stateful
from .streaming.audit import audit_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def quoted(x) -> str:
    return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str, types: list[str] | None = None) -> str:
    columns = names.split(", ")
    cells = ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    picked = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types or ["VARCHAR"] * len(columns), strict=True))
    return f"SELECT {picked} FROM (VALUES {cells}) AS v({names})"


# audits: name -> (check's label, code, SQL of its count)
COUNT = "SELECT CAST(count(*) AS BIGINT) AS violations FROM "
DEGREE = "SELECT CAST(count(*) AS BIGINT) AS violations FROM (SELECT {key}, count({e}) AS n FROM (SELECT DISTINCT {key} FROM {t}) a LEFT JOIN (SELECT {e} FROM {et}) b ON {on} GROUP BY {key}) WHERE {cond}"
AUDITS: dict[str, tuple[str, str, str]] = {
    "required_customer": ("Customer.c_name required", "required", COUNT + "customer WHERE c_name IS NULL"),
    "required_order_date": ("Order.o_orderdate required", "required", COUNT + "orders WHERE o_orderdate IS NULL"),
    "unique_part_name": ("Part.p_name unique", "unique", COUNT + "(SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1)"),
    "unique_region_name": ("Region.r_name unique", "unique", COUNT + "(SELECT r_name FROM region WHERE r_name IS NOT NULL GROUP BY r_name HAVING count(*) > 1)"),
    "key_unique_lineitem": ("LineItem key (l_orderkey, l_linenumber)", "key-unique", COUNT + "(SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    "key_unique_orders": ("Order key (o_orderkey)", "key-unique", COUNT + "(SELECT 1 FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)"),
    "key_present_lineitem": ("LineItem key part l_linenumber", "key-present", COUNT + "lineitem WHERE l_linenumber IS NULL"),
    "key_present_orders": ("Order key part o_orderkey", "key-present", COUNT + "orders WHERE o_orderkey IS NULL"),
    "enum_mktsegment": ("Customer.c_mktsegment in enum Segment", "enum", COUNT + "customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"),
    "enum_order_status": ("Order.o_orderstatus in enum OrderStatus", "enum", COUNT + "orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')"),
    "range_acctbal": ("Customer.c_acctbal in 0..9000", "range", COUNT + "customer WHERE c_acctbal < 0 OR c_acctbal > 9000"),
    "range_part_size": ("Part.p_size in 1..50", "range", COUNT + "part WHERE p_size < 1 OR p_size > 50"),
    "length_document_text": ("Document.text length 20..5000", "length", COUNT + "documents WHERE length(text) < 20 OR length(text) > 5000"),
    "length_embedding": ("Vector.embedding size 64", "length", COUNT + "embeddings WHERE len(embedding) <> 64"),
    "pattern_part_name": ("Part.p_name pattern", "pattern", COUNT + "part WHERE NOT regexp_matches(p_name, '^[a-m]')"),
    "less_than_discount_tax": ("LineItem.discountBelowTax", "constraint", COUNT + "lineitem WHERE NOT l_discount < l_tax"),
    "less_or_equal_discount_tax": ("LineItem.discountAtMostTax", "constraint", COUNT + "lineitem WHERE NOT l_discount <= l_tax"),
    "equals_n_chars": ("Document.lengthAsTold", "constraint", COUNT + "documents WHERE n_chars IS DISTINCT FROM length(text)"),
    "disjoint_order_status_priority": ("Order.statusIsNotPriority", "constraint", COUNT + "orders WHERE o_orderstatus = o_orderpriority"),
    "at_least_one_document_label": ("Document.labelled", "constraint", COUNT + "documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND toxic IS NULL"),
    "exactly_one_quality_or_en": ("Document.qualityOrEnglish", "constraint", COUNT + "documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NOT NULL)::INT + (lang = 'en' AND lang IS NOT NULL)::INT <> 1"),
    "closed_event_props": ("Event closed", "closed", COUNT + "events WHERE len(list_filter(json_keys(props), lambda k: k NOT IN ('event_id', 'ts', 'user_id', 'event_type', 'value'))) > 0"),
    "cardinality_min_order_lines": ("HAS_LINE to-cardinality at Order", "cardinality", DEGREE.format(key="o_orderkey", t="orders", e="l_orderkey", et="lineitem", on="o_orderkey = l_orderkey", cond="n < 1")),
    "cardinality_max_customer_orders": ("PLACED_BY from-cardinality at Customer", "cardinality", DEGREE.format(key="c_custkey", t="customer", e="o_custkey", et="orders", on="c_custkey = o_custkey", cond="n > 15")),
    "cardinality_from_part_lines": ("OF_PART from-cardinality at Part", "cardinality", DEGREE.format(key="p_partkey", t="part", e="l_partkey", et="lineitem", on="p_partkey = l_partkey", cond="n > 40")),
    "cardinality_one_customer": ("PLACED_BY to-cardinality at Order", "cardinality", COUNT + "(SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(o_custkey) <> 1)"),
    "cardinality_line_order": ("HAS_LINE from-cardinality at LineItem", "cardinality", COUNT + "(SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1)"),
    "cardinality_based_in": ("BASED_IN to-cardinality at Supplier", "cardinality", COUNT + "(SELECT s_suppkey FROM supplier GROUP BY s_suppkey HAVING count(s_nationkey) <> 1)"),
    "count_of_user_turns": ("Conversation.answersTwice", "constraint", COUNT + "(SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') < 2)"),
    "fk_lineitem_order": ("HAS_LINE from Order", "foreign-key", COUNT + "lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)"),
    "fk_lineitem_part": ("OF_PART to Part", "foreign-key", COUNT + "lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)"),
    "fk_lineitem_supplier": ("SUPPLIED_BY to Supplier", "foreign-key", COUNT + "lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)"),
    "fk_orders_customer": ("PLACED_BY to Customer", "foreign-key", COUNT + "orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"),
    "fk_document_label": ("LABELLED to Label", "foreign-key", COUNT + "documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
}


def audit_one(label: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_audit(warehouse.model()).only(label).run(warehouse.graph(spark, sf_dir)).select("violations")


def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_audit(warehouse.model()).only(*(a[0] for a in AUDITS.values())).run(warehouse.graph(spark, sf_dir))


for _name, (_label, _code, _sql) in AUDITS.items():
    add(f"audit_{_name}", partial(audit_one, _label), _sql)
add("audit_all", audit_all, " UNION ALL ".join(f"SELECT {quoted(c)} AS code, {quoted(x)} AS label, violations FROM ({s})" for x, c, s in AUDITS.values()))


def violations(label: str, columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_audit(warehouse.model()).violating_rows(warehouse.graph(spark, sf_dir), label).select(*columns)


add("violations_range_acctbal", partial(violations, "Customer.c_acctbal in 0..9000", ["c_custkey", "c_acctbal"]), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
add("violations_pattern_part_name", partial(violations, "Part.p_name pattern", ["p_partkey", "p_name"]), "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')")
add("violations_length_text", partial(violations, "Document.text length 20..5000", ["doc_id", "text_length"]), "SELECT doc_id, length(text) AS text_length FROM documents WHERE length(text) < 20 OR length(text) > 5000")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = plan_audit(warehouse.model()).split(warehouse.graph(spark, sf_dir), "Customer")
    return bad.select("c_custkey", F.array_join(F.array_sort("_failed"), "; ").alias("failed"))


add("write_quarantine_customer", quarantine, """SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'Customer.c_acctbal in 0..9000' END,
  CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'Customer.c_mktsegment in enum Segment' END) AS failed
FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 OR c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")


def write_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = plan_audit(warehouse.model()).split(warehouse.graph(spark, sf_dir), "Customer")
    return good.select("c_custkey", "c_name")


add("write_good_customer", write_good, "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')")
add("streaming_audit_orders", lambda spark, d: audit_files(spark, plan_audit(warehouse.model()), "Order", f"{d}/orders.parquet"), """SELECT code, label, CAST(violations AS BIGINT) AS violations FROM (
SELECT 'key-present' AS code, 'Order key part o_orderkey' AS label, count(*) FILTER (WHERE o_orderkey IS NULL) AS violations FROM orders
UNION ALL SELECT 'enum', 'Order.o_orderstatus in enum OrderStatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) FROM orders
UNION ALL SELECT 'required', 'Order.o_orderdate required', count(*) FILTER (WHERE o_orderdate IS NULL) FROM orders
UNION ALL SELECT 'constraint', 'Order.statusIsNotPriority', count(*) FILTER (WHERE o_orderstatus = o_orderpriority) FROM orders)""")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the table may be one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.endswith(".parquet") else path + "*")


def audited_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, counts of edges and foreign keys of customers and suppliers, their nations, regions and orders, all files of the tables taken as streams."""
    m, t = warehouse.model(), {n: stream_of(spark, f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier", "nation", "region", "orders")}
    g = PropertyGraph(m, {kind: to_model(t[n], m, kind) for kind, n in (("Customer", "customer"), ("Supplier", "supplier"), ("Nation", "nation"), ("Region", "region"))})
    g = g.bind_edge("IN_REGION", "Nation", "Region", t["nation"], ["n_nationkey"], ["n_regionkey"])
    g = g.bind_edge("BASED_IN", "Customer", "Nation", t["customer"], ["c_custkey"], ["c_nationkey"]).bind_edge("BASED_IN", "Supplier", "Nation", t["supplier"], ["s_suppkey"], ["s_nationkey"])
    g = g.bind_edge("PLACED_BY", "Order", "Customer", t["orders"], ["o_orderkey"], ["o_custkey"])
    folder = f"{checkpoint_folder(spark).rstrip('/')}/keys-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, folder)
    stateful.audit_keys(g, plan_audit(m), folder).awaitTermination()
    return stateful.violations(g, plan_audit(m), folder)


def degree_sql(key: str, table: str, end: str, edges: str, cond: str) -> str:
    return DEGREE.format(key=key, t=table, e=end, et=edges, on=f"{key} = {end}", cond=cond)


KEYED = [("key-unique", f"{kind} key ({c})", COUNT + f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)") for kind, c, t in (("Region", "r_regionkey", "region"), ("Nation", "n_nationkey", "nation"), ("Customer", "c_custkey", "customer"), ("Supplier", "s_suppkey", "supplier"))]
KEYED += [("unique", *AUDITS["unique_region_name"][::2])]
KEYED += [("foreign-key", x, COUNT + f"{t} WHERE {k} IS NOT NULL AND {n} IS NOT NULL AND {c} NOT IN (SELECT {of} FROM {at} WHERE {of} IS NOT NULL)") for x, t, k, n, c, of, at in (
    ("IN_REGION from Nation", "nation", "n_nationkey", "n_regionkey", "n_nationkey", "n_nationkey", "nation"), ("IN_REGION to Region", "nation", "n_nationkey", "n_regionkey", "n_regionkey", "r_regionkey", "region"),
    ("BASED_IN from Customer [Customer to Nation]", "customer", "c_custkey", "c_nationkey", "c_custkey", "c_custkey", "customer"), ("BASED_IN to Nation [Customer to Nation]", "customer", "c_custkey", "c_nationkey", "c_nationkey", "n_nationkey", "nation"),
    ("BASED_IN from Supplier [Supplier to Nation]", "supplier", "s_suppkey", "s_nationkey", "s_suppkey", "s_suppkey", "supplier"), ("BASED_IN to Nation [Supplier to Nation]", "supplier", "s_suppkey", "s_nationkey", "s_nationkey", "n_nationkey", "nation"),
)]
KEYED += [("foreign-key", "PLACED_BY to Customer", AUDITS["fk_orders_customer"][2] + " AND o_orderkey IS NOT NULL AND o_custkey IS NOT NULL"), ("cardinality", AUDITS["cardinality_max_customer_orders"][0], AUDITS["cardinality_max_customer_orders"][2])]
KEYED += [("cardinality", f"BASED_IN to-cardinality at {kind}", degree_sql(key, t, "k", f"(SELECT {key} AS k FROM {t} WHERE {n} IS NOT NULL)", "n <> 1")) for kind, key, t, n in (("Customer", "c_custkey", "customer", "c_nationkey"), ("Supplier", "s_suppkey", "supplier", "s_nationkey"))]
KEYED += [("cardinality", "IN_REGION to-cardinality at Nation", degree_sql("n_nationkey", "nation", "k", "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey IS NOT NULL)", "n > 1"))]
add("streaming_audit_keys", audited_keys, " UNION ALL ".join(f"SELECT {quoted(c)} AS code, {quoted(x)} AS label, violations FROM ({s})" for c, x, s in KEYED))


def kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of customers and orders kept up by a change: begun without finished orders, then these come and the pending ones go."""
    m, orders, customers = warehouse.model(), warehouse.read(spark, sf_dir, "orders"), warehouse.read(spark, sf_dir, "customer")

    def some(status: str, **more: DataFrame) -> PropertyGraph:
        rows = orders.where(status)
        g = PropertyGraph(m, {"Order": to_model(rows, m, "Order"), **more})
        return g.bind_edge("PLACED_BY", "Order", "Customer", rows, ["o_orderkey"], ["o_custkey"])

    begun = some("o_orderstatus IS NULL OR o_orderstatus <> 'F'", Customer=to_model(customers, m, "Customer"))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, folder)
    store = AuditStore(spark, folder, plan_audit(m).only(*KEPT_UP), begun)
    store.build(begun)
    store.change(added=some("o_orderstatus = 'F'"), removed=some("o_orderstatus = 'P'"))
    return store.violations()


KEPT_UP = {AUDITS[x][0]: x for x in ("key_unique_orders", "cardinality_max_customer_orders", "fk_orders_customer", "cardinality_one_customer", "range_acctbal", "enum_mktsegment", "required_order_date", "disjoint_order_status_priority", "key_present_orders")}
LEFT = "WITH left_over AS (SELECT * FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'P') "
add("audit_kept_up", kept_up, LEFT + " UNION ALL ".join(f"SELECT {quoted(AUDITS[x][1])} AS code, {quoted(AUDITS[x][0])} AS label, violations FROM ({re.sub(r'\borders\b', 'left_over', AUDITS[x][2])})" for x in KEPT_UP.values()))


# patterns
def matched(pattern: str, group: dict[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a pattern counted by some columns."""
    found = match(warehouse.graph(spark, sf_dir), pattern)
    return found.groupBy(*(F.col(c).alias(n) for c, n in group.items())).agg(F.count("*").alias("n"))


PARTY = "(SELECT c_nationkey AS nationkey, 'Customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier)"
add("match_customer_nation_region", partial(matched, "(c:Customer)-[:BASED_IN]->(n:Nation)-[:IN_REGION]->(r:Region {r_name: 'ASIA'})", {"n_n_name": "nation"}), "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
add("match_customer_region", partial(matched, "(c:Customer)-[:BASED_IN]->(:Nation)-[:IN_REGION]->(r:Region)", {"r_r_name": "region"}), "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
add("match_abstract_party", partial(matched, "(p:Party)-[:BASED_IN]->(n:Nation)", {"n_n_name": "nation"}), f"SELECT n_name AS nation, count(*) AS n FROM {PARTY} p JOIN nation ON nationkey = n_nationkey GROUP BY n_name")
add("match_incoming", partial(matched, "(n:Nation)<-[:BASED_IN]-(p:Party)", {"n_n_name": "nation", "p_type": "kind"}), f"SELECT n_name AS nation, kind, count(*) AS n FROM {PARTY} p JOIN nation ON nationkey = n_nationkey GROUP BY n_name, kind")
add("match_undirected", partial(matched, "(n:Nation)-[:IN_REGION]-(r:Region)", {"r_r_name": "region"}), "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
add("match_property_map", partial(matched, "(o:Order {o_orderstatus: 'F'})-[:PLACED_BY]->(c:Customer {c_mktsegment: 'BUILDING'})", {"c_c_custkey": "custkey"}), "SELECT c_custkey AS custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY c_custkey")
add("match_multi_type", partial(matched, "(n:Nation)-[r:IN_REGION|BASED_IN]-(x)", {"r_type": "edge"}), f"SELECT 'IN_REGION' AS edge, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'BASED_IN', count(*) FROM {PARTY} p JOIN nation ON nationkey = n_nationkey")
add("match_multi_label", partial(matched, "(p:Party:Supplier)-[:BASED_IN]->(n:Nation)", {"n_n_name": "nation"}), "SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
add("match_var_length_1_2", partial(matched, "(c:Customer)-[:BASED_IN|IN_REGION*1..2]->(x)", {"x_type": "kind"}), "SELECT 'Nation' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Region', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
# the line key is not unique in the data, so a line's edges meet all lines of its key
add("match_order_part_supplier", partial(matched, "(o:Order {o_orderpriority: '1-URGENT'})-[:HAS_LINE]->(l:LineItem)-[:OF_PART]->(p:Part)", {"p_p_brand": "brand"}), """SELECT p_brand AS brand, count(*) AS n FROM orders JOIN lineitem e ON o_orderkey = e.l_orderkey JOIN lineitem v ON e.l_orderkey = v.l_orderkey AND e.l_linenumber = v.l_linenumber
JOIN lineitem f ON f.l_orderkey = v.l_orderkey AND f.l_linenumber = v.l_linenumber JOIN part ON f.l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT' GROUP BY p_brand""")
add("match_composite_key", partial(matched, "(v:Conversation)-[:HAS_TURN]->(t:UserTurn)", {"v_conv_id": "conv_id"}), "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")

# rings, several chains and walks of any length
add("match_ring_local_supplier", partial(matched, "(o:Order {o_orderstatus: 'F'})-[:PLACED_BY]->(c:Customer)-[:BASED_IN]->(n:Nation), (o)-[:HAS_LINE]->(l:LineItem)-[:SUPPLIED_BY]->(s:Supplier)-[:BASED_IN]->(n)", {"n_n_name": "nation"}), """SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem e ON o_orderkey = e.l_orderkey
JOIN lineitem v ON e.l_orderkey = v.l_orderkey AND e.l_linenumber = v.l_linenumber JOIN lineitem f ON f.l_orderkey = v.l_orderkey AND f.l_linenumber = v.l_linenumber JOIN supplier ON f.l_suppkey = s_suppkey AND s_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
add("match_two_chains", partial(matched, "(l:LineItem)-[:OF_PART]->(p:Part {p_size: 15}), (l)-[:SUPPLIED_BY]->(s:Supplier)", {"s_s_suppkey": "suppkey", "p_p_brand": "brand"}), """SELECT s_suppkey AS suppkey, p_brand AS brand, count(*) AS n FROM lineitem v JOIN lineitem e ON e.l_orderkey = v.l_orderkey AND e.l_linenumber = v.l_linenumber JOIN part ON e.l_partkey = p_partkey
JOIN lineitem f ON f.l_orderkey = v.l_orderkey AND f.l_linenumber = v.l_linenumber JOIN supplier ON f.l_suppkey = s_suppkey WHERE p_size = 15 GROUP BY s_suppkey, p_brand""")
WALKED = """WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT 'Order/' || o_orderkey AS a, 'Customer/' || o_custkey AS b FROM orders UNION ALL SELECT 'Order/' || l_orderkey, 'LineItem/' || l_orderkey || '/' || l_linenumber FROM lineitem UNION ALL SELECT 'LineItem/' || l_orderkey || '/' || l_linenumber, 'Part/' || l_partkey FROM lineitem
UNION ALL SELECT 'LineItem/' || l_orderkey || '/' || l_linenumber, 'Supplier/' || l_suppkey FROM lineitem UNION ALL SELECT 'Customer/' || c_custkey, 'Nation/' || c_nationkey FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey, 'Nation/' || s_nationkey FROM supplier UNION ALL SELECT 'Nation/' || n_nationkey, 'Region/' || n_regionkey FROM nation) WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT a AS start, b AS node, 1 AS hops FROM e JOIN orders ON a = 'Order/' || o_orderkey WHERE o_orderpriority = '1-URGENT' UNION SELECT r.start, e.b, r.hops + 1 FROM r JOIN e ON r.node = e.a),
best AS (SELECT start, node, min(hops) AS hops FROM r WHERE hops >= {least} GROUP BY start, node),
copies AS (SELECT 'LineItem/' || l_orderkey || '/' || l_linenumber AS node, count(*) AS k FROM lineitem GROUP BY 1)
SELECT split_part(node, '/', 1) AS kind, CAST(hops AS INTEGER) AS hops, CAST(sum(coalesce(k, 1)) AS BIGINT) AS n FROM best LEFT JOIN copies USING (node) GROUP BY 1, 2"""
ANY_WALK = "(o:Order {o_orderpriority: '1-URGENT'})-[w:PLACED_BY|HAS_LINE|OF_PART|SUPPLIED_BY|BASED_IN|IN_REGION*%s]->(x)"
add("match_unbounded", partial(matched, ANY_WALK % "", {"x_type": "kind", "w_hops": "hops"}), WALKED.format(least=1))
add("match_unbounded_from_three", partial(matched, ANY_WALK % "3..", {"x_type": "kind", "w_hops": "hops"}), WALKED.format(least=3))


def optional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.audit import degrees

    g = warehouse.graph(spark, sf_dir)
    return degrees(g, g.model.edge("PLACED_BY"), "Customer", False).select("c_custkey", F.col("n").cast("long").alias("n"))


add("match_optional_count", optional_counts, "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as chains: what each turn leads to, in any number of hops."""
    from .plans.resolve import model_of

    m = model_of("""
namespace: { prefix: t, iri: "https://example.org/turns#" }
nodes: { Turn: { key: [id], props: { id: { type: string, required: true } } } }
edges: { NEXT: { from: Turn, to: Turn } }
""")
    turns = warehouse.read(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    name = lambda c: F.concat_ws("/", "conv_id", c)
    w = Window.partitionBy("conv_id").orderBy("turn")
    edges = turns.select(name("turn").alias("src_id"), F.concat_ws("/", "conv_id", F.lead("turn").over(w)).alias("dst_id"), F.lead("turn").over(w).alias("next")).where("next IS NOT NULL").drop("next")
    g = PropertyGraph(m, {"Turn": turns.select(name("turn").alias("id"))}, {("NEXT", "Turn", "Turn"): edges})
    return reachable(g, "NEXT").select("src_id", "dst_id", F.col("hops").cast("long").alias("hops"))


NEXT_TURNS = """WITH RECURSIVE t AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE turn IS NOT NULL),
e AS (SELECT conv_id || '/' || turn AS src_id, conv_id || '/' || next AS dst_id FROM t WHERE next IS NOT NULL),
r AS (SELECT src_id, dst_id, 1 AS hops FROM e UNION ALL SELECT r.src_id, e.dst_id, hops + 1 FROM r JOIN e ON r.dst_id = e.src_id)
SELECT src_id, dst_id, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY src_id, dst_id"""
add("match_reachable", next_turns, NEXT_TURNS)


# profiles: parties, nations and regions as labelled elements
def elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: warehouse.read(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "region")}
    row = lambda df, key, labels, props: df.select(F.concat(F.lit(labels[0] + "/"), F.col(key).cast("string")).alias("id"), F.array(*map(F.lit, labels)).alias("labels"), F.create_map(*(x for p in props for x in (F.lit(p), F.col(p).cast("string")))).alias("props"))
    parts = [row(t["customer"], "c_custkey", ["Customer", "Party"], ["c_name", "c_mktsegment"]), row(t["supplier"], "s_suppkey", ["Supplier", "Party"], ["s_name"]), row(t["nation"], "n_nationkey", ["Nation"], ["n_name"]), row(t["region"], "r_regionkey", ["Region"], ["r_name"])]
    edge = lambda df, kind, a, ka, b, kb: df.select(F.concat(F.lit(a + "/"), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b + "/"), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.create_map(F.lit("since"), F.lit("2020")).alias("props"))
    edges = [edge(t["customer"], "BASED_IN", "Customer", "c_custkey", "Nation", "c_nationkey"), edge(t["supplier"], "BASED_IN", "Supplier", "s_suppkey", "Nation", "s_nationkey"), edge(t["nation"], "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey")]
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, edges)


ELEMENT_ROWS = """(SELECT 'Customer/' || c_custkey AS id, ['Customer', 'Party'] AS labels, ['c_name', 'c_mktsegment'] AS keys FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey, ['Party', 'Supplier'], ['s_name'] FROM supplier
UNION ALL SELECT 'Nation/' || n_nationkey, ['Nation'], ['n_name'] FROM nation UNION ALL SELECT 'Region/' || r_regionkey, ['Region'], ['r_name'] FROM region)"""
EDGE_ROWS = """(SELECT 'Customer/' || c_custkey AS src, 'Nation/' || c_nationkey AS dst, 'BASED_IN' AS type FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey, 'Nation/' || s_nationkey, 'BASED_IN' FROM supplier
UNION ALL SELECT 'Nation/' || n_nationkey, 'Region/' || n_regionkey, 'IN_REGION' FROM nation)"""
joined = lambda c: F.array_join(c, ",").alias(c)
add("profile_counts", lambda s, d: profile.counts(*elements(s, d)), "SELECT 'nodes' AS element, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)")
add("profile_label_sets", lambda s, d: profile.label_sets(elements(s, d)[0]).select(joined("labels")), f"SELECT DISTINCT array_to_string(labels, ',') AS labels FROM {ELEMENT_ROWS}")
add("profile_label_sets_sampled", lambda s, d: profile.label_sets(elements(s, d)[0], profile.SAMPLE).select(joined("labels")), "SELECT DISTINCT labels FROM (SELECT * FROM (SELECT 'Customer/' || c_custkey AS id, 'Customer,Party' AS labels FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey, 'Party,Supplier' FROM supplier UNION ALL SELECT 'Nation/' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'Region/' || r_regionkey, 'Region' FROM region) ORDER BY id LIMIT 1000)")
add("profile_keys_types", lambda s, d: profile.keys_types(elements(s, d)[0]), f"SELECT DISTINCT unnest(keys) AS key, 'string' AS value_type FROM {ELEMENT_ROWS}")
add("profile_json_keys_types", lambda s, d: profile.keys_types(warehouse.read(s, d, "events").select(F.col("event_id").alias("id"), "event_type", "props"), by="event_type").groupBy("event_type", "key").agg(F.count("*").alias("types")), "SELECT event_type, key, count(DISTINCT kind) AS types FROM (SELECT event_type, unnest(json_keys(props)) AS key, json_type(props, '$.k') AS kind FROM events) GROUP BY event_type, key")
add("profile_endpoints", lambda s, d: profile.endpoints(*reversed(elements(s, d))).select("type", joined("src_labels"), joined("dst_labels")), f"SELECT DISTINCT type, array_to_string(a.labels, ',') AS src_labels, array_to_string(b.labels, ',') AS dst_labels FROM {EDGE_ROWS} JOIN {ELEMENT_ROWS} a ON src = a.id JOIN {ELEMENT_ROWS} b ON dst = b.id")
add("profile_edge_keys_types", lambda s, d: profile.census_edges(elements(s, d)[1]), f"SELECT DISTINCT type, 'since' AS key, 'string' AS value_type FROM {EDGE_ROWS}")
add("profile_census", lambda s, d: profile.census(elements(s, d)[0]).select(joined("labels"), F.array_join(F.transform("properties", lambda p: F.concat_ws(":", p["key"], p["value_type"])), ",").alias("properties"), "n"), "SELECT 'Customer,Party' AS labels, 'c_mktsegment:string,c_name:string' AS properties, count(*) AS n FROM customer UNION ALL SELECT 'Party,Supplier', 's_name:string', count(*) FROM supplier UNION ALL SELECT 'Nation', 'n_name:string', count(*) FROM nation UNION ALL SELECT 'Region', 'r_name:string', count(*) FROM region")
add("profile_event_type_rank", lambda s, d: profile.type_ranking(warehouse.read(s, d, "events"), of="event_type").select("event_type", "n", F.col("rank").cast("long").alias("rank")), "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
add("profile_type_ranking", lambda s, d: profile.type_ranking(warehouse.read(s, d, "part"), "p_brand", of="p_size", ties=True).where("rank = 1").select("p_brand", "p_size", "n", "ambiguous"), "SELECT p_brand, p_size, n, ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k, count(*) FILTER (WHERE n = top) OVER (PARTITION BY p_brand) > 1 AS ambiguous FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size))) WHERE k = 1")
add("profile_truncated", lambda s, d: profile.truncated(warehouse.read(s, d, "orders")), "SELECT count(*) AS total, least(count(*), 1000) AS sampled, count(*) > 1000 AS truncated FROM orders")


# inference: label sets of parties (by segment) and of documents (by source and language)
def party_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: warehouse.read(spark, sf_dir, n) for n in ("customer", "supplier")}
    own = t["customer"].select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("set_id"), F.array(F.lit("Party"), F.lit("Customer"), F.col("c_mktsegment")).alias("labels"))
    return own.unionByName(t["supplier"].select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("set_id"), F.array(F.lit("Party"), F.lit("Supplier")).alias("labels")))


PARTY_SETS = "(SELECT 'c' || c_custkey AS set_id, ['Party', 'Customer', c_mktsegment] AS labels FROM customer UNION ALL SELECT 's' || s_suppkey, ['Party', 'Supplier'] FROM supplier)"


def ancestors_sql(sets: str) -> str:
    """CTEs: s(labels), each(labels, x), up(label, ancestor), depth(label, depth)."""
    return f"""s AS (SELECT DISTINCT list_sort(list_distinct(labels)) AS labels FROM {sets}), each AS (SELECT labels, unnest(labels) AS x FROM s),
pairs AS (SELECT DISTINCT a.x AS label, b.x AS ancestor FROM each a JOIN each b ON a.labels = b.labels AND a.x <> b.x),
up AS (SELECT label, ancestor FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM s WHERE list_contains(labels, p.label) AND NOT list_contains(labels, p.ancestor)) AND EXISTS (SELECT 1 FROM s WHERE list_contains(labels, p.ancestor) AND NOT list_contains(labels, p.label))),
depth AS (SELECT label, count(*) AS depth FROM up GROUP BY label)"""


def hierarchy_sql(sets: str) -> str:
    return f"""WITH {ancestors_sql(sets)},
best AS (SELECT up.label, ancestor, row_number() OVER (PARTITION BY up.label ORDER BY coalesce(depth, 0) DESC, ancestor) AS k FROM up LEFT JOIN depth ON depth.label = ancestor),
own AS (SELECT l.x AS label, list_sort(list_concat([l.x], coalesce(list(ancestor) FILTER (WHERE ancestor IS NOT NULL), []))) AS labels FROM (SELECT DISTINCT x FROM each) l LEFT JOIN up ON up.label = l.x GROUP BY l.x)
SELECT own.label, best.ancestor AS parent, NOT EXISTS (SELECT 1 FROM s WHERE s.labels = own.labels) AS abstract FROM own LEFT JOIN best ON best.label = own.label AND k = 1"""


add("infer_hierarchy", lambda s, d: infer.infer_hierarchy(elements(s, d)[0]), hierarchy_sql(ELEMENT_ROWS))
add("infer_hierarchy_deep", lambda s, d: infer.infer_hierarchy(party_sets(s, d)), hierarchy_sql(PARTY_SETS))
add("infer_specific", lambda s, d: infer.specific(party_sets(s, d), infer.ancestor_pairs(party_sets(s, d))), f"""WITH {ancestors_sql(PARTY_SETS)},
l AS (SELECT set_id, unnest(labels) AS label FROM {PARTY_SETS}) SELECT set_id, label FROM l WHERE NOT EXISTS (SELECT 1 FROM l m JOIN up ON up.label = m.label WHERE m.set_id = l.set_id AND up.ancestor = l.label)""")


def observed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge types with the labels seen at their ends: parties by segment, as customers are labelled."""
    c, n = warehouse.read(spark, sf_dir, "customer"), warehouse.read(spark, sf_dir, "nation")
    based = c.select(F.lit("BASED_IN").alias("type"), F.col("c_mktsegment").alias("src"), F.lit("Nation").alias("dst"))
    based = based.unionByName(warehouse.read(spark, sf_dir, "supplier").select(F.lit("BASED_IN").alias("type"), F.lit("Supplier").alias("src"), F.lit("Nation").alias("dst")))
    return based.unionByName(n.select(F.lit("IN_REGION").alias("type"), F.lit("Nation").alias("src"), F.lit("Region").alias("dst"))).unionByName(c.select(F.lit("IN_SEGMENT").alias("type"), F.col("c_mktsegment").alias("src"), F.lit("Customer").alias("dst"))).distinct()


OBSERVED = "(SELECT DISTINCT 'BASED_IN' AS type, c_mktsegment AS src, 'Nation' AS dst FROM customer UNION SELECT 'BASED_IN', 'Supplier', 'Nation' FROM supplier UNION SELECT 'IN_REGION', 'Nation', 'Region' FROM nation UNION SELECT 'IN_SEGMENT', c_mktsegment, 'Customer' FROM customer)"


def common_sql(side: str) -> str:
    """(type, common) of the labels at one side of the observed edges."""
    return f"""(WITH {ancestors_sql(PARTY_SETS)}, o AS (SELECT DISTINCT type, {side} AS label FROM {OBSERVED}), size AS (SELECT type, count(*) AS n FROM o GROUP BY type),
line AS (SELECT label, ancestor FROM up UNION SELECT label, label FROM o), shared AS (SELECT o.type, ancestor FROM o JOIN line ON line.label = o.label JOIN size ON size.type = o.type GROUP BY o.type, ancestor HAVING count(*) = any_value(n)),
ranked AS (SELECT type, ancestor, row_number() OVER (PARTITION BY type ORDER BY coalesce(depth, 0) DESC, ancestor) AS k FROM shared LEFT JOIN depth ON depth.label = ancestor)
SELECT size.type, ancestor AS common FROM size LEFT JOIN ranked ON ranked.type = size.type AND k = 1)"""


add("infer_nearest_common", lambda s, d: infer.nearest_common(observed_ends(s, d).select(F.col("type").alias("group"), F.col("src").alias("label")), infer.ancestor_pairs(party_sets(s, d))), f'SELECT type AS "group", common FROM {common_sql("src")}')
add("infer_collapse_edges", lambda s, d: infer.collapse_edges(observed_ends(s, d), infer.ancestor_pairs(party_sets(s, d))), f"SELECT a.type, a.common AS src, b.common AS dst FROM {common_sql('src')} a JOIN {common_sql('dst')} b ON a.type = b.type")


def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of four tables as keys: complete without nulls, indexed if no value repeats, declared if integer, generated if the name ends in key."""
    out = []
    for name in ("part", "orders", "customer", "supplier"):
        df = warehouse.read(spark, sf_dir, name)
        row = df.agg(F.count(F.lit(1)).alias("rows"), *(x for c in df.columns for x in (F.count(c).alias(f"{c}.n"), F.count_distinct(c).alias(f"{c}.d"))))
        each = F.array(*(F.struct(F.lit(name).alias("owner"), F.lit(c).alias("name"), F.array(F.lit(c)).alias("columns"), (F.col(f"`{c}.n`") == F.col("rows")).alias("complete"), (F.col(f"`{c}.d`") == F.col("rows")).alias("indexed"), F.lit(df.schema[c].dataType.simpleString() in ("int", "bigint")).alias("declared"), F.lit(c.endswith("key")).alias("generated"), F.lit(i + 1).alias("position")) for i, c in enumerate(df.columns)))
        out.append(row.select(F.inline(each)))
    return reduce(DataFrame.unionByName, out)


def keys_sql(order: str, where: str = "complete") -> str:
    columns = {"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
    each = " UNION ALL ".join(f"SELECT '{t}' AS owner, '{c}' AS name, count(*) = count({c}) AS complete, count(DISTINCT {c}) = count(*) AS indexed, any_value(typeof({c})) IN ('INTEGER', 'BIGINT') AS declared, '{c}' LIKE '%key' AS generated, {i + 1} AS position FROM {t}" for t, cs in columns.items() for i, c in enumerate(cs))
    return f"SELECT owner, name FROM (SELECT owner, name, row_number() OVER (PARTITION BY owner ORDER BY {order}) AS k FROM ({each}) WHERE {where}) WHERE k = 1"


first = lambda df: df.where("rank = 1").select("owner", "name")
add("infer_key_rank", lambda s, d: first(infer.rank_keys(key_candidates(s, d), "indexed")), keys_sql("indexed DESC, name"))
add("infer_key_rank_declared", lambda s, d: first(infer.rank_keys(key_candidates(s, d), "declared")), keys_sql("declared DESC, complete::INT * 4 + generated::INT * 2 DESC, name", "true"))
add("infer_key_rank_earliest", lambda s, d: first(infer.rank_keys(key_candidates(s, d), "earliest")), keys_sql("position, name"))
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'OPERATIONAL' ELSE 'UNDER CONSTRUCTION' END AS status"
add("infer_live_constraints", lambda s, d: infer.live_constraints(warehouse.read(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS name", STATUS)), f"SELECT name, status FROM (SELECT CAST(o_orderkey AS VARCHAR) AS name, {STATUS} FROM orders) WHERE status = 'OPERATIONAL'")


def party_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(label, f.name[2:], f.dataType.simpleString(), f.name.endswith(("custkey", "suppkey"))) for label, t in (("Customer", "customer"), ("Supplier", "supplier")) for f in warehouse.read(spark, sf_dir, t).schema]
    return spark.createDataFrame(rows, "label string, name string, signature string, is_key boolean")


add("infer_hoist", lambda s, d: infer.hoist(party_columns(s, d), s.createDataFrame([("Customer", "Party"), ("Supplier", "Party")], "label string, parent string")), "SELECT 'Party' AS parent, substr(a.column_name, 3) AS name, CASE a.data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(a.data_type) END AS signature FROM information_schema.columns a JOIN information_schema.columns b ON a.table_name = 'customer' AND b.table_name = 'supplier' AND substr(b.column_name, 3) = substr(a.column_name, 3) AND b.data_type = a.data_type")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of a path as each supplier's lines and each customer's orders have them."""
    whole = lambda c: F.floor(c).cast("long")
    line, order = warehouse.read(spark, sf_dir, "lineitem"), warehouse.read(spark, sf_dir, "orders")
    a = line.groupBy("l_suppkey").agg(whole(F.min("l_quantity")).alias("min"), whole(F.max("l_quantity")).alias("max"), F.min("l_linenumber").cast("long").alias("min_count")).select(F.lit("l_quantity").alias("path"), "min", "max", "min_count", F.lit(None).cast("long").alias("max_count"))
    b = order.groupBy("o_custkey").agg(whole(F.min("o_totalprice")).alias("min"), whole(F.max("o_totalprice")).alias("max")).select(F.lit("o_totalprice").alias("path"), "min", "max", F.lit(0).cast("long").alias("min_count"), F.lit(1).cast("long").alias("max_count"))
    return a.unionByName(b)


add("infer_merge_shapes", lambda s, d: infer.merge_shapes(shapes(s, d)), """SELECT path, max(lo) AS min, min(hi) AS max, max(min_count) AS min_count, min(max_count) AS max_count, min(max_count) IS NULL OR min(max_count) > 1 AS is_list FROM (
SELECT 'l_quantity' AS path, CAST(floor(min(l_quantity)) AS BIGINT) AS lo, CAST(floor(max(l_quantity)) AS BIGINT) AS hi, CAST(min(l_linenumber) AS BIGINT) AS min_count, CAST(NULL AS BIGINT) AS max_count FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'o_totalprice', CAST(floor(min(o_totalprice)) AS BIGINT), CAST(floor(max(o_totalprice)) AS BIGINT), 0, 1 FROM orders GROUP BY o_custkey) GROUP BY path""")
add("fk_to_edge_orders_customer", lambda s, d: infer.foreign_key_edges(warehouse.read(s, d, "orders"), ["o_orderkey"], ["o_custkey"]), "SELECT o_orderkey AS src_o_orderkey, o_custkey AS dst_o_custkey FROM orders WHERE o_custkey IS NOT NULL")
add("join_table_to_edge", lambda s, d: infer.join_table_edges(warehouse.read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey"], ["l_partkey"]), "SELECT l_orderkey AS src_l_orderkey, l_partkey AS dst_l_partkey, l_quantity FROM lineitem")


# drift: four tables and one that the model lacks, as they are, against a model that has a wider part size and one table more
BOUND = {"Region": "region", "Part": "part", "Document": "documents", "Event": "events", "Benchmark": "benchmark"}


def drifted(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    model = warehouse.model().edit_property("Part", "p_size", type=parse_type("int"))
    expected = drifts.expected_columns(spark, model).where(F.col("table").isin("Region", "Part", "Document", "Event", "Label"))
    found = drifts.found_columns(spark, {name: warehouse.read(spark, sf_dir, t) for name, t in BOUND.items()})
    return drifts.column_drift(expected, found).where(F.col("kind") == kind)


DECLARED = "(VALUES " + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in {
    "Region": {"r_regionkey": "int", "r_name": "string"}, "Part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "bigint", "p_retailprice": "double"},
    "Document": {"doc_id": "bigint", "text": "string", "n_chars": "bigint", "text_length": "bigint", "quality": "int", "toxic": "int", "english": "boolean"},
    "Event": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double"}, "Label": {"doc_id": "bigint"},
}.items() for c, k in cs.items()) + ") AS e(t, c, k)"
FOUND = "(SELECT n AS t, column_name AS c, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS k FROM information_schema.columns JOIN (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in BOUND.items()) + ") AS b(n, v) ON table_name = v) AS f"
add("drift_missing", partial(drifted, "missing"), f"SELECT DISTINCT 'missing' AS kind, 'table ' || t AS object, 'declared but not found' AS detail FROM {DECLARED} WHERE t NOT IN (SELECT t FROM {FOUND}) UNION ALL SELECT 'missing', 'column ' || t || '.' || c, 'declared ' || k FROM {DECLARED} WHERE t IN (SELECT t FROM {FOUND}) AND (t, c) NOT IN (SELECT (t, c) FROM {FOUND})")
add("drift_unexpected", partial(drifted, "unexpected"), f"SELECT DISTINCT 'unexpected' AS kind, 'table ' || t AS object, 'found but not declared' AS detail FROM {FOUND} WHERE t NOT IN (SELECT t FROM {DECLARED}) UNION ALL SELECT 'unexpected', 'column ' || t || '.' || c, 'found ' || k FROM {FOUND} WHERE t IN (SELECT t FROM {DECLARED}) AND (t, c) NOT IN (SELECT (t, c) FROM {DECLARED})")
add("drift_different", partial(drifted, "different"), f"SELECT 'different' AS kind, 'column ' || e.t || '.' || e.c AS object, 'declared ' || e.k || ', found ' || f.k AS detail FROM {DECLARED} JOIN {FOUND} ON e.t = f.t AND e.c = f.c WHERE e.k <> f.k")


def constraint_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique properties and enums that the model declares against those that the tables show: columns without repeats, and the statuses there are."""
    found = first_unique(spark, sf_dir).unionByName(warehouse.read(spark, sf_dir, "orders").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("detail")).select(F.lit("").alias("owner"), F.lit("enum").alias("kind"), F.array(F.lit("OrderStatus")).alias("props"), "detail"))
    expected = drifts.expected_constraints(spark, warehouse.model()).where("kind = 'unique' AND owner IN ('Part', 'Region') OR kind = 'enum' AND props[0] = 'OrderStatus'")
    return drifts.constraint_drift(expected, found)


def first_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"part": "Part", "supplier": "Supplier"}
    own = key_candidates(spark, sf_dir).where(F.col("indexed") & ~F.col("generated") & F.col("owner").isin(*tables))
    return own.select(F.when(F.col("owner") == "part", "Part").otherwise("Supplier").alias("owner"), F.lit("unique").alias("kind"), F.col("columns").alias("props"), F.lit("").alias("detail"))


UNIQUE = " UNION ALL ".join(f"SELECT '{o}' AS owner, '{c}' AS c FROM {t} HAVING count(DISTINCT {c}) = count(*)" for o, t, cs in (("Part", "part", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")), ("Supplier", "supplier", ("s_name", "s_acctbal"))) for c in cs)
add("drift_constraints", constraint_drifts, f"""WITH f AS ({UNIQUE}), e(owner, c) AS (VALUES ('Part', 'p_name'), ('Region', 'r_name')), st AS (SELECT string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS v FROM orders)
SELECT 'missing' AS kind, 'unique ' || owner || '(' || c || ')' AS object, '' AS detail FROM e WHERE (owner, c) NOT IN (SELECT (owner, c) FROM f)
UNION ALL SELECT 'unexpected', 'unique ' || owner || '(' || c || ')', '' FROM f WHERE (owner, c) NOT IN (SELECT (owner, c) FROM e)
UNION ALL SELECT 'different', 'enum (OrderStatus)', 'F|O|P -> ' || v FROM st WHERE v <> 'F|O|P'""")
add("drift_flatten_indexes", lambda s, d: drifts.flatten_indexes(warehouse.read(s, d, "documents").select(F.col("source").alias("owner"), F.array("lang", "source").alias("props"))), "SELECT DISTINCT source AS owner, unnest([lang, source]) AS prop FROM documents")


def endpoint_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of types and the multiplicities of a revision whose suppliers hang on parts, against what all edges of the tables show."""
    after = revisions.revisions("change_endpoints")[1]
    return drifts.endpoint_drift(drifts.expected_endpoints(spark, after), drifts.found_endpoints(warehouse.graph(spark, sf_dir)))


LINE_KEY = "l_orderkey || '/' || l_linenumber"
JOINED = " UNION ALL ".join(f"SELECT '{e}' AS edge, '{s}' AS s, '{t}' AS t, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {w}" for e, s, t, a, b, w in (
    ("IN_REGION", "Nation", "Region", "n_nationkey", "n_regionkey", "nation"), ("BASED_IN", "Customer", "Nation", "c_custkey", "c_nationkey", "customer"), ("BASED_IN", "Supplier", "Nation", "s_suppkey", "s_nationkey", "supplier"),
    ("PLACED_BY", "Order", "Customer", "o_orderkey", "o_custkey", "orders"), ("HAS_LINE", "Order", "LineItem", "l_orderkey", LINE_KEY, "lineitem"), ("OF_PART", "LineItem", "Part", LINE_KEY, "l_partkey", "lineitem"),
    ("SUPPLIED_BY", "LineItem", "Supplier", LINE_KEY, "l_suppkey", "lineitem"), ("LABELLED", "Document", "Label", "doc_id", "doc_id", "documents"),
    ("HAS_TURN", "Conversation", "UserTurn", "conv_id", "conv_id || '/' || turn", "conversations WHERE role = 'user'"), ("HAS_TURN", "Conversation", "OtherTurn", "conv_id", "conv_id || '/' || turn", "conversations WHERE role IS DISTINCT FROM 'user'"),
))
SAID = ", ".join(f"('{e}', '{s}', '{t}', '{m}')" for e, s, t, m in (
    ("IN_REGION", "Nation", "Region", "many-to-one"), ("BASED_IN", "Customer", "Nation", "many-to-one"), ("BASED_IN", "Supplier", "Nation", "many-to-one"), ("PLACED_BY", "Order", "Customer", "many-to-one"),
    ("HAS_LINE", "Order", "LineItem", "one-to-many"), ("OF_PART", "LineItem", "Part", "many-to-one"), ("SUPPLIED_BY", "Part", "Supplier", "many-to-many"), ("LABELLED", "Document", "Label", "one-to-one"),
    ("HAS_TURN", "Conversation", "UserTurn", "one-to-many"), ("HAS_TURN", "Conversation", "OtherTurn", "one-to-many"),
))
add("drift_endpoints", endpoint_drifts, f"""WITH g AS (SELECT * FROM ({JOINED}) WHERE a IS NOT NULL AND b IS NOT NULL), e(edge, s, t, m) AS (VALUES {SAID}), p AS (SELECT DISTINCT edge, s, t FROM g),
o AS (SELECT edge, max(n) AS n FROM (SELECT edge, count(*) AS n FROM g GROUP BY edge, s, a) GROUP BY edge), i AS (SELECT edge, max(n) AS n FROM (SELECT edge, count(*) AS n FROM g GROUP BY edge, t, b) GROUP BY edge),
f AS (SELECT edge, CASE WHEN i.n > 1 THEN 'many' ELSE 'one' END || '-to-' || CASE WHEN o.n > 1 THEN 'many' ELSE 'one' END AS m FROM i JOIN o USING (edge))
SELECT 'missing' AS kind, 'endpoints ' || edge || ' ' || s || '->' || t AS object, 'declared but not found' AS detail FROM e WHERE (edge, s, t) NOT IN (SELECT (edge, s, t) FROM p)
UNION ALL SELECT 'unexpected', 'endpoints ' || edge || ' ' || s || '->' || t, 'found but not declared' FROM p WHERE (edge, s, t) NOT IN (SELECT (edge, s, t) FROM e)
UNION ALL SELECT 'different', 'multiplicity of ' || edge, 'declared ' || e.m || ', found ' || f.m FROM (SELECT DISTINCT edge, m FROM e) AS e JOIN f USING (edge) WHERE e.m <> f.m""")


# diff and migration
def diffed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of an edit of the warehouse model, with the rows or values that each concerns."""
    before, after = revisions.revisions(name)
    return change_impact(warehouse.graph(spark, sf_dir, before), after)


for _name, (_, _sql) in revisions.EDITS.items():
    add(f"diff_{_name}", partial(diffed, _name), _sql)


STEPPED = ["remove_node_type", "rename_edge", "rename_node_type", "rename_property"]


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrites of data that edits of the warehouse model need, with the rows or values that each touches."""
    each = [step_impact(warehouse.graph(spark, sf_dir), revisions.revisions(name)[1]).select(F.lit(name).alias("pair"), "*") for name in STEPPED]
    return reduce(DataFrame.unionByName, each)


add("migrate_data_steps", steps_of, """SELECT pair, CAST(place AS INTEGER) AS place, kind, on_, old, new, CAST(affected AS BIGINT) AS affected FROM (
SELECT 'remove_node_type' AS pair, 0 AS place, 'delete-edges' AS kind, 'OF_PART' AS on_, '' AS old, '' AS new, count(l_partkey) AS affected FROM lineitem
UNION ALL SELECT 'remove_node_type', 1, 'delete-nodes', 'Part', '', '', count(*) FROM part
UNION ALL SELECT 'rename_edge', 0, 'retype-edges', 'LABELLED', 'LABELLED', 'JUDGED', count(*) FROM documents
UNION ALL SELECT 'rename_node_type', 0, 'relabel', 'Event', 'Event', 'Click', count(*) FROM events
UNION ALL SELECT 'rename_property', 0, 'rename-node-property', 'Event', 'event_type', 'kind', count(event_type) FROM events)""")


def retyped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_LINE renamed: all lines under the new edge."""
    after = warehouse.model().edit_edge("HAS_LINE", name="CONTAINS")
    return migrate_graph(warehouse.graph(spark, sf_dir), after).edges["CONTAINS", "Order", "LineItem"]


RETYPED = "SELECT l_orderkey AS src_o_orderkey, l_orderkey AS dst_l_orderkey, l_linenumber AS dst_l_linenumber FROM lineitem"
add("migrate_retype_edges", retyped_edges, RETYPED)


def renamed_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate_graph(warehouse.graph(spark, sf_dir), warehouse.model().edit_property("Customer", "c_mktsegment", name="segment")).vertices["Customer"].select("c_custkey", "segment")


add("migrate_rename_property", renamed_property, "SELECT c_custkey, c_mktsegment AS segment FROM customer")


def rewritten(steps: list[Step], spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = apply_steps(*elements(spark, sf_dir), steps)
    n = lambda what, names: names.groupBy("name").agg(F.count("*").alias("n")).select(F.lit(what).alias("element"), "name", "n")
    return n("node", v.select(F.array_join(F.array_sort("labels"), ",").alias("name"))).unionByName(n("edge", e.select(F.col("type").alias("name"))))


ELEMENTS = "SELECT 'node' AS element, {c} AS name, count(*) AS n FROM customer UNION ALL SELECT 'node', {s}, count(*) FROM supplier UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Region', count(*) FROM region UNION ALL SELECT 'edge', 'BASED_IN', {e} UNION ALL SELECT 'edge', 'IN_REGION', count(*) FROM nation"
BOTH = "(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"
add("migrate_relabel", partial(rewritten, [Step("relabel", "Customer", "Customer", "Client"), Step("add-label", "Client", new="Actor"), Step("remove-label", "Supplier", old="Party")]), ELEMENTS.format(c="'Actor,Client,Party'", s="'Supplier'", e=BOTH))
add("migrate_delete_nodes", partial(rewritten, [Step("delete-nodes", "Party", keep=("Customer",))]), "SELECT * FROM (" + ELEMENTS.format(c="'Customer,Party'", s="'Party,Supplier'", e="(SELECT count(*) FROM customer)") + ") WHERE name <> 'Party,Supplier'")
add("migrate_delete_edges", partial(rewritten, [Step("delete-edges", "IN_REGION"), Step("retype-edges", "BASED_IN", "BASED_IN", "LOCATED_IN")]), "SELECT element, replace(name, 'BASED_IN', 'LOCATED_IN') AS name, n FROM (" + ELEMENTS.format(c="'Customer,Party'", s="'Party,Supplier'", e=BOTH) + ") WHERE name <> 'IN_REGION'")


def moved_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = apply_steps(*elements(spark, sf_dir), [Step("rename-node-property", "Customer", "c_mktsegment", "segment")])
    return v.where(F.array_contains("labels", "Customer")).select("id", F.element_at("props", F.lit("segment")).alias("segment"), F.size("props").cast("long").alias("n"))


add("migrate_rename_node_property", moved_property, "SELECT 'Customer/' || c_custkey AS id, c_mktsegment AS segment, 2 AS n FROM customer")


def lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = warehouse.model().edit_property("Part", "p_brand", type=parse_type("int")).edit_property("Part", "p_size", type=parse_type("string"))
    return lost_values(warehouse.graph(spark, sf_dir), after)


add("migrate_lost_values", lossy, "SELECT 'Part' AS \"table\", 'p_brand' AS \"column\", count(*) FILTER (WHERE p_brand IS NOT NULL AND TRY_CAST(p_brand AS BIGINT) IS NULL) AS lost FROM part UNION ALL SELECT 'Part', 'p_size', 0")


# migrations that change keys and endpoints
def keyed(node: str, *key: str):
    """The warehouse model with another key for a type."""
    return warehouse.model().edit_node(node, key=key)


def migrated_edge(after, edge: tuple[str, str, str], spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return migrate_graph(warehouse.graph(spark, sf_dir), after, **options).edges[edge]


add("migrate_key_other_column", lambda s, d: migrated_edge(keyed("Customer", "c_name"), ("PLACED_BY", "Order", "Customer"), s, d), "SELECT o_orderkey AS src_o_orderkey, c_name AS dst_c_name FROM orders JOIN (SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL) ON o_custkey = c_custkey")
add("migrate_key_more_columns", lambda s, d: migrated_edge(keyed("Order", "o_custkey", "o_orderkey"), ("HAS_LINE", "Order", "LineItem"), s, d), """SELECT o_custkey AS src_o_custkey, o_orderkey AS src_o_orderkey, l_orderkey AS dst_l_orderkey, l_linenumber AS dst_l_linenumber
FROM lineitem JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL) ON l_orderkey = o_orderkey""")
# the line key is not unique in the data: an edge of a key that stands for several lines leads to each of them
add("migrate_key_both_ends", lambda s, d: migrated_edge(keyed("Order", "o_custkey", "o_orderkey").edit_node("LineItem", key=("l_orderkey", "l_linenumber", "l_partkey")), ("HAS_LINE", "Order", "LineItem"), s, d), """SELECT o_custkey AS src_o_custkey, o_orderkey AS src_o_orderkey, v.l_orderkey AS dst_l_orderkey, v.l_linenumber AS dst_l_linenumber, v.l_partkey AS dst_l_partkey
FROM lineitem e JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL) ON e.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL) v ON e.l_orderkey = v.l_orderkey AND e.l_linenumber = v.l_linenumber""")
add("migrate_key_fewer_columns", lambda s, d: migrated_edge(keyed("LineItem", "l_orderkey"), ("OF_PART", "LineItem", "Part"), s, d), "SELECT l_orderkey AS src_l_orderkey, l_partkey AS dst_p_partkey FROM lineitem WHERE l_linenumber IS NOT NULL AND l_partkey IS NOT NULL")
add("migrate_key_retyped", lambda s, d: migrated_edge(warehouse.model().edit_property("Customer", "c_custkey", type=parse_type("string")), ("PLACED_BY", "Order", "Customer"), s, d), "SELECT o_orderkey AS src_o_orderkey, CAST(o_custkey AS VARCHAR) AS dst_c_custkey FROM orders WHERE o_custkey IS NOT NULL")
add("migrate_endpoints_along", lambda s, d: migrated_edge(revisions.revisions("change_endpoints")[1], ("SUPPLIED_BY", "Part", "Supplier"), s, d, along={"SUPPLIED_BY": {"source": "OF_PART"}}), """SELECT DISTINCT f.l_partkey AS src_p_partkey, e.l_suppkey AS dst_s_suppkey
FROM lineitem e JOIN lineitem f ON e.l_orderkey = f.l_orderkey AND e.l_linenumber = f.l_linenumber WHERE e.l_suppkey IS NOT NULL AND f.l_partkey IS NOT NULL""")


def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four revisions of the warehouse model can't carry, by reason."""
    pairs = {"customer": keyed("Customer", "c_name"), "line": keyed("LineItem", "l_orderkey"), "shipment": keyed("LineItem", "l_orderkey", "l_partkey"), "supplied": revisions.revisions("change_endpoints")[1]}
    each = [uncarried(warehouse.graph(spark, sf_dir), after).select(F.lit(name).alias("revision"), "object", "reason", F.col("rows").alias("n")) for name, after in pairs.items()]
    return reduce(DataFrame.unionByName, each)


LINE_KEYS = "(SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_orderkey, l_linenumber)"


def line_edges_sql(edge: str, pair: str, where: str) -> str:
    rows = f"FROM lineitem e LEFT JOIN {LINE_KEYS} k ON e.l_orderkey = k.l_orderkey AND e.l_linenumber = k.l_linenumber WHERE e.l_orderkey IS NOT NULL AND e.l_linenumber IS NOT NULL AND {where}"
    return f"SELECT 'shipment' AS revision, 'edge {edge} {pair} at LineItem' AS object, 'no-vertex' AS reason, (SELECT count(*) {rows} AND n IS NULL) AS n UNION ALL SELECT 'shipment', 'edge {edge} {pair} at LineItem', 'key-ambiguous', (SELECT count(*) {rows} AND n > 1)"


def repeated_sql(table: str, columns: str) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
    return f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {table} WHERE {present} GROUP BY {columns} HAVING count(*) > 1))"


add("migrate_uncarried", refused_rows, f"""SELECT revision, object, reason, CAST(n AS BIGINT) AS n FROM (SELECT 'customer' AS revision, 'node Customer' AS object, 'key-null' AS reason, (SELECT count(*) FROM customer WHERE c_name IS NULL) AS n
UNION ALL SELECT 'customer', 'node Customer', 'key-repeated', {repeated_sql('customer', 'c_name')}
UNION ALL SELECT 'customer', 'edge BASED_IN Customer->Nation at Customer', 'no-vertex', (SELECT count(*) FROM customer c WHERE c_nationkey IS NOT NULL AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_name IS NOT NULL))
UNION ALL SELECT 'customer', 'edge BASED_IN Customer->Nation at Customer', 'key-ambiguous', (SELECT count(*) FROM customer WHERE c_nationkey IS NOT NULL AND c_custkey IN (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(DISTINCT c_name) > 1))
UNION ALL SELECT 'customer', 'edge PLACED_BY Order->Customer at Customer', 'no-vertex', (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_name IS NOT NULL))
UNION ALL SELECT 'customer', 'edge PLACED_BY Order->Customer at Customer', 'key-ambiguous', (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(DISTINCT c_name) > 1))
UNION ALL SELECT 'line', 'node LineItem', 'key-null', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL)
UNION ALL SELECT 'line', 'node LineItem', 'key-repeated', {repeated_sql('lineitem', 'l_orderkey')}
UNION ALL SELECT 'shipment', 'node LineItem', 'key-null', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL)
UNION ALL SELECT 'shipment', 'node LineItem', 'key-repeated', {repeated_sql('lineitem', 'l_orderkey, l_partkey')}
UNION ALL {line_edges_sql('HAS_LINE', 'Order->LineItem', 'true')} UNION ALL {line_edges_sql('OF_PART', 'LineItem->Part', 'e.l_partkey IS NOT NULL')} UNION ALL {line_edges_sql('SUPPLIED_BY', 'LineItem->Supplier', 'e.l_suppkey IS NOT NULL')}
UNION ALL SELECT 'supplied', 'edge SUPPLIED_BY LineItem->Supplier', 'endpoints', (SELECT count(*) FROM lineitem WHERE l_suppkey IS NOT NULL))""")


# tables as statements and back
def stated(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parties, nations and regions with their edges, as they come back from their statements."""
    g = warehouse.graph(spark, sf_dir)
    some = PropertyGraph(g.model, {k: g.vertices[k] for k in ("Customer", "Supplier", "Nation", "Region")}, {k: df for k, df in g.edges.items() if k[0] in ("BASED_IN", "IN_REGION")})
    return triples.from_triples(triples.to_triples(some), g.model)


add("triples_customers", lambda s, d: stated(s, d).vertices["Customer"], "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL")
add("triples_edges", lambda s, d: stated(s, d).edges["BASED_IN", "Supplier", "Nation"], "SELECT s_suppkey AS src_s_suppkey, n_nationkey AS dst_n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
STATED = ["range_acctbal", "enum_mktsegment", "required_customer", "unique_region_name", "cardinality_based_in"]
add("triples_audit", lambda s, d: plan_audit(warehouse.model()).only(*(AUDITS[x][0] for x in STATED)).run(stated(s, d)), " UNION ALL ".join(f"SELECT {quoted(AUDITS[x][1])} AS code, {quoted(AUDITS[x][0])} AS label, violations FROM ({AUDITS[x][2]})" for x in STATED))
add("triples_statements", lambda s, d: triples.to_triples(PropertyGraph(warehouse.model(), {"Part": warehouse.graph(s, d).vertices["Part"]})).groupBy("p").agg(F.count("*").alias("n")).where(F.col("p").startswith("https://example.org/warehouse#")), " UNION ALL ".join(f"SELECT 'https://example.org/warehouse#{c}' AS p, n FROM (SELECT count({c}) AS n FROM part WHERE p_partkey IS NOT NULL) WHERE n > 0" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers written as a version, migrated on disk to customers keyed by name, and the edges as a reader of the new version has them."""
    g, after = warehouse.graph(spark, sf_dir), keyed("Customer", "c_name")
    kept = PropertyGraph(g.model, {k: g.vertices[k] for k in ("Customer", "Order")}, {k: g.edges[k] for k in (("PLACED_BY", "Order", "Customer"),)})
    folder = f"{checkpoint_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, folder)
    versions.write_graph(kept, folder, 1)
    versions.migrate_folder(spark, folder, g.model, after)
    return versions.open_graph(spark, folder, after).edges["PLACED_BY", "Order", "Customer"]


add("migrate_versioned_apply", applied, ORACLE["migrate_key_other_column"])


# models, keys and foreign keys from data alone
SHOWN = {"Customer": ("customer", "c_custkey", ["Customer", "Party"]), "Supplier": ("supplier", "s_suppkey", ["Party", "Supplier"]), "Nation": ("nation", "n_nationkey", ["Nation"]), "Region": ("region", "r_regionkey", ["Region"]), "Part": ("part", "p_partkey", ["Part"]), "Order": ("orders", "o_orderkey", ["Order"])}
LINKS = {"BASED_IN": [("Customer", "c_custkey", "Nation", "c_nationkey"), ("Supplier", "s_suppkey", "Nation", "s_nationkey")], "IN_REGION": [("Nation", "n_nationkey", "Region", "n_regionkey")], "PLACED_BY": [("Order", "o_orderkey", "Customer", "o_custkey")]}
COLUMNS = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"}


def whole_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Six tables as labelled elements with all their columns as texts, and the edges between them."""
    nodes, edges = [], []
    for label, (t, key, labels) in SHOWN.items():
        df = warehouse.read(spark, sf_dir, t)
        props = F.map_filter(F.create_map(*(x for c in COLUMNS[t].split() for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
        nodes.append(df.select(F.concat_ws("/", F.lit(label), key).alias("id"), F.array(*map(F.lit, labels)).alias("labels"), props.alias("props")))
    for kind, ends in LINKS.items():
        for a, ka, b, kb in ends:
            df = warehouse.read(spark, sf_dir, SHOWN[a][0]).where(F.col(ka).isNotNull() & F.col(kb).isNotNull())
            edges.append(df.select(F.concat_ws("/", F.lit(a), ka).alias("src"), F.concat_ws("/", F.lit(b), kb).alias("dst"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def seen_sql() -> str:
    """(label, key, type, required, low, high, uniq) of every column of the six tables by its values."""
    each = []
    for label, (t, _, _) in SHOWN.items():
        for c in COLUMNS[t].split():
            text = f"CASE WHEN typeof({c}) = 'TIMESTAMP' THEN strftime({c}::TIMESTAMP, '%Y-%m-%d %H:%M:%S') ELSE CAST({c} AS VARCHAR) END"
            kinds = " ".join(f"WHEN bool_and(regexp_matches(v, '{look}')) THEN '{kind}'" for kind, look in LOOKS.items())
            each.append(f"SELECT '{label}' AS label, '{c}' AS key, CASE {kinds} ELSE 'string' END AS type, count(v) = count(*) AS required, min(TRY_CAST(v AS DOUBLE)) AS low, max(TRY_CAST(v AS DOUBLE)) AS high, count(DISTINCT v) = count(*) AS uniq FROM (SELECT {text} AS v FROM {t}) HAVING count(v) > 0")
    return " UNION ALL ".join(each)


add("catalog_properties", lambda s, d: Catalog(*whole_elements(s, d)).declared(), f"SELECT label, key, type, required, CASE WHEN type IN ('int', 'float') THEN low END AS low, CASE WHEN type IN ('int', 'float') THEN high END AS high FROM ({seen_sql()})")
add("catalog_types", lambda s, d: Catalog(*whole_elements(s, d)).types(), f"""WITH k AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY type = 'int' DESC, key) AS r FROM ({seen_sql()}) WHERE uniq AND required),
t(label, parent, abstract) AS (SELECT unnest(['Customer', 'Supplier', 'Party', 'Nation', 'Region', 'Part', 'Order']), unnest(['Party', 'Party', NULL, NULL, NULL, NULL, NULL]), unnest([false, false, true, false, false, false, false]))
SELECT t.label, parent, abstract, key FROM t LEFT JOIN k ON k.label = t.label AND r = 1""")


def links_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS type, '{a}/' || {ka} AS src, '{b}/' || {kb} AS dst FROM {SHOWN[a][0]} JOIN (SELECT {SHOWN[b][1]} AS k FROM {SHOWN[b][0]}) ON k = {kb}" for kind, ends in LINKS.items() for a, ka, b, kb in ends)


add("catalog_edges", lambda s, d: Catalog(*whole_elements(s, d)).relations(), f"""WITH e AS ({links_sql()}), o AS (SELECT type, max(n) AS n FROM (SELECT type, src, count(*) AS n FROM e GROUP BY type, src) GROUP BY type), i AS (SELECT type, max(n) AS n FROM (SELECT type, dst, count(*) AS n FROM e GROUP BY type, dst) GROUP BY type),
p AS (SELECT type, list(DISTINCT split_part(src, '/', 1)) AS a, list(DISTINCT split_part(dst, '/', 1)) AS b FROM e GROUP BY type), up(x) AS (SELECT unnest(['Customer', 'Supplier']))
SELECT p.type, CASE WHEN len(a) = 1 THEN a[1] ELSE 'Party' END AS src, CASE WHEN len(b) = 1 THEN b[1] ELSE 'Party' END AS dst, CASE WHEN i.n > 1 THEN 'many' ELSE 'one' END || '-to-' || CASE WHEN o.n > 1 THEN 'many' ELSE 'one' END AS cardinality FROM p JOIN o ON o.type = p.type JOIN i ON i.type = p.type""")

#: Columns by family whose values are compared, with their tables.
COMPARED = {
    "whole": "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey part.p_size orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber",
    "text": "region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus",
    "number": "customer.c_acctbal supplier.s_acctbal part.p_retailprice orders.o_totalprice lineitem.l_quantity lineitem.l_extendedprice lineitem.l_discount lineitem.l_tax",
    "time": "orders.o_orderdate lineitem.l_shipdate",
}


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: warehouse.read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}


def inclusions_sql() -> str:
    """Every pair of columns of one family by anti-joins; targets have no repeats."""
    columns = [(kind, *x.split(".")) for kind, own in COMPARED.items() for x in own.split()]
    facts = ", ".join(f"{c}_d AS (SELECT {c} AS v, count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})" for _, t, c in columns)
    each = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{u}' AS of_table, '{d}' AS of_column, (SELECT count(*) FROM {c}_d) AS n, (SELECT count(*) FROM {d}_d) AS of_n WHERE (SELECT max(k) FROM {d}_d) = 1 AND (SELECT count(*) FROM {c}_d) > 0 AND (SELECT count(*) FROM {c}_d) <= (SELECT count(*) FROM {d}_d) AND NOT EXISTS (SELECT 1 FROM {c}_d WHERE v NOT IN (SELECT v FROM {d}_d))"
        for kind, t, c in columns for other, u, d in columns if kind == other and c != d
    )
    return f"WITH {facts} {each}"


add("discover_inclusions", lambda s, d: discover.inclusions(star(s, d)), inclusions_sql())
add("discover_foreign_keys", lambda s, d: discover.foreign_keys(star(s, d)), f"""SELECT "table", "column", of_table, of_column FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY of_n, of_table, of_column) AS r FROM ({inclusions_sql()}) WHERE "table" <> of_table AND split_part("column", '_', 2) = split_part(of_column, '_', 2)) WHERE r = 1""")


def least_keys_sql(table: str, columns: list[str], most: int = 3) -> str:
    """Sets of columns without repeats and nulls, none of whose parts is one."""
    from itertools import combinations

    sets = [s for n in range(1, most + 1) for s in combinations(columns, n)]
    each = " UNION ALL ".join(f"SELECT [{', '.join(map(quoted, s))}] AS s WHERE (SELECT count(*) FROM {table} WHERE {' OR '.join(f'{c} IS NULL' for c in s)}) = 0 AND NOT EXISTS (SELECT 1 FROM {table} GROUP BY {', '.join(s)} HAVING count(*) > 1)" for s in sets)
    return f"(WITH u AS ({each}) SELECT '{table}' AS \"table\", array_to_string(s, ',') AS columns FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS w WHERE len(w.s) < len(u.s) AND list_has_all(u.s, w.s)))"


KEYS_OF = {"lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "conversations": "conv_id turn role text", "nation": "n_nationkey n_name n_regionkey", "events": "event_id ts user_id event_type value props"}
add("discover_keys", lambda s, d: discover.keys_of({t: warehouse.read(s, d, t) for t in KEYS_OF}).select("table", F.array_join("columns", ",").alias("columns")), " UNION ALL ".join(least_keys_sql(t, c.split()) for t, c in KEYS_OF.items()))
