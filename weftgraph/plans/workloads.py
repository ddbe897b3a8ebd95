"""The engine's operators as queries over the shared tables, each beside its DuckDB statement.

Every query runs over whole tables; k in a name or a limit is the operator's own. Doubles are rounded on
both sides, arrays are joined to strings, counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import extract, keys, lines, paths
from weftgraph.operators import clones, codec, crosstalk, edges as ed, graph, imports, merge, nodes as nd, relational as rel, resolve, seeds, summary, zones
from weftgraph.operators.storage import settle
from weftgraph.sources import tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(c, sep).alias(c)


# == graph

_QUARTER = "'c' || o_custkey || ':' || (year({0}) * 4 + quarter({0}))"
_TRADE = f"""trade AS (SELECT DISTINCT {_QUARTER.format("o_orderdate")} AS src, {_QUARTER.format("l_shipdate")} AS dst, l_linestatus = 'O' AS tc FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade UNION SELECT {_QUARTER.format("o_orderdate")} FROM orders),
urgent AS (SELECT DISTINCT {_QUARTER.format("o_orderdate")} AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst), er AS (SELECT DISTINCT src, dst FROM trade WHERE NOT tc AND src <> dst)"""


def _closure(edges: str, name: str) -> str:
    return f"""{name}_reach(src, dst) AS (SELECT src, dst FROM {edges} UNION SELECT r.src, e.dst FROM {name}_reach r JOIN {edges} e ON r.dst = e.src),
{name}_pair AS (SELECT id, id AS mate FROM n UNION SELECT a.src, a.dst FROM {name}_reach a JOIN {name}_reach b ON a.src = b.dst AND a.dst = b.src),
{name} AS (SELECT id, min(mate) AS scc_id, count(*) AS scc_size FROM {name}_pair GROUP BY id)"""


def _number(date: str) -> F.Column:
    return F.year(date) * 4 + F.quarter(date)


def _of_customer(number: str | F.Column) -> F.Column:
    return F.concat(F.lit("c"), "o_custkey", F.lit(":"), number)


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every item leads from the quarter in which its customer ordered it to the one in which it was shipped."""
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _number("l_shipdate").alias("sent"), (F.col("l_linestatus") == "O").alias("type_checking"))
    j = item.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", _number("o_orderdate").alias("ordered")), "o_orderkey")
    # numbers are told apart before ids are spelled
    e = j.select("o_custkey", "ordered", "sent", "type_checking").distinct()
    return e.select(_of_customer("ordered").alias("src"), _of_customer("sent").alias("dst"), "type_checking")


def trade_nodes(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    days = table(spark, d, "orders").select("o_custkey", _number("o_orderdate").alias("q")).distinct().select(_of_customer("q"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(days).distinct()
    return ids.select("id", F.col("id").alias("name"), F.substring_index("id", ":", 1).alias("file"))


def urgent_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", _number("o_orderdate").alias("q")).distinct().select(_of_customer("q").alias("id"))


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = settle(trade_edges(spark, d))
    return e, trade_nodes(spark, d, e)


@query(f"""WITH RECURSIVE {_TRADE}, {_closure("e", "scc")},
d AS (SELECT id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id),
l AS (SELECT 'top_imported' AS list, id, i AS n FROM d WHERE i > 0 UNION ALL SELECT 'top_dependencies', id, o FROM d WHERE o > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, id) AS rank FROM l)
SELECT list, rank::BIGINT AS rank, id, r.n, split_part(id, ':', 1) AS file, scc_size::BIGINT AS scc_size FROM r JOIN scc USING (id) WHERE rank <= 15""")
def dependency_hotspots(spark: SparkSession, d: str) -> DataFrame:
    e, n = _trade(spark, d)
    top = summary.hotspots(n, graph.adjacency(e, n))
    return top.join(graph.scc(n, e), "id").select("list", long("rank"), "id", long("n"), "file", long("scc_size"))


@query(f'WITH RECURSIVE {_TRADE}, {_closure("e", "scc")} SELECT id, scc_id, scc_size::BIGINT AS scc_size FROM scc')
def trade_scc(spark: SparkSession, d: str) -> DataFrame:
    e, n = _trade(spark, d)
    return graph.scc(n, e).select("id", "scc_id", long("scc_size"))


@query(f'WITH RECURSIVE {_TRADE}, {_closure("er", "scc")} SELECT id, scc_id, scc_size::BIGINT AS scc_size FROM scc')
def trade_scc_by_rounds(spark: SparkSession, d: str) -> DataFrame:
    """As of components that no task can hold: parts are contracted first; only what that leaves takes trimming, colours and confirmation over all tasks."""
    e, n = _trade(spark, d)
    return graph.scc(n, e, runtime_only=True, group=0).select("id", "scc_id", long("scc_size"))


@query(f"""WITH RECURSIVE {_TRADE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(src, dst) AS (SELECT src, dst FROM b UNION SELECT r.src, b.dst FROM r JOIN b ON r.dst = b.src)
SELECT src AS id, min(least(src, dst)) AS c FROM r GROUP BY src""")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak(trade_edges(spark, d)).select("id", "c")


@query(f"""WITH RECURSIVE {_TRADE}, {_closure("e", "a")}, {_closure("er", "b")},
x AS (SELECT count(*) AS n, coalesce(max(scc_size), 0) AS m, count(DISTINCT scc_id) AS k FROM a WHERE scc_size > 1),
y AS (SELECT count(*) AS n, coalesce(max(scc_size), 0) AS m, count(DISTINCT scc_id) AS k FROM b WHERE scc_size > 1)
SELECT x.n::BIGINT AS cycle_nodes, x.m::BIGINT AS largest_scc_size, x.k::BIGINT AS scc_count, y.n::BIGINT AS cycle_nodes_runtime, y.m::BIGINT AS largest_scc_size_runtime, y.k::BIGINT AS scc_count_runtime, (x.m - y.m)::BIGINT AS tc_inflation FROM x, y""")
def runtime_vs_conceptual_scc(spark: SparkSession, d: str) -> DataFrame:
    e, n = _trade(spark, d)
    t = graph.cycles(n, e)[1]
    return t.select(*[long(c) for c in t.columns])


_DOWN = "dn(id, h) AS (SELECT id, 0 FROM urgent UNION SELECT dst, h + 1 FROM dn JOIN e ON src = id WHERE h < 40)"
_UP = "up(id, h) AS (SELECT id, 0 FROM urgent UNION SELECT src, h + 1 FROM up JOIN e ON dst = id WHERE h < 40)"


@query(f"WITH RECURSIVE {_TRADE}, {_DOWN} SELECT id, min(h)::BIGINT AS hops FROM dn GROUP BY id")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(trade_edges(spark, d), urgent_nodes(spark, d)).select("id", long("hops"))


@query(f"""WITH RECURSIVE {_TRADE}, {_DOWN}, {_UP}, a AS (SELECT id, min(h)::BIGINT AS du FROM up GROUP BY id), b AS (SELECT id, min(h)::BIGINT AS dd FROM dn GROUP BY id)
SELECT id, du, dd FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def node_distances(spark: SparkSession, d: str) -> DataFrame:
    e, n = _trade(spark, d)
    return graph.distances(n, e, urgent_nodes(spark, d)).select("id", long("du"), long("dd"))


@query(f"WITH RECURSIVE {_TRADE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h(id) AS (SELECT id FROM urgent UNION SELECT dst FROM h JOIN b ON src = id) SELECT id FROM h")
def bidirectional_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(trade_edges(spark, d), urgent_nodes(spark, d), direction="both").select("id")


@query(f"""WITH RECURSIVE {_TRADE}, {_DOWN}, g AS (SELECT id, min(h) AS gen FROM dn GROUP BY id)
SELECT id, gen::BIGINT AS gen, (row_number() OVER (PARTITION BY gen ORDER BY id) - 1)::BIGINT AS gen_idx FROM g""")
def reach_node_order(spark: SparkSession, d: str) -> DataFrame:
    o = graph.node_order(graph.hops(trade_edges(spark, d), urgent_nodes(spark, d)))
    return o.select("id", long("gen"), long("gen_idx"))


@query(f"""WITH RECURSIVE {_TRADE}, {_closure("e", "scc")}, k AS (SELECT id FROM urgent),
s AS (SELECT DISTINCT scc_id, scc_size FROM scc)
SELECT 'in_equals_out' AS rule, 0::BIGINT AS n UNION ALL
SELECT 'no_dangling_edge', (SELECT count(*) FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) WHERE id NOT IN (SELECT id FROM k)) UNION ALL
SELECT 'scc_sizes_sum_to_nodes', abs((SELECT sum(scc_size) FROM s) - (SELECT count(*) FROM k))::BIGINT""")
def graph_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of a graph that breaks them: the nodes are only those of urgent orders, edges and components those of all."""
    e, n = _trade(spark, d)
    inner = settle(graph.adjacency(e, n))
    return graph.violations(urgent_nodes(spark, d), inner, graph.scc(n, inner))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Items as edges from suppliers to parts, kinds by return flag, in the order of the items."""
    li = table(spark, d, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.round("l_extendedprice", 2).alias("weight"), seq.alias("seq"), "l_orderkey", "l_linenumber")


_SEQ = "l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax, l_discount"


@query("""SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
SELECT 's' || l_suppkey AS id, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT 'p' || l_partkey, 0, 1 FROM lineitem) GROUP BY id""")
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(supply_edges(spark, d)).select("id", long("out_degree"), long("in_degree"))


@query("""WITH RECURSIVE n AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part),
e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
h(id) AS (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM h JOIN e ON src = id)
SELECT id FROM n WHERE id NOT IN (SELECT id FROM h) AND id NOT IN (SELECT dst FROM e)""")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    c, o, p, li = (table(spark, d, t) for t in ("customer", "orders", "part", "lineitem"))
    cid, oid, pid = (lambda x: F.concat(F.lit("c"), x)), (lambda x: F.concat(F.lit("o"), x)), (lambda x: F.concat(F.lit("p"), x))
    n = c.select(cid("c_custkey").alias("id")).union(o.select(oid("o_orderkey"))).union(p.select(pid("p_partkey")))
    e = o.select(cid("o_custkey").alias("src"), oid("o_orderkey").alias("dst")).union(li.select(oid("l_orderkey"), pid("l_partkey")))
    return graph.unreached(n, e, c.where("c_mktsegment = 'BUILDING'").select(cid("c_custkey").alias("id")))


# == edges and merges


@query(f"""SELECT src, dst, kind, l_orderkey, l_linenumber FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS kind, l_orderkey, l_linenumber,
row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY {_SEQ}) AS r FROM lineitem) WHERE r = 1""")
def edge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return merge.dedupe_edges(supply_edges(spark, d), ["seq"]).select("src", "dst", "kind", "l_orderkey", "l_linenumber")


@query(f"""SELECT src, dst, kind, weight, l_orderkey FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS kind, round(l_extendedprice, 2) AS weight, l_orderkey,
row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY round(l_extendedprice, 2) DESC, {_SEQ}) AS r FROM lineitem) WHERE r = 1""")
def edge_strongest(spark: SparkSession, d: str) -> DataFrame:
    return merge.strongest_edges(supply_edges(spark, d), ["seq"], ["l_orderkey"]).select("src", "dst", "kind", "weight", "l_orderkey")


@query("""WITH t AS (SELECT s_suppkey AS id, 0 AS r, s_name AS nm, s_nationkey AS k, s_name AS label FROM supplier UNION ALL SELECT p_partkey, 1, p_name, p_size, p_brand FROM part
UNION ALL SELECT c_custkey, 2, c_name, c_nationkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END FROM customer)
SELECT id, string_agg(nm, ',' ORDER BY r) AS functions, max(k)::BIGINT AS importers_count, arg_max(label, r) FILTER (label IS NOT NULL) AS label FROM t GROUP BY id""")
def node_merge_ordered(spark: SparkSession, d: str) -> DataFrame:
    s, p, c = (table(spark, d, t) for t in ("supplier", "part", "customer"))
    row = lambda df, i, nm, k, label: df.select(F.col(i).alias("id"), F.array(nm).alias("functions"), F.col(k).alias("importers_count"), label.alias("label"))
    rich = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    m = merge.merge_nodes({"go": row(c, "c_custkey", "c_name", "c_nationkey", rich), "python": row(s, "s_suppkey", "s_name", "s_nationkey", F.col("s_name")), "ts": row(p, "p_partkey", "p_name", "p_size", F.col("p_brand"))})
    return m.select("id", joined("functions"), long("importers_count"), "label")


@query("""SELECT file, owner FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY r DESC, owner) AS n FROM (
SELECT s_nationkey AS file, min(s_name) AS owner, 0 AS r FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, min(c_name), 1 FROM customer GROUP BY 1)) WHERE n = 1""")
def file_union_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.min("s_name").alias("owner"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("file")).agg(F.min("c_name").alias("owner"))
    return merge.merge_files({"python": a, "ts": b}, last=True).select("file", "owner")


@query("""SELECT coalesce(a.s_suppkey, b.c_custkey) AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS name, coalesce(s_nationkey, c_nationkey)::BIGINT AS nation
FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey""")
def index_backfill(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return merge.fill_missing(a, b, "id").select("id", "name", long("nation"))


@query("""SELECT 'nodes' AS what, (SELECT count(*) FROM supplier) AS python, (SELECT count(*) FROM part) AS ts, NULL::BIGINT AS total
UNION ALL SELECT 'edges', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM orders), NULL UNION ALL SELECT 'merged', NULL, NULL, (SELECT count(*) FROM customer)""")
def counts_by_language(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return merge.counts_report({"python": t("supplier"), "ts": t("part")}, {"python": t("lineitem"), "ts": t("orders")}, {"merged": t("customer")})


@query("""SELECT count(*) FILTER (c > 0)::BIGINT AS files_with_types, sum(c)::BIGINT AS total_types, count(*) FILTER (e > 0)::BIGINT AS files_with_exports, sum(e)::BIGINT AS total_exports
FROM (SELECT len(string_split(p_name, ' ')) AS c, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS e FROM part)""")
def type_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.split("p_name", " ").alias("types"), F.when(F.col("p_size") > 25, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("exports"))
    t = merge.typescript_statistics(p)
    return t.select(*[long(c) for c in t.columns])


@query("SELECT kind, count(*)::BIGINT AS n FROM (SELECT coalesce(nullif(l_returnflag, 'N'), 'import') AS kind FROM lineitem) GROUP BY kind")
def edge_kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summary.edge_kinds(table(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("kind"))).select("kind", long("n"))


# == languages, lines, metrics

_PATHS = "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.tsx' WHEN 'fr' THEN '.go' ELSE '.md' END"
_LINES = r"CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10)) END"


def document_files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".tsx").when(F.col("lang") == "fr", ".go").otherwise(".md")
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", ext).alias("path"), "text", F.col("lang").alias("tongue")).withColumn("lang", tree.language_column("path"))


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'ts' WHEN 'fr' THEN 'go' ELSE 'non_code' END AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def lang_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return tree.bucket_counts(document_files(spark, d)).select("bucket", long("n"))


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'ts' WHEN 'fr' THEN 'go' ELSE 'markdown' END AS lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def manifest_languages(spark: SparkSession, d: str) -> DataFrame:
    return tree.language_counts(document_files(spark, d)).select("lang", long("n"))


@query("""WITH t AS (SELECT source AS root, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1 HAVING count(*) >= 10)
SELECT root, row_number() OVER (ORDER BY n DESC, root)::BIGINT AS rank FROM t ORDER BY n DESC, root LIMIT 3""")
def source_roots(spark: SparkSession, d: str) -> DataFrame:
    return tree.source_roots(document_files(spark, d)).select("root", long("rank"))


_HASH = f"""l AS (SELECT doc_id, lang, {_LINES} AS ls FROM documents),
m AS (SELECT doc_id, lang, len(ls)::BIGINT AS loc, len(list_filter(ls, lambda s: NOT regexp_matches(s, '[^\\s]')))::BIGINT AS blank_lines, len(list_filter(ls, lambda s: regexp_matches(s, '^\\s*#')))::BIGINT AS comment_lines FROM l)"""


@query(f"WITH {_HASH} SELECT doc_id, loc, loc - blank_lines - comment_lines AS sloc, comment_lines, blank_lines, round(comment_lines / nullif(loc, 0), 4) AS comment_pct FROM m")
def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", lines.hash_metrics("text").alias("m")).select("doc_id", "m.*")
    return m.select("doc_id", *[long(c) for c in lines.COUNTS], F.round("comment_pct", 4).alias("comment_pct"))


_C_STYLE = r"""l AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(?s)//[^\r\n]*|/\*.*?(?:\*/|\z)|[^/]+|/'),
  lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN regexp_replace(p, '\S+', chr(1), 'g') ELSE p END), '') AS text FROM documents),
s AS (SELECT doc_id, """ + _LINES + r""" AS ls FROM l),
m AS (SELECT doc_id, len(ls)::BIGINT AS loc, len(list_filter(ls, lambda x: NOT regexp_matches(x, '[^\s]')))::BIGINT AS blank_lines,
  len(list_filter(ls, lambda x: contains(x, chr(1)) AND NOT regexp_matches(x, '[^\s\x01]')))::BIGINT AS comment_lines FROM s)"""


@query(f"WITH {_C_STYLE} SELECT doc_id, loc, loc - blank_lines - comment_lines AS sloc, comment_lines, blank_lines FROM m")
def c_style_line_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", lines.c_style_metrics("text").alias("m")).select("doc_id", "m.*")
    return m.select("doc_id", *[long(c) for c in lines.COUNTS])


@query(f"""WITH {_HASH} SELECT lang, grouping(lang) = 1 AS is_total, count(*)::BIGINT AS files, 0::BIGINT AS missing, sum(loc)::BIGINT AS loc, sum(loc - blank_lines - comment_lines)::BIGINT AS sloc,
sum(comment_lines)::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines FROM m GROUP BY ROLLUP(lang)""")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("lang", lines.hash_metrics("text").alias("m")).select("lang", "m.*")
    r = summary.code_metrics(m)
    return r.select("lang", "is_total", *[long(c) for c in ("files", "missing", "loc", "sloc", "comment_lines", "blank_lines")])


# == duplicate code


def _windows(k: int) -> str:
    return f"""l AS (SELECT doc_id, {_LINES} AS ls FROM documents),
u AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(ls[i], '#.*$', ''), '\\s+', ' ', 'g')) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
v AS (SELECT doc_id, list(s ORDER BY i) AS ss, list(i ORDER BY i) AS ii FROM u WHERE s <> '' GROUP BY doc_id HAVING count(*) >= {k}),
w AS (SELECT doc_id, ii[j] AS start, ii[j + {k - 1}] AS stop, sha1(array_to_string(list_slice(ss, j, j + {k - 1}), chr(10))) AS signature, ss[j] AS preview FROM (SELECT *, unnest(range(1, len(ss) - {k} + 2)) AS j FROM v)),
g AS (SELECT signature, count(*) AS members, count(DISTINCT doc_id) AS files, min(preview) AS preview FROM w GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT doc_id) >= 2),
t AS (SELECT *, row_number() OVER (ORDER BY members DESC, signature) AS n FROM g QUALIFY n <= 200)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")


@query(f"WITH {_windows(3)} SELECT 'G' || lpad(n::VARCHAR, 4, '0') AS group_id, signature, members::BIGINT AS members, files::BIGINT AS files, (3 * (files - 1))::BIGINT AS severity, preview FROM t")
def clone_groups_k3(spark: SparkSession, d: str) -> DataFrame:
    g = clones.groups(clones.windows(_documents(spark, d), 3, idents=False), 3)
    return g.select("group_id", "signature", long("members"), long("files"), long("severity"), "preview")


@query(f"WITH {_windows(5)} SELECT 'G' || lpad(n::VARCHAR, 4, '0') AS group_id, doc_id AS file, start::BIGINT AS start, (start + 4)::BIGINT AS end_line, stop::BIGINT AS stop FROM t JOIN w USING (signature)")
def clone_members_k5(spark: SparkSession, d: str) -> DataFrame:
    w = clones.windows(_documents(spark, d), 5, idents=False)
    return clones.members(w, clones.groups(w, 5), 5).select("group_id", "file", long("start"), long("end_line"), long("stop"))


@query(f"""WITH {_windows(3)} SELECT sum(m)::BIGINT AS total_windows, count(*) FILTER (m >= 2)::BIGINT AS multi_hit_windows, count(*) FILTER (f >= 2)::BIGINT AS cross_file_windows
FROM (SELECT count(*) AS m, count(DISTINCT doc_id) AS f FROM w GROUP BY signature)""")
def clone_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = clones.statistics(clones.windows(_documents(spark, d), 3, idents=False))
    return s.select(*[long(c) for c in s.columns])


# == routes and crosstalk


_NAMED_ID = "regexp_full_match(x, '[0-9]+|:.*|[{].*[}]|<.*>') OR regexp_full_match(lower(x), '[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') OR (length(x) >= 12 AND regexp_full_match(lower(x), '(0x)?[0-9a-f]+'))"


def _segments(c: str) -> str:
    """By splitting, not by the patterns of the operator."""
    plain = f"split_part(split_part(trim({c}), '#', 1), '?', 1)"
    path = f"CASE WHEN contains({plain}, '://') THEN array_to_string(string_split({plain}, '/')[4:], '/') ELSE {plain} END"
    return f"list_filter(string_split({path}, '/'), lambda x: x <> '')"


def _route(c: str) -> str:
    return f"'/' || array_to_string({_segments(c)}, '/')"


def _key(c: str) -> str:
    return f"'http:GET:/' || array_to_string(list_transform({_segments(c)}, lambda x: CASE WHEN {_NAMED_ID} THEN ':id' ELSE x END), '/')"


@query(f"SELECT page_id, {_route('url')} AS route, {_key('url')} AS key FROM pages")
def route_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", keys.route_path("url").alias("route"), keys.http_key(F.lit("get"), F.col("url")).alias("key"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first folders of each top-level domain's pages as its routes, links of the pages as calls."""
    p = table(spark, d, "pages")
    none = F.lit(None).cast("string")
    site = F.regexp_extract("url", r"example\.([a-z]+)", 1)
    node = F.when(site == "com", 1).when(site == "net", 2).when(site == "org", 3).cast("long")
    a = p.select(node.alias("node_id"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/?#]+)", 1).alias("target")).where("node_id IS NOT NULL AND target <> ''").distinct()
    sure = F.when(F.col("node_id") == 1, F.lit(1.0)).when(F.col("node_id") == 2, F.lit(0.8)).otherwise(F.lit(0.4))
    a = a.select("node_id", F.lit(0).alias("seq"), F.lit("http_route").alias("kind"), keys.http_key(F.lit("get"), F.col("target")).alias("join"), F.lit(1).alias("line"), F.lit(0).alias("col"), none.alias("syntax"), sure.alias("confidence"))
    href = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    b = p.select(F.col("page_id").alias("node_id"), F.posexplode(href).alias("seq", "target"))
    b = b.select("node_id", "seq", F.lit("http_call").alias("kind"), keys.http_key(F.lit("get"), F.col("target")).alias("join"), F.lit(1).alias("line"), F.lit(0).alias("col"), none.alias("syntax"), F.lit(None).cast("double").alias("confidence"))
    return a, b


_SIDES = f"""site AS (SELECT DISTINCT list_position(['com', 'net', 'org'], regexp_extract(url, 'example[.]([a-z]+)', 1))::BIGINT AS page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1), '#', 1) AS folder FROM pages),
a AS (SELECT page_id, {_key("('/' || folder)")} AS join_key, CASE page_id WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.4 END::DOUBLE AS conf FROM site WHERE page_id > 0 AND folder <> ''),
b AS (SELECT page_id, {_key('h')} AS join_key FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h FROM pages))"""


@query(f"WITH {_SIDES} SELECT DISTINCT a.page_id AS src, b.page_id AS dst, a.join_key AS join_key, a.conf AS confidence FROM a JOIN b USING (join_key) WHERE a.conf >= 0.5")
def route_crosstalk(spark: SparkSession, d: str) -> DataFrame:
    return crosstalk.edges(*_sides(spark, d)).select("src", "dst", F.col("join").alias("join_key"), "confidence")


@query(f"""WITH {_SIDES}, x AS (SELECT join_key, count(*) AS n, count(*) FILTER (conf >= 0.5) AS g FROM a GROUP BY 1), y AS (SELECT join_key, count(*) AS m FROM b GROUP BY 1)
SELECT 'http_route' AS kind, count(*)::BIGINT AS matched_keys, sum(n * m)::BIGINT AS pairs, sum(g * m)::BIGINT AS kept_pairs FROM x JOIN y USING (join_key) HAVING count(*) > 0""")
def crosstalk_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = crosstalk.statistics(*_sides(spark, d))
    return s.select("kind", *[long(c) for c in ("matched_keys", "pairs", "kept_pairs")])


@query(f"WITH {_SIDES} SELECT join_key, count(*)::BIGINT AS entries, count(DISTINCT page_id)::BIGINT AS files FROM b GROUP BY 1")
def candidate_index(spark: SparkSession, d: str) -> DataFrame:
    return crosstalk.index(_sides(spark, d)[1]).select(F.col("join").alias("join_key"), long("entries"), long("files"))


@query(f"""WITH {_SIDES}, n AS (SELECT (SELECT count(*) FROM a) AS r, (SELECT count(*) FROM b) AS c)
SELECT r::BIGINT AS backend_routes, c::BIGINT AS frontend_calls, CASE WHEN c > 0 THEN round(c / r, 3) END AS coverage_ratio FROM n""")
def http_contracts(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return summary.http_contracts(a.select("kind").union(b.select("kind"))).select(long("backend_routes"), long("frontend_calls"), "coverage_ratio")


@query(f"""WITH {_SIDES}, c AS (SELECT 'python' AS lang, 'http_route' AS kind, page_id FROM a UNION ALL SELECT 'typescript', 'http_call', page_id FROM b)
SELECT lang, kind, count(*)::BIGINT AS refs, count(DISTINCT page_id)::BIGINT AS files FROM c GROUP BY GROUPING SETS ((lang, kind), (lang))""")
def crosstalk_totals(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    c = a.select(F.lit("python").alias("lang"), "kind", "node_id").union(b.select(F.lit("typescript"), "kind", "node_id"))
    return summary.crosstalk_totals(c).select("lang", "kind", long("refs"), long("files"))


# == resolution


def _url_paths(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.concat(host, keys.route_path("url")).alias("path"))


_URL = f"regexp_extract(url, '://([^/?#]+)', 1) || {_route('url')}"
_FOLDERS = f"""u AS (SELECT page_id, {_URL} AS path FROM pages), f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM u GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"""WITH {_FOLDERS} SELECT u.path, arg_max(folder, length(folder)) AS folder FROM (SELECT DISTINCT path FROM u) u LEFT JOIN f ON starts_with(u.path, f.folder || '/') GROUP BY 1""")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    u = _url_paths(spark, d)
    folders = u.groupBy(paths.dirname("path").alias("folder")).count().where("count >= 2")
    return rel.nearest_ancestor(u, folders, path="path", folder="folder").select("path", "folder")


@query(f"""WITH u AS (SELECT DISTINCT {_URL} AS spec FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) || '/' || string_split({_route('url')}, '/')[2] AS id FROM pages WHERE starts_with(url, 'https')
UNION SELECT {_URL} FROM pages WHERE starts_with(url, 'https'))
SELECT u.spec, arg_max(id, length(id)) AS id FROM u LEFT JOIN k ON u.spec = k.id OR starts_with(u.spec, k.id || '/') GROUP BY 1""")
def prefix_join_longest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    host, route = F.regexp_extract("url", "://([^/?#]+)", 1), keys.route_path("url")
    secure = p.where(F.col("url").startswith("https"))
    known = secure.select(F.concat(host, F.lit("/"), F.get(F.split(route, "/"), F.lit(1))).alias("id")).union(secure.select(F.concat(host, route)))
    return rel.longest_prefix(p.select(F.concat(host, route).alias("spec")), known, spec="spec", ident="id", sep="/").select("spec", "id")


@query("""WITH t AS (SELECT DISTINCT p_type AS owner, p_size || ' ' || unnest(string_split(p_name, ' ')) AS token FROM part),
o AS (SELECT token, min(owner) AS owner FROM t GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY token) AS rank FROM o) SELECT owner, token, rank::BIGINT AS rank FROM r WHERE rank <= 25""")
def unique_token_match(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_type").alias("owner"), "p_size", F.explode(F.split("p_name", " ")).alias("t")).select("owner", F.concat("p_size", F.lit(" "), "t").alias("token"))
    return rel.cap_per_key(rel.sole_owner(t, token=["token"], owner="owner"), ["owner"], ["token"], 25).select("owner", "token", long("rank"))


@query("""WITH c AS (SELECT DISTINCT l_partkey AS part, 'r' || n_regionkey || '/n' || n_nationkey || '/s' || l_suppkey AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT part, 'r' || (part % 5) || '/n' || (part % 25) || '/p' || part AS path, target FROM c), s AS (SELECT *, string_split(path, '/') AS a, string_split(target, '/') AS b FROM p),
k AS (SELECT *, len(list_filter(range(1, 4), lambda i: list_slice(a, 1, i) = list_slice(b, 1, i))) AS cpl FROM s)
SELECT part, target FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY a[1] = b[1] DESC, cpl DESC, target DESC) AS r FROM k) WHERE r = 1""")
def best_provider(spark: SparkSession, d: str) -> DataFrame:
    li, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/s"), "s_suppkey").alias("target"))
    pairs = li.select("l_partkey", "l_suppkey").distinct().join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("l_partkey")
    pairs = pairs.select(k.alias("part"), F.concat(F.lit("r"), k % 5, F.lit("/n"), k % 25, F.lit("/p"), k).alias("path"), "target")
    return resolve.best_provider(pairs, ["part"]).select("part", "target")


_RANKED = """WITH s AS (SELECT user_id::VARCHAR AS id, event_type AS kind, round(value / 100, 4) AS confidence, length(event_type)::BIGINT AS priority FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, priority, kind DESC) AS n FROM s)
SELECT id, kind, confidence, priority, (SELECT string_agg(DISTINCT x.kind, ',' ORDER BY x.kind) FROM s x WHERE x.id = r.id) AS evidence FROM r WHERE n = 1"""


@query(_RANKED)
def seed_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    id_ = F.col("user_id").cast("string")
    s = e.select(id_.alias("id"), id_.alias("file"), F.lit(None).cast("string").alias("symbol"), F.col("event_type").alias("kind"), F.round(F.col("value") / 100, 4).alias("confidence"), F.length("event_type").alias("priority"), F.array("event_type").alias("evidence"), F.lit("events").alias("source"))
    return seeds.ranked(s).select("id", "kind", "confidence", long("priority"), joined("evidence"))


_RULE_DOCS = r"""WITH f AS (SELECT source || '/' || doc_id || '.py' AS path, coalesce(text, '') AS t FROM documents)
SELECT path AS file, CASE WHEN regexp_matches(t, '(?i)\bpublic\b') THEN 'public' ELSE 'mail' END AS kind,
CASE WHEN regexp_matches(t, '(?i)\bpublic\b') THEN 0.9 WHEN regexp_matches(t, 'https?://') THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
FROM f WHERE regexp_matches(t, '(?i)\bpublic\b') OR regexp_matches(t, '[a-z]+@[a-z]+\.')"""


@query(_RULE_DOCS)
def seed_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = (
        seeds.Rule(None, "public", 0.9, 1, "public", "words", text=(r"(?i)\bpublic\b",)),
        seeds.Rule(None, "mail", 0.6, 2, "mail", "words", text=(r"[a-z]+@[a-z]+\.",), boosts=(("text", r"https?://", 0.8, "link"),)),
    )
    f = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.col("text").alias("content"))
    return seeds.ranked(seeds.by_rules(f, rules)).select("file", "kind", "confidence")


@query("""WITH t AS (SELECT p_brand AS file, p_type AS package, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT package, sum(n) AS i, count(*) AS f, list(file ORDER BY file)[1:5] AS s FROM t GROUP BY 1)
SELECT package, i::BIGINT AS import_count, f::BIGINT AS file_count, array_to_string(s, ',') AS sample_files FROM g ORDER BY i DESC, package LIMIT 20""")
def third_party_usage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("package"))
    return imports.usage(t).select("package", long("import_count"), long("file_count"), joined("sample_files"))


@query("SELECT event_type AS style, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS n FROM events GROUP BY 1")
def import_style_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.create_map("event_type", F.get_json_object("props", "$.k").try_cast("long")).alias("import_style_counts"))
    return summary.style_totals(e).select("style", long("n"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def alias_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return rel.inverted(table(spark, d, "part"), "p_brand", "p_type", "types").select("p_brand", joined("types"))


# == coverage and roll-ups


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    return rel.missing_from(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def covered_semi(spark: SparkSession, d: str) -> DataFrame:
    c = rel.covered_by(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return rel.counted(c, ["c_mktsegment"]).select("c_mktsegment", long("n"))


@query("""SELECT count(*)::BIGINT AS eligible, count(l.doc_id)::BIGINT AS covered, (count(*) - count(l.doc_id))::BIGINT AS missing, round(count(l.doc_id) / count(*), 4) AS ratio
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = rel.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return c.select(long("eligible"), long("covered"), long("missing"), "ratio")


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS discovered, (SELECT count(DISTINCT doc_id) FROM labels)::BIGINT AS bundled,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing_by_node_id,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0))::BIGINT AS missing_by_file,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing""")
def discovery_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    i = F.col("doc_id").cast("string")
    n = table(spark, d, "labels").select(i.alias("id"), F.when(F.col("toxic") == 0, i).alias("file"))
    t = nd.discovery(m, n)
    return t.select(*[long(c) for c in ("discovered", "bundled", "missing_by_node_id", "missing_by_file", "missing")])


@query("""WITH f AS (SELECT n_regionkey AS package, s_name AS file, n_name, CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 1000 THEN 'warn' ELSE 'ok' END AS st, s_suppkey AS loc FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT package, count(*)::BIGINT AS files, min(file) AS file, CASE WHEN bool_or(st = 'error') THEN 'error' WHEN bool_or(st = 'warn') THEN 'warn' ELSE 'ok' END AS parse_status, sum(loc)::BIGINT AS loc,
string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS imports FROM f GROUP BY 1""")
def package_rollup(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    st = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 1000, "warn").otherwise("ok")
    f = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("package"), F.col("s_name").alias("file"), F.array("n_name").alias("imports"), st.alias("parse_status"), F.col("s_suppkey").alias("loc"))
    return nd.package_rollup(f).select("package", long("files"), "file", "parse_status", long("loc"), joined("imports"))


_ZONED = """f AS (SELECT r_name || '/' || n_name || '/' || s_name || '.py' AS id, r_name || '.' || n_name AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || 'all.py', r_name FROM region)"""


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    ids = j.select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "s_name", F.lit(".py")).alias("id")).union(r.select(F.concat("r_name", F.lit("/all.py"))))
    return ids.withColumn("file", F.col("id"))


@query(f"""WITH {_ZONED}, g AS (SELECT package, count(*) AS n, min(id) AS seed_id, CASE WHEN contains(package, '.') THEN 1 ELSE 0 END AS level, CASE WHEN contains(package, '.') THEN string_split(package, '.')[1] ELSE '<root>' END AS parent FROM f GROUP BY 1)
SELECT package AS zone_id, row_number() OVER (ORDER BY level, package)::BIGINT AS seq, seed_id, level::BIGINT AS level, parent AS parent_zone_id,
(2 * (dense_rank() OVER (ORDER BY level, CASE WHEN level = 0 THEN '' ELSE parent END) - 1))::BIGINT AS lane, (2 * (row_number() OVER (PARTITION BY level, parent ORDER BY n DESC, package) - 1))::BIGINT AS "column",
ceil(sqrt(n))::BIGINT AS footprint_columns, ceil(n / ceil(sqrt(n)))::BIGINT AS footprint_lanes, n::BIGINT AS n,
coalesce((SELECT string_agg(k.package, ',' ORDER BY k.package) FROM g k WHERE k.level = 1 AND k.parent = g.package), '') AS children FROM g""")
def zones_layout(spark: SparkSession, d: str) -> DataFrame:
    z = zones.build(_zoned(spark, d))
    ints = ("seq", "level", "lane", "column", "footprint_columns", "footprint_lanes", "n")
    return z.select("zone_id", "seed_id", "parent_zone_id", *[long(c) for c in ints], joined("children"))


@query(f"""WITH {_ZONED}, g AS (SELECT package AS zone_id, CASE WHEN contains(package, '.') THEN 1 ELSE 0 END AS level, count(*) AS members FROM f GROUP BY 1)
SELECT zone_id, level::BIGINT AS level, members::BIGINT AS members FROM g ORDER BY g.members DESC, zone_id LIMIT 15""")
def largest_zones(spark: SparkSession, d: str) -> DataFrame:
    return zones.largest(zones.build(_zoned(spark, d))).select("zone_id", long("level"), long("members"))


@query("""SELECT 'n' || s_nationkey AS from_zone, 'n' || c_nationkey AS to_zone, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey GROUP BY 1, 2 ORDER BY n DESC, from_zone, to_zone LIMIT 15""")
def cross_zone_edges(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("zone_id"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("zone_id"))
    return zones.cross_edges(e, s.union(c)).select("from_zone", "to_zone", long("n"))


# == summary

_RISK = """WITH g AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS imp, sum(l_quantity)::BIGINT AS sloc, min(l_linenumber) AS z FROM lineitem GROUP BY 1),
x AS (SELECT s_suppkey AS id, coalesce(imp, 0) % 40 AS imp, coalesce(sloc, 0) AS sloc, 1000 AS loc, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 1000 THEN 0.01 ELSE 0.5 END::DOUBLE AS pct, s_nationkey AS size FROM supplier LEFT JOIN g ON id = s_suppkey),
y AS (SELECT *, 3 * imp + CASE WHEN sloc > 0 THEN sloc / 80 ELSE loc / 100 END + coalesce((1 - pct) * 10, 0) + CASE WHEN size > 1 THEN 2 * size ELSE 0 END AS score FROM x)
SELECT id, round(score, 1) AS risk_score, imp::BIGINT AS blast_radius, array_to_string(list_filter([CASE WHEN imp > 10 THEN imp || ' importers (high blast radius)' END, CASE WHEN sloc > 500 THEN sloc || ' SLOC (large code module)' WHEN sloc <= 0 THEN '1000 LOC (large module)' END,
CASE WHEN pct < 0.05 AND sloc > 200 THEN 'low comment density' END, CASE WHEN size > 1 THEN 'in ' || size || '-module cycle (conceptual/TC)' END], lambda v: v IS NOT NULL), '; ') AS reasons
FROM y WHERE score > 30 OR imp > 15 ORDER BY risk_score DESC, id LIMIT 10"""


@query(_RISK)
def change_risk(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_orderkey").alias("imp"), F.sum("l_quantity").cast("long").alias("q"))
    s = table(spark, d, "supplier").join(g, "s_suppkey", "left")
    pct = F.when(F.col("s_acctbal") < 0, F.lit(None)).when(F.col("s_acctbal") < 1000, F.lit(0.01)).otherwise(F.lit(0.5))
    n = s.select(F.col("s_suppkey").alias("id"), (F.coalesce("imp", F.lit(0)) % 40).alias("importers_count"), F.coalesce("q", F.lit(0)).alias("sloc"), F.lit(1000).alias("loc"), pct.alias("comment_pct"), F.col("s_nationkey").alias("scc_size"), F.lit(1).alias("scc_size_runtime"))
    return summary.risky(n).select("id", "risk_score", long("blast_radius"), joined("reasons", "; "))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]{4,}')) AS v FROM documents)
SELECT v AS var, count(*)::BIGINT AS uses, regexp_matches(lower(v), 'key|secret|password|token|credential|private') AS is_secret FROM t GROUP BY v ORDER BY uses DESC, var LIMIT 15""")
def environment_top(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]{4,}"), F.lit(0))).alias("var"))
    return summary.environment(refs).select("var", long("uses"), "is_secret")


@query("""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]*(?:key|secret|password|token|credential|private)[A-Za-z_]*')) AS v FROM documents) SELECT count(DISTINCT v)::BIGINT AS total_vars, count(*)::BIGINT AS total_references FROM t""")
def secret_totals(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z_]*(?:{summary.SECRET})[A-Za-z_]*"), F.lit(0))).alias("var"))
    return summary.environment_totals(refs).select(long("total_vars"), long("total_references"))


@query(r"""WITH f AS (SELECT regexp_matches(lower(string_split(url, '/')[-1]), 'test_|_test\.|\.test\.|spec\.|_spec\.') AS t FROM pages)
SELECT count(*) FILTER (t)::BIGINT AS test_files, count(*) FILTER (NOT t)::BIGINT AS source_files, round(count(*) FILTER (t) / nullif(count(*) FILTER (NOT t), 0), 3) AS test_to_source_ratio FROM f""")
def test_source_ratio(spark: SparkSession, d: str) -> DataFrame:
    return summary.testing(table(spark, d, "pages"), "url").select(long("test_files"), long("source_files"), "test_to_source_ratio")


@query("""SELECT count(*) FILTER (role <> 'system')::BIGINT AS total_functions, count(*) FILTER (role = 'assistant' AND text <> '')::BIGINT AS functions_with_docstrings, round(avg(turn) FILTER (role <> 'system'), 2) AS avg_params_per_function,
count(*) FILTER (role = 'system')::BIGINT AS total_classes, round(count(*) FILTER (role = 'assistant' AND text <> '') / nullif(count(*) FILTER (role <> 'system'), 0), 3) AS docstring_coverage FROM conversations""")
def api_surface_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    f = c.where("role <> 'system'").select(F.when(F.col("role") == "assistant", F.col("text")).alias("docstring"), F.col("turn").alias("n_params"))
    s = summary.api_surface(f, c.where("role = 'system'"))
    return s.select(long("total_functions"), long("functions_with_docstrings"), "avg_params_per_function", long("total_classes"), "docstring_coverage")


@query("""WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(a.s, b.s) AS parse_status, coalesce(a.n, b.n)::BIGINT AS n FROM a FULL JOIN b ON a.s = b.s""")
def parse_states(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select(F.col("o_orderstatus").alias("parse_status")), table(spark, d, "lineitem").select(F.col("l_returnflag").alias("parse_status"))
    return summary.parse_states(a, b).select("parse_status", long("n"))


@query("""SELECT doc_id AS id, source AS file, lang AS name, n_chars::BIGINT AS loc FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15""")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("name"), F.col("n_chars").alias("loc"))
    return summary.largest_files(n).select("id", "file", "name", long("loc"))


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS nodes, (SELECT count(*) FROM lineitem)::BIGINT AS edges, (SELECT count(*) FROM nation)::BIGINT AS zones")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.counts(nodes=table(spark, d, "part"), edges=table(spark, d, "lineitem"), zones=table(spark, d, "nation"))


@query("SELECT string_agg(DISTINCT trim(lang), ',' ORDER BY trim(lang)) AS languages, CASE WHEN count(DISTINCT trim(lang)) > 1 THEN 'polyglot' ELSE coalesce(min(trim(lang)), 'unknown') END AS language FROM documents WHERE trim(lang) <> ''")
def bundle_languages(spark: SparkSession, d: str) -> DataFrame:
    return summary.languages(table(spark, d, "documents")).select(joined("languages"), "language")


# == codec

_LEGEND = f"""WITH u AS (SELECT DISTINCT {_URL} AS path FROM pages), i AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS path_id, regexp_extract(path, '^(.*/)', 1) AS prefix, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM u),
p AS (SELECT prefix, row_number() OVER (ORDER BY min(path_id)) - 1 AS prefix_id FROM i GROUP BY prefix)"""


@query(f"{_LEGEND} SELECT path, path_id::BIGINT AS path_id, prefix, prefix_id::BIGINT AS prefix_id, leaf FROM i JOIN p USING (prefix)")
def path_legend_ids(spark: SparkSession, d: str) -> DataFrame:
    return codec.path_dictionary(_url_paths(spark, d)).select("path", long("path_id"), "prefix", long("prefix_id"), "leaf")


@query(f"{_LEGEND} SELECT {_URL} AS path, page_id FROM pages")
def path_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    u = _url_paths(spark, d)
    legend = codec.path_dictionary(u)
    coded = codec.encode_column(u, "path", legend, "path", "path_id")
    return coded.join(codec.decode_paths(legend).withColumnRenamed("path", "p"), F.col("path") == F.col("path_id")).select(F.col("p").alias("path"), "page_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '1' WHEN 'purchase' THEN '2' ELSE event_type END AS code, event_type AS decoded FROM events")
def enum_codes(spark: SparkSession, d: str) -> DataFrame:
    known = ("view", "click", "purchase")
    e = table(spark, d, "events").select("event_id", paths.enum_code(F.col("event_type"), known).alias("code"))
    return e.withColumn("decoded", paths.enum_value(F.col("code"), known))


@query("SELECT '[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']' AS value FROM nation")
def row_encoding(spark: SparkSession, d: str) -> DataFrame:
    return codec.row_lines(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))[1]


# == source facts


@query()
def source_facts(spark: SparkSession, d: str) -> DataFrame:
    """Parse state, imports and symbols of every document taken as a source of its path's language; compared with plain calls in the tests."""
    f = document_files(spark, d).select("path", "lang", F.col("text").alias("content"))
    return extract.facts(f).select("path", "lang", "parse_status", F.size("imports").alias("imports"), F.size("symbols").alias("symbols"), F.size("candidates").alias("candidates"))


@query(r"""SELECT source || '/' || doc_id AS src, 'pkg/' || lang || '/x.py' AS dst FROM documents""")
def package_edges_collapsed(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("src"), "lang")
    deep, init = F.concat(F.lit("pkg/"), "lang", F.lit("/x.py")), F.concat(F.lit("pkg/"), "lang", F.lit("/__init__.py"))
    return ed.collapse_package_edges(doc.select("src", F.explode(F.array(deep, init, F.lit("pkg/__init__.py"))).alias("dst"))).select("src", "dst")
