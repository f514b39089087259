"""The registered queries of the graph operators, each beside its oracle SQL.

Graphs: ``g1`` part grid (50 wide, part key = cell, passable unless p_size is a multiple of 4), ``g2``
event successors of a user with back arcs, ``g3`` suppliers and parts. Queries and oracles take whole
tables, all seeds and depths and the whole workload of 2000 pairs. Where SQL would be too slow on whole
tables, or where there is nothing to compute it from, a query has none and is tested by brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import campaign
from .functions import terrain, text
from .operators import bits, blocks, components, density, generators, grid, measures, reach, tiles
from .plans.checkpoints import cut_compact, shared_dir, written
from .sources import maps, pictures

W, TILE = 50, 4
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


# Fixtures ------------------------------------------------------------------------------------


def cells(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return grid.with_coordinates(part.select(F.col("p_partkey").alias("v"), (F.col("p_size") % 4 != 0).alias("passable")), W)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return grid.adjacent_pairs(cells(spark, d), W)


def edges(mode: str, spark: SparkSession, d: str) -> DataFrame:
    return grid.orient(pairs(spark, d), mode)


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "value")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    arcs = e.withColumn("after", after).filter("after IS NOT NULL")
    back = F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.col("event_id").alias("src"), F.col("after").alias("dst")), F.struct(F.col("after").alias("src"), F.col("event_id").alias("dst"))))
    return arcs.select(F.explode(F.coalesce(back, F.array(F.struct(F.col("event_id").alias("src"), F.col("after").alias("dst"))))).alias("e")).select("e.src", "e.dst")


def supplies(spark: SparkSession, d: str, distinct: bool = True) -> DataFrame:
    """Suppliers have even numbers and parts odd ones; the part's parity turns the arc."""
    p, s = F.col("l_partkey") * 2 + 1, F.col("l_suppkey") * 2
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey")
    return (li.distinct() if distinct else li).select(F.when(F.col("l_partkey") % 2 == 0, s).otherwise(p).alias("src"), F.when(F.col("l_partkey") % 2 == 0, p).otherwise(s).alias("dst"))


def passable(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).filter("passable").select("v")


def searched(mode: str, spark: SparkSession, d: str) -> blocks.Search:
    """From all passable cells."""
    return blocks.search(blocks.build(edges(mode, spark, d)), passable(spark, d).select(F.col("v").alias("seed")))


def _drawn(k: int, i: str) -> str:
    """A number below 10^12 for the ``i``-th draw on side ``k``, the same in any engine."""
    u = f"(({i} * 7919 + {k * 104729}) % {grid.PRIME})"
    w = f"(({i} * 6007 + {k * 75931 + 12345}) % {grid.PRIME})"
    return f"((({u} * {u}) % {grid.PRIME}) * {grid.PRIME} + ({w} * {w} + {u}) % {grid.PRIME})"


def workload(spark: SparkSession, d: str, n: int = 2000) -> DataFrame:
    """Pairs of cells with replacement; a cell is met by its rank, so all are."""
    ranked = cut_compact(components.dense_labels(cells(spark, d).select("v", F.col("v").alias("component"))).select(F.col("label").alias("k"), "v"), 200_000)
    size = ranked.count()
    asked = spark.range(n).select(F.col("id").alias("qid"), *[F.expr(f"{_drawn(k, 'id')} % {max(1, size)}").alias(side) for k, side in ((1, "a"), (2, "b"))])
    found = asked.hint("broadcast").join(ranked.toDF("a", "source"), "a").hint("broadcast").join(ranked.toDF("b", "target"), "b")  # the draws go to the cells
    return cut_compact(found.select("qid", "source", "target"))


_CELLS = f"cells AS (SELECT p_partkey AS v, p_partkey % {W} AS x, p_partkey // {W} AS y, p_size % 4 <> 0 AS passable FROM part)"
_PAIRS = f"""{_CELLS}, pairs AS (SELECT a.v AS a, b.v AS b, 0 AS dir FROM cells a JOIN cells b ON b.v = a.v + 1 AND b.y = a.y WHERE a.passable AND b.passable
  UNION ALL SELECT a.v, b.v, 1 FROM cells a JOIN cells b ON b.v = a.v + {W} WHERE a.passable AND b.passable)"""


def _hash(k: int) -> str:
    u = f"((a * 7919 + b * 104729 + {k * 1299709}) % 1000003)"
    return f"((({u} * {u}) % 1000003) % 1000)"


_KIND = {
    "acyclic": "1", "bidirectional": "3", "random": f"CASE WHEN {_hash(0)} < 250 THEN 3 WHEN {_hash(0)} < 400 THEN CASE WHEN {_hash(1)} < 500 THEN 1 ELSE 2 END ELSE 0 END",
    "gradient": f"CASE WHEN {_hash(0)} < 250 THEN 3 WHEN {_hash(1)} < 50 THEN 2 ELSE 1 END",
}


def _edges(mode: str) -> str:
    return f"""{_PAIRS}, kinds AS (SELECT a, b, {_KIND[mode]} AS kind FROM pairs),
  edges AS (SELECT a AS src, b AS dst FROM kinds WHERE kind IN (1, 3) UNION ALL SELECT b, a FROM kinds WHERE kind IN (2, 3))"""


def _reach(mode: str) -> str:
    return f"{_edges(mode)}, reach AS (SELECT v AS src, v AS dst FROM cells WHERE passable UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


_EVENTS = """s AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events),
  edges AS (SELECT event_id AS src, after AS dst FROM s WHERE after IS NOT NULL UNION ALL SELECT after, event_id FROM s WHERE after IS NOT NULL AND event_id % 3 = 0)"""
_WORKLOAD = f"""ranked AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM cells), sized AS (SELECT count(*) AS n FROM cells),
  drawn AS (SELECT i AS qid, {_drawn(1, "i")} % n AS a, {_drawn(2, "i")} % n AS b FROM range(2000) t(i), sized),
  pairs_ AS (SELECT qid, x.v AS source, y.v AS target FROM drawn JOIN ranked x ON x.k = a JOIN ranked y ON y.k = b)"""


def _answers(mode: str) -> str:
    return f"""WITH RECURSIVE {_reach(mode)}, {_WORKLOAD}
SELECT qid, source, target, source = target OR r.src IS NOT NULL AS reachable FROM pairs_ LEFT JOIN reach r ON r.src = source AND r.dst = target"""


# Grid and edges ------------------------------------------------------------------------------

_query(f"WITH {_CELLS} SELECT * FROM cells", "grid_cells")(cells)
_query(f"WITH {_PAIRS} SELECT * FROM pairs", "grid_adjacent_pairs")(pairs)
for _m in ("acyclic", "bidirectional", "random", "gradient"):
    _query(f"WITH {_edges(_m)} SELECT * FROM edges", f"edges_{_m}")(partial(edges, _m))


@_query(f"WITH {_CELLS} SELECT count(*) AS cells, count(*) FILTER (WHERE passable) AS passable FROM cells")
def grid_passable_count(spark, d):
    return cells(spark, d).agg(F.count("*").alias("cells"), F.count_if("passable").alias("passable"))


@_query(f"WITH {_edges('random')} SELECT src, count(*) AS degree FROM edges GROUP BY src")
def out_degree(spark, d):
    return edges("random", spark, d).groupBy("src").agg(F.count("*").alias("degree"))


@_query(f"WITH {_edges('random')} SELECT dst AS src, src AS dst FROM edges")
def transpose_edges(spark, d):
    return grid.transpose(edges("random", spark, d))


@_query(f"WITH {_edges('bidirectional')} SELECT src, dst FROM edges WHERE src % {W} BETWEEN 5 AND 20 AND dst % {W} BETWEEN 5 AND 20")
def induced_subgraph(spark, d):
    return grid.induced(edges("bidirectional", spark, d), cells(spark, d).filter("x BETWEEN 5 AND 20"))


@_query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edge_dedup(spark, d):
    arcs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return grid.checked_edges(arcs, 1 << 32)


_ALONG = f"CASE WHEN {_hash(0)} < 250 THEN 3 WHEN ({_hash(1)} < 50) = (dir = 1) THEN 2 ELSE 1 END"


@_query(f"""WITH {_PAIRS}, kinds AS (SELECT a, b, {_ALONG} AS kind FROM pairs)
SELECT a AS src, b AS dst FROM kinds WHERE kind IN (1, 3) UNION ALL SELECT b, a FROM kinds WHERE kind IN (2, 3)""")
def edges_gradient_135(spark, d):
    """The gradient points west and south."""
    return grid.orient(pairs(spark, d), "gradient", angle=135)


@_query(f"WITH {_CELLS} SELECT v, x, y, CASE WHEN v % 10 = 0 THEN true ELSE passable END AS passable FROM cells")
def grid_changed(spark, d):
    c = cells(spark, d)
    return grid.set_passable(c, c.filter("v % 10 = 0").select("v", F.lit(True).alias("passable")))


@_query(f"""WITH {_CELLS} SELECT a.v, CAST(a.v % 4 AS INTEGER) AS dir, b.v AS next FROM cells a LEFT JOIN cells b ON b.passable
  AND b.x = a.x + CASE a.v % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AND b.y = a.y + CASE a.v % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END""")
def grid_neighbors(spark, d):
    c = cells(spark, d)
    return grid.neighbors(c, c.select("v", (F.col("v") % 4).cast("int").alias("dir")))


# Generators ----------------------------------------------------------------------------------


def _coin(a: str, b: str) -> str:
    u = f"(({a} * 7919 + {b} * 104729) % 1000003)"
    return f"((({u} * {u}) % 1000003) % 1000)"


def _suppliers(spark, d) -> int:
    return spark.read.parquet(f"{d}/supplier.parquet").count()


_WEST = f"(x // 2 > 0 AND (y // 2 = 0 OR {_coin('(x // 2)', '(y // 2)')} < 500))"


@_query(f"""WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT i AS v, i % (2 * n + 1) AS x, i // (2 * n + 1) AS y, n FROM n, range(61 * (SELECT 2 * count(*) + 1 FROM supplier)) t(i))
SELECT v, x, y, x BETWEEN 1 AND 2 * n - 1 AND y BETWEEN 1 AND 59 AND (x % 2 = 1 AND y % 2 = 1 OR x % 2 = 0 AND y % 2 = 1 AND {_WEST} OR x % 2 = 1 AND y % 2 = 0 AND NOT {_WEST} AND y // 2 > 0) AS passable FROM c""")
def maze_perfect(spark, d):
    """As many rooms wide as there are suppliers, 30 high."""
    return generators.perfect_maze(spark, _suppliers(spark, d), 30)


@_query()
def maze_spanning(spark, d):
    """A room for each part, joined by a minimum spanning forest of hashed walls."""
    return generators.spanning_maze(cells(spark, d), W)


@_query()
def maze_opened(spark, d):
    """The maze with 100 further openings."""
    return generators.open_walls(maze_perfect(spark, d), 100)


@_query(f"WITH n AS (SELECT count(*) AS n FROM supplier) SELECT a.i AS src, b.i AS dst FROM n, range((SELECT count(*) FROM supplier)) a(i), range((SELECT count(*) FROM supplier)) b(i) WHERE a.i <> b.i AND {_coin('a.i', 'b.i')} < 50")
def graph_random(spark, d):
    return generators.random_graph(spark, _suppliers(spark, d), 0.05)


@_query(f"WITH n AS (SELECT count(*) AS n FROM supplier) SELECT a.i AS src, b.i AS dst FROM n, range((SELECT count(*) FROM supplier)) a(i), range((SELECT count(*) FROM supplier)) b(i) WHERE a.i < n // 2 AND b.i >= n // 2 AND {_coin('a.i', 'b.i')} < 50")
def graph_bipartite(spark, d):
    return generators.bipartite(spark, _suppliers(spark, d), 0.05)


_query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey - m AS src, s_suppkey - m + 1 AS dst FROM supplier, n, (SELECT min(s_suppkey) AS m FROM supplier) WHERE s_suppkey - m < n - 1", "graph_chain")(lambda spark, d: generators.chain(spark, _suppliers(spark, d)))
_query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey - m AS src, (s_suppkey - m + 1) % n AS dst FROM supplier, n, (SELECT min(s_suppkey) AS m FROM supplier)", "graph_cycle")(lambda spark, d: generators.cycle(spark, _suppliers(spark, d)))
_query("SELECT CAST(0 AS BIGINT) AS src, i AS dst FROM range((SELECT count(*) FROM supplier)) t(i) WHERE i > 0", "graph_star")(lambda spark, d: generators.star(spark, _suppliers(spark, d)))
_query("SELECT a.i AS src, b.i AS dst FROM range((SELECT count(*) FROM supplier)) a(i), range((SELECT count(*) FROM supplier)) b(i) WHERE a.i <> b.i", "graph_complete")(lambda spark, d: generators.complete(spark, _suppliers(spark, d)))
_query(name="graph_separate")(lambda spark, d: generators.separate_random_graphs(spark, _suppliers(spark, d), 8, 0.2))


# Search --------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {_reach('acyclic')} SELECT src AS seed, count(*) AS reached FROM reach GROUP BY src")
def reach_count(spark, d):
    return searched("acyclic", spark, d).counts()


@_query(f"WITH RECURSIVE {_reach('random')} SELECT src AS seed, dst AS v FROM reach")
def reach_set(spark, d):
    return reach.reached(edges("random", spark, d), passable(spark, d).select(F.col("v").alias("seed")))


_SUPPLIES = """arcs AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN l_suppkey * 2 ELSE l_partkey * 2 + 1 END AS src, CASE WHEN l_partkey % 2 = 0 THEN l_partkey * 2 + 1 ELSE l_suppkey * 2 END AS dst FROM lineitem)"""


# A depth beyond 12 in this graph would show as rows that only the query has.
@_query(f"""WITH RECURSIVE {_SUPPLIES}, h AS (SELECT DISTINCT src AS seed, src AS v, 0 AS depth FROM arcs WHERE src % 20 = 0
  UNION SELECT seed, dst, depth + 1 FROM h JOIN arcs ON v = src WHERE depth < 12) SELECT seed, v, min(depth) AS depth FROM h GROUP BY seed, v""")
def hop_depth(spark, d):
    """Hops from every vertex with arcs whose id is divisible by 20."""
    e = supplies(spark, d, distinct=False)
    return reach.frontier(e, e.filter("src % 20 = 0").select(F.col("src").alias("seed")).distinct())


def _search(mode, spark, d):
    """By a search that ends with the last open pair; its order can't be seen in the answer."""
    return reach.answer_by_search(workload(spark, d), edges(mode, spark, d))


for _name in ("reach_pairs_bfs", "reach_pairs_dfs"):
    _query(_answers("random"), _name)(partial(_search, "random"))
_query(_answers("acyclic"), "dag_reach")(partial(_search, "acyclic"))


def _by_closure(mode, spark, d):
    return reach.answer_by_closure(workload(spark, d), edges(mode, spark, d))


_query(_answers("random"), "pairs_full_closure")(partial(_by_closure, "random"))
_query(_answers("gradient"), "pairs_full_closure_gradient")(partial(_by_closure, "gradient"))


def _by_components(closure, spark, d):
    e = cut_compact(edges("random", spark, d))
    return reach.answer_by_components(workload(spark, d), e, cut_compact(reach.strong_components(e)), closure)


_query(_answers("random"), "pairs_scc_search")(partial(_by_components, False))
_query(_answers("random"), "pairs_scc_closure")(partial(_by_components, True))


# Components ----------------------------------------------------------------------------------

_CC = f"""WITH RECURSIVE {_EVENTS}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT DISTINCT user_id, min(event_id) OVER (PARTITION BY user_id) AS component, event_id AS v,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@_query(f"{_CC} SELECT v, component FROM c WHERE n > 1")
def cc_labels(spark, d):
    return components.connected_components(events(spark, d))


@_query(f"{_CC} SELECT component, count(*) AS size FROM c WHERE n > 1 GROUP BY component")
def cc_sizes(spark, d):
    return cc_labels(spark, d).groupBy("component").agg(F.count("*").alias("size"))


@_query(f"{_CC} SELECT max(size) AS largest FROM (SELECT count(*) AS size FROM c GROUP BY component)")
def largest_cc(spark, d):
    return cc_sizes(spark, d).agg(F.max("size").alias("largest"))


@_query(f"{_CC} SELECT v, component, dense_rank() OVER (ORDER BY component) - 1 AS label FROM c WHERE n > 1")
def cc_dense(spark, d):
    return components.dense_labels(cc_labels(spark, d))


@_query(f"{_CC}, asked AS (SELECT v, component FROM c WHERE n > 1 AND v % 100 < 3) SELECT a.v AS probe, c.v FROM asked a JOIN c USING (component)")
def cc_members(spark, d):
    """The components of some probes, which are the query's question."""
    labels = cut_compact(cc_labels(spark, d))
    return components.members(labels, labels.filter("v % 100 < 3"))


@_query(f"""WITH RECURSIVE {_edges('random')}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT a AS v, a AS m FROM u UNION SELECT c.v, u.b FROM c JOIN u ON c.m = u.a)
SELECT v, min(m) AS component FROM c GROUP BY v""")
def cc_grid(spark, d):
    """Of a graph with branches and cycles, each vertex with the smallest one that it is connected with."""
    return components.connected_components(edges("random", spark, d))


@_query(f"WITH RECURSIVE {_reach('bidirectional')}, c AS (SELECT src, min(dst) AS component FROM reach GROUP BY src) SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM c GROUP BY component)")
def cc_passable(spark, d):
    """Connected passable areas, single cells among them."""
    labels = components.with_isolated(components.connected_components(pairs(spark, d), "a", "b"), passable(spark, d))
    return labels.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


_SCC = f"""{_reach('random')}, scc AS (SELECT a.src AS v, min(b.src) AS comp FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


def _scc(spark, d):
    found = reach.strong_components(edges("random", spark, d))
    return passable(spark, d).join(found, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))


_query(f"WITH RECURSIVE {_SCC} SELECT v, comp FROM scc", "scc_labels")(_scc)


@_query(f"WITH RECURSIVE {_SCC} SELECT size, count(*) AS comps FROM (SELECT count(*) AS size FROM scc GROUP BY comp) GROUP BY size")
def scc_sizes(spark, d):
    return _scc(spark, d).groupBy("comp").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("comps"))


@_query(f"WITH RECURSIVE {_SCC} SELECT DISTINCT a.comp AS csrc, b.comp AS cdst FROM edges JOIN scc a ON a.v = src JOIN scc b ON b.v = dst WHERE a.comp <> b.comp")
def condensation_edges(spark, d):
    return reach.condensation(edges("random", spark, d), _scc(spark, d))


@_query(f"""WITH RECURSIVE {_SCC} SELECT (SELECT count(*) FROM cells) AS vertices, (SELECT count(*) FROM cells WHERE passable) AS passable, (SELECT count(*) FROM edges) AS edges,
  count(*) AS sccs, max(n) AS largest_scc FROM (SELECT count(*) AS n FROM scc GROUP BY comp)""")
def graph_profile(spark, d):
    e, c = edges("random", spark, d), cells(spark, d)
    sccs = _scc(spark, d).groupBy("comp").agg(F.count("*").alias("n")).agg(F.count("*").alias("sccs"), F.max("n").alias("largest_scc"))
    counts = c.agg(F.count("*").alias("vertices"), F.count_if("passable").alias("passable"))
    return counts.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(sccs)  # one row each


@_query(f"WITH RECURSIVE {_SCC} SELECT comp AS component, count(*) AS size FROM scc GROUP BY comp")
def scc_histogram(spark, d):
    return components.size_histogram(_scc(spark, d).withColumnRenamed("comp", "component"), passable(spark, d))


@_query()
def map_profile(spark, d):
    """A manifest's row of the part grid."""
    c = cells(spark, d)
    high = (c.agg(F.max("y")).first()[0] or 0) + 1
    return campaign.profile(campaign.Map("parts", c, edges("random", spark, d), W, high))


@_query(f"""WITH RECURSIVE {_edges('random')}, s AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), u AS (SELECT src, dst FROM s UNION SELECT u.src, s.dst FROM u JOIN s ON u.dst = s.src),
  r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src),
  m AS (SELECT src AS v FROM s UNION SELECT dst FROM s), scc AS (SELECT m.v, least(m.v, coalesce(min(a.dst), m.v)) AS comp FROM m LEFT JOIN r a ON a.src = m.v AND EXISTS (SELECT 1 FROM r b WHERE b.src = a.dst AND b.dst = m.v) GROUP BY m.v),
  k AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM u GROUP BY src)) AS p, (SELECT count(DISTINCT comp) FROM scc) AS c, (SELECT max(n) FROM (SELECT count(*) AS n FROM scc GROUP BY comp)) AS l)
SELECT p AS largest_part, c AS strong_components, l AS largest_strong, CAST(ceil(log2(p)) AS INTEGER) AS squarings, CAST(least(ceil(log2(p)), ceil(log2(c + l))) AS INTEGER) AS by_structure FROM k""")
def squaring_bounds(spark, d):
    return reach.squaring_bounds(edges("random", spark, d))


# Algebra and labels --------------------------------------------------------------------------


@_query(f"WITH {_edges('gradient')} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src")
def bool_multiply(spark, d):
    e = edges("gradient", spark, d)
    return reach.multiply(e, e)


@_query(f"WITH RECURSIVE {_reach('random')} SELECT src, dst FROM reach")
def closure_squaring(spark, d):
    identity = passable(spark, d).select(F.col("v").alias("src"), F.col("v").alias("dst"))
    return reach.squaring(edges("random", spark, d).union(identity))


@_query(f"WITH RECURSIVE {_reach('gradient')} SELECT src, count(*) AS reached FROM reach GROUP BY src")
def closure_scc_compressed(spark, d):
    return reach.compressed_counts(edges("gradient", spark, d), passable(spark, d)).withColumnRenamed("v", "src")


@_query(f"WITH RECURSIVE {_reach('random')} SELECT a.v, a.n AS n_out, b.n AS n_in FROM (SELECT src AS v, count(*) AS n FROM reach GROUP BY src) a JOIN (SELECT dst AS v, count(*) AS n FROM reach GROUP BY dst) b ON a.v = b.v")
def two_hop_label_sizes(spark, d):
    """Labels with every vertex as a hub: as many as it reaches, and as reach it."""
    e, seeds = cut_compact(edges("random", spark, d)), cut_compact(passable(spark, d).select(F.col("v").alias("seed")))
    out, into = (blocks.search(blocks.build(x), seeds).counts() for x in (e, grid.transpose(e)))
    return out.toDF("v", "n_out").join(into.toDF("v", "n_in"), "v")


@_query(_answers("random"))
def pairs_two_hop(spark, d):
    """By labels of hubs in the order of their degrees, pruned where earlier ones answer."""
    return reach.answer_by_labels(workload(spark, d), *reach.landmark_labels(edges("random", spark, d)))


_RELATION = "m AS (SELECT DISTINCT l_suppkey AS i, l_linenumber AS j FROM lineitem)"


def _relation(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).distinct()


_query("SELECT l_suppkey AS i, count(DISTINCT l_partkey) AS bits FROM lineitem GROUP BY l_suppkey", "bit_row_counts")(lambda spark, d: bits.row_counts(edge_dedup(spark, d).toDF("i", "j")))
_query("SELECT l_partkey AS j, count(DISTINCT l_suppkey) AS bits FROM lineitem GROUP BY l_partkey", "bit_column_counts")(lambda spark, d: bits.column_counts(edge_dedup(spark, d).toDF("i", "j")))


@_query(f"WITH {_RELATION} SELECT i, j FROM m WHERE i % 3 <> 0 UNION SELECT i + 1, j FROM m WHERE (i + 1) % 3 <> 0")
def bit_rows_merged(spark, d):
    """Each row's bits are added to the next row; then every third row is cleared."""
    m = _relation(spark, d)
    more = bits.or_rows(m, m.select(F.col("i").alias("source"), (F.col("i") + 1).alias("target")).distinct())
    box = m.agg(F.max("i"), F.max("j")).first()
    grown = bits.set_bits(m, more, i=(box[0] or 0) + 2, j=(box[1] or 0) + 1)
    return bits.reset_bits(grown, more.filter("i % 3 = 0").select("i").distinct())


# Density and workload -------------------------------------------------------------------------


@_query(f"""WITH RECURSIVE {_reach('random')}, f AS (SELECT count(*) * 1.0 / (SELECT count(*) FROM cells WHERE passable) AS f FROM reach GROUP BY src) SELECT round(avg(f), 9) AS density, count(*) AS sources FROM f""")
def density_exact(spark, d):
    n = passable(spark, d).count()
    return searched("random", spark, d).counts().agg(F.round(F.avg(F.col("reached") / n), 9).alias("density"), F.count("*").alias("sources"))


_query(f"WITH {_CELLS}, {_WORKLOAD} SELECT qid, source, target FROM pairs_", "pair_workload")(workload)


@_query(f"SELECT count(*) AS asked, count(*) FILTER (WHERE reachable) AS positive, avg(CASE WHEN reachable THEN 1.0 ELSE 0 END) AS ratio FROM ({_answers('random')})")
def answer_stats(spark, d):
    return measures.answer_counts(_by_closure("random", spark, d), []).select("asked", "positive", F.col("reachable_ratio").alias("ratio"))


@_query(f"SELECT count(*) AS checks, count(*) FILTER (WHERE a.reachable <> b.reachable) AS mismatches FROM ({_answers('random')}) a JOIN ({_answers('gradient')}) b USING (qid)")
def answer_mismatches(spark, d):
    """Two graphs' answers to one workload."""
    return measures.mismatches(_by_closure("random", spark, d), _by_closure("gradient", spark, d))


@_query()
def workload_hash(spark, d):
    return spark.createDataFrame([(f"{measures.workload_hash(workload(spark, d)):016x}",)], "hash string")


# Statistics of runs ----------------------------------------------------------------------------


def _samples(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("method"), (F.col("l_extendedprice") * 100).cast("long").alias("ns"))


_SAMPLES = "s AS (SELECT l_returnflag AS method, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS ns FROM lineitem), g AS (SELECT method, list_sort(list(ns)) AS x, sum(ns) AS total FROM s GROUP BY method)"


@_query(f"""WITH {_SAMPLES} SELECT method, len(x) AS count, CAST(total AS BIGINT) AS total_ns, round(total / len(x), 3) AS mean_ns, x[len(x) // 2 + 1] AS median_ns, x[least(len(x) - 1, CAST(floor(len(x) * 0.95) AS BIGINT)) + 1] AS p95_ns,
  x[1] AS min_ns, x[len(x)] AS max_ns, round(len(x) / (total / 1e9), 3) AS queries_per_second FROM g""")
def timing_statistics(spark, d):
    found = measures.timing_statistics(_samples(spark, d), ["method"])
    return found.withColumn("mean_ns", F.round("mean_ns", 3)).withColumn("queries_per_second", F.round("queries_per_second", 3))


@_query(f"WITH {_SAMPLES} SELECT method, x[CAST(floor(0.1 * (len(x) - 1)) AS BIGINT) + 1] AS p10, x[CAST(floor(0.5 * (len(x) - 1)) AS BIGINT) + 1] AS p50, x[CAST(floor(0.9 * (len(x) - 1)) AS BIGINT) + 1] AS p90 FROM g")
def order_statistics(spark, d):
    return measures.order_statistics(_samples(spark, d), ["method"], "ns", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


_RUNS = """runs AS (SELECT l_linestatus AS map_id, l_returnflag AS method, 'Completed' AS status, count(*) AS count, CAST(max(l_partkey) AS BIGINT) AS preprocess_ns, CAST(min(l_suppkey) AS BIGINT) AS warmup_ns,
  CAST(sum(l_suppkey) AS BIGINT) AS query_ns, CAST(sum(l_suppkey) AS DOUBLE) / count(*) AS mean_ns FROM lineitem GROUP BY 1, 2)"""


@_query(f"""WITH {_RUNS}, t AS (SELECT *, preprocess_ns + warmup_ns + query_ns AS total_ns FROM runs)
SELECT map_id, method, total_ns, round(coalesce(max(CASE WHEN method = 'A' THEN mean_ns END) OVER w / mean_ns, 0), 9) AS speedup, round(coalesce(CAST(max(CASE WHEN method = 'A' THEN total_ns END) OVER w AS DOUBLE) / total_ns, 0), 9) AS total_speedup
FROM t WINDOW w AS (PARTITION BY map_id)""")
def run_speedups(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linestatus").alias("map_id"), F.col("l_returnflag").alias("method"))
    runs = li.agg(F.count("*").alias("count"), F.max("l_partkey").alias("preprocess_ns"), F.min("l_suppkey").alias("warmup_ns"), F.sum("l_suppkey").alias("query_ns"), F.avg("l_suppkey").alias("mean_ns")).withColumn("status", F.lit("Completed"))
    return measures.speedups(runs, ["map_id"], reference="A").select("map_id", "method", "total_ns", F.round("speedup", 9).alias("speedup"), F.round("total_speedup", 9).alias("total_speedup"))


_RESULTS = """results AS (SELECT o_custkey AS map_id, o_orderpriority AS method, o_orderkey % 3 AS config_id, CASE o_orderstatus WHEN 'F' THEN 'Completed' ELSE 'Failed' END AS status, o_orderkey % 2 AS correctness_mismatches,
  CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'c' || (o_custkey % 7) END AS map_class, o_totalprice AS queries_per_second FROM orders)"""


def _results(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("map_id"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 3).alias("config_id"), F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed").alias("status"),
        (F.col("o_orderkey") % 2).alias("correctness_mismatches"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))).alias("map_class"), F.col("o_totalprice").alias("queries_per_second"))


@_query(f"WITH {_RESULTS}, j AS (SELECT DISTINCT map_id, method, config_id FROM results) SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.status = 'Completed' AND r.map_id = j.map_id AND r.method = j.method AND r.config_id = j.config_id)")
def runs_remaining(spark, d):
    found = _results(spark, d)
    return measures.remaining(found.select("map_id", "method", "config_id").distinct(), found)


@_query(f"""WITH {_RESULTS}, k AS (SELECT * REPLACE (CASE map_class WHEN '' THEN 'unknown' ELSE map_class END AS map_class) FROM results WHERE status = 'Completed' AND correctness_mismatches = 0)
SELECT map_class, map_id, method, config_id, queries_per_second FROM k QUALIFY row_number() OVER (PARTITION BY map_class ORDER BY queries_per_second DESC, map_id, method, config_id) = 1""")
def best_by_class(spark, d):
    return measures.best_by_class(_results(spark, d))


@_query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'movingai' WHEN 1 THEN 'procedural_maze' WHEN 2 THEN 'smoke_grid' WHEN 3 THEN 'other' ELSE '' END AS g, p_partkey % 3 AS n, CASE WHEN p_partkey % 2 = 0 THEN 'mode' ELSE '' END AS o FROM part)
SELECT p_partkey, CASE WHEN g = 'movingai' THEN g WHEN g = 'procedural_maze' AND n = 0 THEN 'perfect_maze' WHEN g = 'procedural_maze' THEN 'cyclic_maze' WHEN g = 'smoke_grid' THEN g WHEN o <> '' THEN o WHEN g = '' THEN 'unknown' ELSE g END AS map_class FROM p""")
def map_classes(spark, d):
    p, size = spark.read.parquet(f"{d}/part.parquet"), F.col("p_size") % 5
    generator = F.when(size == 0, "movingai").when(size == 1, "procedural_maze").when(size == 2, "smoke_grid").when(size == 3, "other").otherwise("")
    return p.select("p_partkey", measures.map_class(generator, F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 2 == 0, "mode").otherwise("")).alias("map_class"))


# Tiles ---------------------------------------------------------------------------------------

#: Tiles up and down, less one: a last remainder of one row belongs to the tile before.
_LAST = f"(SELECT (max(y) + {TILE}) // {TILE} - 1 - CASE WHEN (max(y) + 1) % {TILE} = 1 AND max(y) + 1 > {TILE} THEN 1 ELSE 0 END FROM cells)"
_ACROSS = -(-W // TILE)


def _tile_of(x: str, y: str) -> str:
    return f"(least({y} // {TILE}, {_LAST}) * {_ACROSS} + least({x} // {TILE}, {_ACROSS - 1}))"


_TILED = f"{_CELLS}, tiled AS (SELECT *, {_tile_of('x', 'y')} AS tile FROM cells)"
_BOX = "box AS (SELECT tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tiled GROUP BY tile)"


def tiled(spark, d):
    c = cells(spark, d)
    return grid.tiles_of(c, W, (c.agg(F.max("y")).first()[0] or 0) + 1, TILE)


_query(f"WITH {_TILED} SELECT * FROM tiled", "tile_assign")(tiled)


@_query(f"""WITH {_TILED}, {_BOX} SELECT v, tile, CASE WHEN y = y0 THEN 'N' WHEN x = x1 THEN 'E' WHEN y = y1 THEN 'S' WHEN x = x0 THEN 'W' END AS side
FROM tiled JOIN box USING (tile) WHERE passable AND (y = y0 OR x = x1 OR y = y1 OR x = x0)""")
def tile_ports(spark, d):
    return grid.ports_of(tiled(spark, d))


@_query(f"WITH {_edges('random')}, t AS (SELECT v, {_tile_of('x', 'y')} AS tile FROM cells) SELECT src, dst FROM edges JOIN t a ON a.v = src JOIN t b ON b.v = dst WHERE a.tile <> b.tile")
def seam_edges(spark, d):
    return grid.seams_of(edges("random", spark, d), tiled(spark, d))


def _index(spark, d):
    """Edges, tiled cells, ports, closures inside tiles, port graph."""
    e, t = written(edges("random", spark, d)), written(tiled(spark, d))
    ports, local = written(grid.ports_of(t)), written(tiles.local_closure(e, t))
    return e, t, ports, local, written(tiles.port_graph(local, ports, grid.seams_of(e, t)))


#: Closures of the edges inside regions of ``r(v, region, x, y, passable)``.
_INSIDE = """inner_edges AS (SELECT src, dst, a.region AS region FROM edges JOIN r a ON a.v = src JOIN r b ON b.v = dst WHERE a.region = b.region),
  loc AS (SELECT region, v AS src, v AS dst FROM r WHERE passable UNION SELECT l.region, l.src, e.dst FROM loc l JOIN inner_edges e ON e.src = l.dst)"""
_TILE_REGIONS = f"r AS (SELECT *, {_tile_of('x', 'y')} AS region FROM cells)"
_PORTS = """rbox AS (SELECT region, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r GROUP BY region),
  ports AS (SELECT v FROM r JOIN rbox USING (region) WHERE passable AND (x IN (x0, x1) OR y IN (y0, y1)))"""


@_query(f"WITH RECURSIVE {_edges('random')}, {_TILE_REGIONS}, {_INSIDE} SELECT region AS tile, src, dst FROM loc")
def tile_closures(spark, d):
    return tiles.local_closure(edges("random", spark, d), tiled(spark, d))


@_query(f"""WITH RECURSIVE {_edges('random')}, {_TILE_REGIONS}, {_INSIDE}, {_PORTS}
SELECT src, dst, false AS seam FROM loc WHERE src <> dst AND src IN (SELECT v FROM ports) AND dst IN (SELECT v FROM ports)
UNION ALL SELECT src, dst, true FROM edges JOIN r a ON a.v = src JOIN r b ON b.v = dst WHERE a.region <> b.region""")
def port_graph(spark, d):
    return _index(spark, d)[4]


@_query(_answers("random"))
def pairs_tile_closure(spark, d):
    _, _, ports, local, graph = _index(spark, d)
    return tiles.flat_closure(workload(spark, d), local, ports, graph)


@_query(_answers("random"))
def pairs_tile_search(spark, d):
    _, _, ports, local, graph = _index(spark, d)
    return tiles.flat_search(workload(spark, d), local, ports, graph)


_PLACES = f"""{_TILED}, {_BOX}, edge AS (SELECT tile, v, x, y, passable, CASE WHEN y = y0 THEN 0 WHEN x = x1 THEN 1 WHEN y = y1 THEN 2 ELSE 3 END AS s FROM tiled JOIN box USING (tile) WHERE y IN (y0, y1) OR x IN (x0, x1)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY s, CASE WHEN s IN (0, 2) THEN x ELSE y END) - 1 AS place FROM edge)"""


@_query(f"WITH {_PLACES} SELECT tile, v, substr('NESW', s + 1, 1) AS side, place FROM placed")
def tile_boundary(spark, d):
    return grid.boundary(tiled(spark, d))


@_query(f"WITH {_PLACES} SELECT row_number() OVER (ORDER BY tile, place) - 1 AS port, tile, row_number() OVER (PARTITION BY tile ORDER BY place) - 1 AS place, v FROM placed WHERE passable")
def port_index(spark, d):
    return grid.port_index(tiled(spark, d))


def _levels(spark, d):
    return tiles.hierarchy(edges("random", spark, d), tiled(spark, d), tiles.tiles_across(W, TILE))


_query(_answers("random"), "pairs_hierarchical")(lambda spark, d: tiles.hierarchical(workload(spark, d), _levels(spark, d)))


@_query(f"""WITH RECURSIVE {_edges('random')}, r AS (SELECT *, ((least(y // {TILE}, {_LAST}) // 2) * {-(-_ACROSS // 2)} + least(x // {TILE}, {_ACROSS - 1}) // 2) AS region FROM cells), {_INSIDE}, {_PORTS}
SELECT region, src, dst FROM loc WHERE src <> dst AND src IN (SELECT v FROM ports) AND dst IN (SELECT v FROM ports)""")
def region_summaries(spark, d):
    """What groups of 2 by 2 tiles hand up."""
    e, t = edges("random", spark, d), tiled(spark, d)
    return tiles.summary(tiles.hierarchy(e, t, tiles.tiles_across(W, TILE), max_depth=2)[1])


@_query(_answers("random"))
def pairs_hierarchical_shallow(spark, d):
    """Tiles and one level above; the search answers what they leave open."""
    e, t, ports, local, graph = _index(spark, d)
    levels = tiles.hierarchy(e, t, tiles.tiles_across(W, TILE), max_depth=2)
    return tiles.hierarchical(workload(spark, d), levels, (local, ports, graph))


@_query(f"""WITH RECURSIVE {_TILED}, t AS (SELECT DISTINCT 0 AS level, tile % {_ACROSS} AS i, tile // {_ACROSS} AS j, {_ACROSS} AS wide, {_LAST} + 1 AS high FROM tiled
  UNION SELECT level + 1, i // 2, j // 2, (wide + 1) // 2, (high + 1) // 2 FROM t WHERE wide * high > 1)
SELECT level, j * wide + i AS region, CASE WHEN wide * high > 1 THEN (j // 2) * ((wide + 1) // 2) + i // 2 END AS parent FROM t""")
def region_tree(spark, d):
    return tiles.tree(tiled(spark, d), tiles.tiles_across(W, TILE))


#: All levels at once: cells' regions, closures inside regions, ports on regions' edges, and the ports that a level's closure runs over (all cells on level 0).
_ALL_LEVELS = f"""{_edges('random')}, tiled AS (SELECT *, {_tile_of('x', 'y')} AS tile FROM cells), levels AS (SELECT 0 AS level, 1 AS side, {_ACROSS} AS wide, {_LAST} + 1 AS high UNION ALL SELECT level + 1, side * 2, (wide + 1) // 2, (high + 1) // 2 FROM levels WHERE wide * high > 1),
  r AS (SELECT level, v, x, y, passable, (tile // {_ACROSS} // side) * wide + (tile % {_ACROSS}) // side AS region FROM tiled, levels),
  inner_edges AS (SELECT a.level, src, dst FROM edges JOIN r a ON a.v = src JOIN r b ON b.v = dst AND b.level = a.level AND b.region = a.region),
  loc AS (SELECT level, region, v AS src, v AS dst FROM r WHERE passable UNION SELECT l.level, l.region, l.src, e.dst FROM loc l JOIN inner_edges e ON e.level = l.level AND e.src = l.dst),
  box AS (SELECT level, region, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r GROUP BY level, region),
  ports AS (SELECT level, region, v FROM r JOIN box USING (level, region) WHERE passable AND (x IN (x0, x1) OR y IN (y0, y1))),
  inner_ports AS (SELECT 0 AS level, v FROM cells WHERE passable UNION ALL SELECT p.level + 1, v FROM ports p JOIN levels l ON l.level = p.level + 1)"""


@_query(f"""WITH RECURSIVE {_ALL_LEVELS},
  n AS (SELECT level, region, count(*) AS n FROM inner_ports JOIN r USING (level, v) GROUP BY level, region),
  c AS (SELECT l.level, count(*) AS pairs FROM loc l JOIN inner_ports a ON a.level = l.level AND a.v = l.src JOIN inner_ports b ON b.level = l.level AND b.v = l.dst GROUP BY l.level)
SELECT level, (SELECT count(DISTINCT region) FROM r WHERE r.level = levels.level) AS regions, (SELECT count(*) FROM ports p WHERE p.level = levels.level) AS ports, pairs,
  (SELECT CAST(sum(n * ((n + 63) // 64) * 8) AS BIGINT) FROM n WHERE n.level = levels.level) AS bytes FROM levels JOIN c USING (level)""")
def level_statistics(spark, d):
    return tiles.level_statistics(_levels(spark, d))


@_query(f"""WITH RECURSIVE {_ALL_LEVELS}, c AS (SELECT l.level, count(*) AS n FROM loc l JOIN ports a ON a.level = l.level AND a.v = l.src JOIN ports b ON b.level = l.level AND b.v = l.dst WHERE l.src <> l.dst GROUP BY l.level)
SELECT level, coalesce(n, 0) AS composed, coalesce(n, 0) AS flat, 0 AS differences FROM levels LEFT JOIN c USING (level)""")
def summary_check(spark, d):
    """Each level's composed summary beside the one cut from the flat port graph."""
    return tiles.composition_check(_levels(spark, d), _index(spark, d)[4])


@_query(_answers("random"))
def pairs_intervals(spark, d):
    e = edges("random", spark, d)
    return reach.answer_by_intervals(workload(spark, d), reach.interval_labels(e), e).drop("certified")


_SHARES = f"""{_reach('random')}, sampled AS (SELECT v FROM cells WHERE passable ORDER BY ((v * 7919) % 1000003) * ((v * 7919) % 1000003) % 1000003, v LIMIT 512),
  f AS (SELECT src AS v, count(*) * 1.0 / (SELECT count(*) FROM cells WHERE passable) AS f FROM reach WHERE src IN (SELECT v FROM sampled) GROUP BY src)"""


def _sampled(spark, d):
    """By a search from the sampled cells alone."""
    sources = cut_compact(density.sample(passable(spark, d), 512))
    counts = blocks.search(blocks.build(edges("random", spark, d)), sources.select(F.col("v").alias("seed"))).counts()
    return counts.select(F.col("seed").alias("v"), (F.col("reached") / passable(spark, d).count()).alias("f"))


@_query(f"WITH RECURSIVE {_SHARES} SELECT v, round(f, 9) AS f FROM f")
def density_sample(spark, d):
    return _sampled(spark, d).select("v", F.round("f", 9).alias("f"))


_ROUNDS = f"""{_SHARES}, run AS (SELECT row_number() OVER o AS n, avg(f) OVER o AS mean, var_pop(f) OVER o AS var FROM f
  WINDOW o AS (ORDER BY ((v * 7919) % 1000003) * ((v * 7919) % 1000003) % 1000003, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  r AS (SELECT n, mean, sqrt(var / n) AS error FROM run WHERE n >= {density.FIRST} AND (n - {density.FIRST}) % {density.STEP} = 0),
  b AS (SELECT *, lag(mean) OVER (ORDER BY n) AS m, lag(error) OVER (ORDER BY n) AS e FROM r),
  c AS (SELECT *, abs(mean - m) <= greatest({density.MEAN_FLOOR}, {density.MEAN_SHARE} * greatest(mean, m)) AND abs(error - e) <= greatest({density.ERROR_FLOOR}, {density.ERROR_SHARE} * greatest(error, e)) AS calm FROM b),
  s AS (SELECT n, mean, error, coalesce(sum(CASE WHEN calm THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN {density.STABLE_ROUNDS - 1} PRECEDING AND CURRENT ROW), 0) >= {density.STABLE_ROUNDS} AS stable FROM c)"""


@_query(f"WITH RECURSIVE {_ROUNDS} SELECT n, round(mean, 6) AS mean, round(error, 6) AS error, stable FROM s")
def density_rounds(spark, d):
    return density.rounds(_sampled(spark, d)).select(F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"), "stable")


@_query(f"WITH RECURSIVE {_ROUNDS} SELECT n, round(mean, 6) AS mean, round(error, 6) AS error, stable FROM s ORDER BY stable DESC, CASE WHEN stable THEN n ELSE -n END LIMIT 1")
def density_stepwise(spark, d):
    """Searched batch by batch until the estimate is stable; later sources are never searched from."""
    steps = density.Steps.begin(edges("random", spark, d), passable(spark, d), f"{shared_dir(spark)}/density_{uuid.uuid4().hex}")
    now = steps.run()
    return spark.createDataFrame([(now.estimate.sources, round(now.estimate.mean, 6), round(now.estimate.error, 6), now.stable)], "n long, mean double, error double, stable boolean")


# Text of maps and pictures ---------------------------------------------------------------------


@_query("SELECT p_partkey, CASE c WHEN '.' THEN 'ground' WHEN 'G' THEN 'ground' WHEN 'T' THEN 'tree' WHEN 'S' THEN 'swamp' WHEN 'W' THEN 'water' WHEN '@' THEN 'out_of_bounds' WHEN 'O' THEN 'out_of_bounds' ELSE CASE WHEN regexp_matches(c, '^[A-Z]$') THEN 'weighted' ELSE 'unknown' END END AS terrain FROM (SELECT p_partkey, upper(substr(p_type, 1, 1)) AS c FROM part)")
def terrain_class(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", terrain.terrain_class(F.upper(F.substring("p_type", 1, 1))).alias("terrain"))


_LETTERS = "GTSW@OX.q"
_LETTER = f"substr('{_LETTERS}', CAST(p_size % {len(_LETTERS)} AS INTEGER) + 1, 1)"


def _letters(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.substring(F.lit(_LETTERS), (F.col("p_size") % len(_LETTERS) + 1).cast("int"), F.lit(1)).alias("ch"))


@_query(f"""WITH p AS (SELECT p_partkey, {_LETTER} AS ch FROM part) SELECT p_partkey, ch IN ('.', 'G') AS ground_only, ch IN ('.', 'G', 'S') AS ground_and_swamp, ch IN ('.', 'G', 'S', 'W') AS ground_swamp_water,
  ch IN ('.', 'G', 'S', 'W', 'X') AS any_terrain_letter FROM p""")
def terrain_policies(spark, d):
    names = ("ground_only", "ground_and_swamp", "ground_swamp_water", "any_terrain_letter")
    return _letters(spark, d).select("p_partkey", *[terrain.is_passable(F.col("ch"), policy).alias(name) for policy, name in zip(terrain.POLICIES, names, strict=True)])


def _row_maps(spark, d):
    """A map file for each row of the part grid: its name is the row's number."""
    rows = _letters(spark, d).select(F.floor(F.col("p_partkey") / W).alias("y"), (F.col("p_partkey") % W).alias("x"), "ch")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ch"))), lambda s: s["ch"]), "")
    return rows.groupBy("y").agg(line.alias("line")).select(F.col("y").cast("string").alias("name"), F.concat(F.lit("type octile\nheight 1\nwidth "), F.length("line").cast("string"), F.lit("\nmap\n"), "line", F.lit("\n")).alias("text"))


@_query(f"SELECT CAST(p_partkey // {W} AS VARCHAR) AS name, p_partkey % {W} AS v, CAST(p_partkey % {W} AS INTEGER) AS x, 0 AS y, {_LETTER} IN ('.', 'G', 'S') AS passable FROM part")
def map_layout(spark, d):
    return maps.layout(maps.parse(_row_maps(spark, d)), "GroundAndSwamp")


@_query(f"""WITH p AS (SELECT CAST(p_partkey // {W} AS VARCHAR) AS name, p_partkey % {W} AS x, {_LETTER} AS ch FROM part), n AS (SELECT DISTINCT name FROM p), a AS (SELECT name, x FROM n, (VALUES (-1), (0), (7), ({W})) t(x)),
  f AS (SELECT a.name, CAST(a.x AS INTEGER) AS x, 0 AS y, coalesce(p.ch, '@') AS ch FROM a LEFT JOIN p ON p.name = a.name AND p.x = a.x)
SELECT *, CASE WHEN ch IN ('.', 'G') THEN 'ground' WHEN ch = 'T' THEN 'tree' WHEN ch = 'S' THEN 'swamp' WHEN ch = 'W' THEN 'water' WHEN ch IN ('@', 'O') THEN 'out_of_bounds' WHEN ch = 'X' THEN 'weighted' ELSE 'unknown' END AS terrain FROM f""")
def map_points(spark, d):
    """Cells of each map, some of them off it."""
    texts = _row_maps(spark, d)
    asked = texts.select("name", F.explode(F.array(*map(F.lit, (-1, 0, 7, W)))).alias("x"), F.lit(0).alias("y"))
    return maps.cells_at(maps.parse(texts), asked)


@_query(f"""WITH p AS (SELECT p_brand AS "set", CAST(p_partkey AS VARCHAR) AS map, CAST(p_retailprice AS BIGINT) * 10 AS cells FROM part)
SELECT "set", map, cells FROM p QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY cells, map) = 1 AND cells <= 10000""")
def maps_smallest(spark, d):
    sized = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("set"), F.col("p_partkey").cast("string").alias("map"), (F.rint("p_retailprice").cast("long") * 10).alias("cells"))
    return maps.smallest_per_set(sized)


@_query("SELECT p_partkey, lower(p_name) LIKE '%a_e%' AS globbed, contains(lower(p_name), 'ar') AS found FROM part")
def name_filter(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.matches(F.col("p_name"), "*A?e*").alias("globbed"), text.matches(F.col("p_name"), "aR").alias("found"))


_query(f"WITH {_CELLS} SELECT y, string_agg(CASE WHEN passable THEN '222 222 214 ' ELSE '28 28 32 ' END, '' ORDER BY x) AS row FROM cells GROUP BY y", "ppm_rows")(lambda spark, d: pictures.ppm_rows(cells(spark, d)))


@_query(f"""WITH {_edges('random')} SELECT '<rect x="' || x * 8 || '" y="' || y * 8 || '" width="8" height="8" fill="' || CASE WHEN passable THEN '#ffffff' ELSE '#cccccc' END || '" stroke="#666666"/>' AS line FROM cells
UNION ALL SELECT '<line x1="' || (a.x * 8 + 4) || '" y1="' || (a.y * 8 + 4) || '" x2="' || (b.x * 8 + 4) || '" y2="' || (b.y * 8 + 4) || '" stroke="#3366cc"/>' FROM edges JOIN cells a ON a.v = src JOIN cells b ON b.v = dst
UNION ALL SELECT '<text x="4" y="6">grid graph</text>'""")
def svg_lines(spark, d):
    return pictures.svg_lines(cells(spark, d), edges("random", spark, d), 8).select("line")


@_query(f"""WITH {_CELLS}, b AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells), n AS (SELECT w, h, greatest(CAST(floor(w * least(1.0, 20.0 / greatest(w, h))) AS BIGINT), 1) AS nw, greatest(CAST(floor(h * least(1.0, 20.0 / greatest(w, h))) AS BIGINT), 1) AS nh FROM b)
SELECT ((x + 1) * nw - 1) // w AS x, ((y + 1) * nh - 1) // h AS y, round(avg(CASE WHEN passable THEN 1.0 ELSE 0.0 END), 9) AS share FROM cells, n GROUP BY 1, 2""")
def grid_shrunk(spark, d):
    return pictures.shrunk(cells(spark, d), 20).withColumn("share", F.round("share", 9))


@_query("SELECT c_custkey, replace(replace(replace(replace(replace('<' || c_name || '> & \"' || c_mktsegment || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM customer")
def xml_escape(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", terrain.xml_escape(F.concat(F.lit("<"), "c_name", F.lit('> & "'), "c_mktsegment", F.lit("'"))).alias("escaped"))


@_query("SELECT * FROM (VALUES ('a', 0, 0, 0, '.'), ('a', 1, 0, 1, '@'), ('a', 0, 1, 2, 'T'), ('a', 1, 1, 3, 'G')) t(name, x, y, v, ch)")
def movingai_parse(spark, d):
    text = "type octile\nwidth 9\nheight 2\nwidth 2\nmap\n.@x\nTG\n"
    return maps.parse(spark.createDataFrame([("a", text), ("short", "height 2\nwidth 2\nmap\n.@\n."), ("odd", "colour 2\nheight 1\nwidth 1\nmap\n.")], "name string, text string")).select("name", "x", "y", "v", "ch")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
