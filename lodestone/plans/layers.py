"""Step graphs: plans to nodes and edges, layers of a directed acyclic graph by longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, table


def longest_path_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node; edges: src, dst between them -> node, depth: the edges of the longest path that ends there.

    Paths are doubled: round k has the pairs of nodes that a path of exactly 2**k edges joins. As each end of a path is a path, a
    node has paths of all lengths up to its depth, so the depth's binary digits are found from the highest one: the starts
    of its paths so far are moved back by 2**k edges where any can be. Both ways take as many rounds as the longest path has binary
    digits, each cut by checkpoint(). Pairs a power of two apart still after as many edges as there are nodes are on a cycle, which raises
    ValueError. A round holds such pairs only, a few for each node where graphs are long and narrow.
    """
    nodes = checkpointed(nodes.select("node").distinct())
    n, powers = nodes.count(), []
    pairs = checkpointed(edges.select("src", "dst").distinct())
    while not pairs.isEmpty():
        if 2 ** len(powers) >= n:
            raise ValueError("the graph has a cycle")
        powers.append(pairs)
        pairs = checkpointed(pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct())
    starts = nodes.select("node", F.col("node").alias("start"), F.lit(0).alias("depth"))
    for k in range(len(powers) - 1, -1, -1):
        back = powers[k].select(F.col("dst").alias("start"), F.col("src").alias("before"))
        moved = starts.join(back, "start").select("node", F.col("before").alias("start"), (F.col("depth") + 2**k).alias("depth")).distinct()
        starts = checkpointed(starts.join(moved.select("node").distinct(), "node", "left_anti").select("node", "start", "depth").unionByName(moved))
    return starts.select("node", "depth").distinct()


EXCLUSIVE = "control."


def compile_plan(phases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plan, phase_no (from 0, without gaps), spec, branches: array<struct<id string, steps int>> -> nodes and edges of its graph.

    A phase without branches is one node. Manual triggers are a node for each branch and one that merges them; an agent is a
    hub with a tool for each branch; other phases are a branching node with a chain of steps for each branch, whose first edges
    carry the branch as handle where only one is taken. What a phase ends in leads to what the next begins with.
    """
    p = phases.withColumn("n", F.coalesce(F.size("branches"), F.lit(0)))
    own = F.concat(F.lit("p"), F.col("phase_no").cast("string"))
    kind = F.when(F.col("n") <= 0, "step").when(F.col("spec") == "trigger.manual", "manual").when(F.startswith("spec", F.lit("agent.")), "agent").otherwise("branch")
    p = p.withColumns({"own": own, "kind": kind})
    arms = p.filter("n > 0").select("plan", "phase_no", "spec", "kind", "own", F.explode("branches").alias("b"))
    arm = F.concat("own", F.lit("-"), "b.id")
    chain = arms.filter("kind = 'branch'").select("plan", "phase_no", "spec", "own", F.col("b.id").alias("arm"), F.col("b.steps").alias("steps"), F.explode(F.sequence(F.lit(1), F.col("b.steps"))).alias("k"))
    step = lambda k: F.concat("own", F.lit("-"), "arm", F.lit("-"), k.cast("string"))
    merge = F.concat(F.lit("merge-"), F.col("phase_no").cast("string"))
    singles, manual = p.filter("kind <> 'manual'"), p.filter("kind = 'manual'")
    nodes = singles.select("plan", F.col("own").alias("node"), "kind").unionByName(manual.select("plan", merge.alias("node"), F.lit("merge").alias("kind")))
    nodes = nodes.unionByName(arms.filter("kind <> 'branch'").select("plan", arm.alias("node"), F.when(F.col("kind") == "agent", "tool").otherwise("manual").alias("kind"))).unionByName(chain.select("plan", step(F.col("k")).alias("node"), F.lit("step").alias("kind")))
    no = F.lit(None).cast("string")
    edge = lambda df, a, z, dashed, handle=no: df.select("plan", a.alias("src"), z.alias("dst"), F.lit(dashed).alias("dashed"), handle.alias("handle"))
    inner = edge(arms.filter("kind = 'manual'"), arm, merge, False).unionByName(edge(arms.filter("kind = 'agent'"), F.col("own"), arm, True))
    inner = inner.unionByName(edge(chain.filter("k = 1"), F.col("own"), step(F.lit(1)), True, F.when(F.startswith("spec", F.lit(EXCLUSIVE)), F.col("arm")))).unionByName(edge(chain.filter("k > 1"), step(F.col("k") - 1), step(F.col("k")), False))
    ends = p.filter("kind in ('step', 'agent')").select("plan", "phase_no", F.col("own").alias("src")).unionByName(manual.select("plan", "phase_no", merge.alias("src"))).unionByName(chain.filter("k = steps").select("plan", "phase_no", step(F.col("k")).alias("src")))
    begins = singles.select("plan", "phase_no", F.col("own").alias("dst"), F.lit(False).alias("dashed")).unionByName(arms.filter("kind = 'manual'").select("plan", "phase_no", arm.alias("dst"), F.lit(True).alias("dashed")))
    between = ends.withColumn("phase_no", F.col("phase_no") + 1).join(begins, ["plan", "phase_no"]).select("plan", "src", "dst", "dashed", no.alias("handle"))
    return nodes, inner.unionByName(between)


def plan_edges(spark: SparkSession, d: str) -> DataFrame:
    """Plans of ten phases made of the parts."""
    k = F.col("p_partkey")
    spec = F.element_at(F.array(*[F.lit(x) for x in ("trigger.manual", "agent.ask", "control.switch", "parallel.map", "tool.call")]), (k % 5 + 1).cast("int"))
    arms = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda b: F.struct(F.concat(F.lit("b"), b.cast("string")).alias("id"), (b % 2 + 1).cast("int").alias("steps")))
    phases = table(spark, d, "part").select(F.floor(k / 10).alias("plan"), (k % 10).alias("phase_no"), spec.alias("spec"), F.when(k % 5 != 4, arms).alias("branches"))
    return compile_plan(phases)[1]


def layered_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps numbered as customers: each follows the one with half its number, and the one before that with a third."""
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(k.alias("node"))
    half, third = nodes.filter("node >= 2").select(F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst")), nodes.filter("node >= 3").select(F.floor(F.col("node") / 3).alias("src"), F.col("node").alias("dst"))
    edges = half.unionByName(third)
    return longest_path_layers(nodes, edges.join(nodes.withColumnRenamed("node", "src"), "src")).withColumn("depth", F.col("depth").cast("long"))


QUERIES = {"layered_steps": layered_steps, "plan_edges": plan_edges}
ORACLE_SQL = {
    "plan_edges": """WITH p AS (SELECT p_partkey // 10 AS plan, p_partkey % 10 AS n, 'p' || (p_partkey % 10) AS own, ['manual', 'agent', 'switch', 'map', 'step'][p_partkey % 5 + 1] AS kind, p_partkey % 3 + 1 AS w FROM part),
a AS (SELECT *, 'b' || b AS arm, b % 2 + 1 AS steps FROM p, unnest(range(1, w + 1)) AS u(b) WHERE kind <> 'step'), c AS (SELECT * FROM a, unnest(range(1, steps + 1)) AS v(k) WHERE kind IN ('switch', 'map')),
o AS (SELECT plan, n, own AS src FROM p WHERE kind IN ('step', 'agent') UNION ALL SELECT plan, n, 'merge-' || n FROM p WHERE kind = 'manual' UNION ALL SELECT plan, n, own || '-' || arm || '-' || k FROM c WHERE k = steps),
i AS (SELECT plan, n, own AS dst, false AS dashed FROM p WHERE kind <> 'manual' UNION ALL SELECT plan, n, own || '-' || arm, true FROM a WHERE kind = 'manual')
SELECT plan, own || '-' || arm AS src, 'merge-' || n AS dst, false AS dashed, NULL::VARCHAR AS handle FROM a WHERE kind = 'manual' UNION ALL SELECT plan, own, own || '-' || arm, true, NULL FROM a WHERE kind = 'agent'
UNION ALL SELECT plan, own, own || '-' || arm || '-1', true, CASE WHEN kind = 'switch' THEN arm END FROM c WHERE k = 1 UNION ALL SELECT plan, own || '-' || arm || '-' || (k - 1), own || '-' || arm || '-' || k, false, NULL FROM c WHERE k > 1
UNION ALL SELECT o.plan, src, dst, dashed, NULL FROM o JOIN i ON i.plan = o.plan AND i.n = o.n + 1""",
    "layered_steps": """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS s, c_custkey AS t FROM customer WHERE c_custkey >= 2 UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey >= 3), x AS (SELECT s, t FROM e JOIN customer ON c_custkey = s),
w AS (SELECT c_custkey AS node, 0::BIGINT AS depth FROM customer UNION SELECT x.t, w.depth + 1 FROM w JOIN x ON x.s = w.node) SELECT node, max(depth) AS depth FROM w GROUP BY 1""",
}
