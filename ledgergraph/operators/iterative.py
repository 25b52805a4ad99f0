"""Graph operators that iterate to a fixed point or for given rounds.

Every round is one job that writes its state to Parquet in the shared folder, so plans
stay short and a lost executor repeats one round.  What ends a round, a sum over the
state, is observed while it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..functions.workspace import Workspace, together
from ..plans.catalog import OPERATORS
from ..plans.dialect import DUCK, SPARK
from ..plans.fixtures import fixture, fixture_sql, fixture_tables
from .components import connected_components
from .features import FEATURE_COLUMNS, cutoff


def distinct_pairs(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("from_account").alias("src"), F.col("to_account").alias("dst")).distinct()


def _observed(work: Workspace, rows: DataFrame, name: str, measure: Column) -> tuple[DataFrame, float]:
    """The written rows and a sum over them (0 of none)."""
    seen = Observation()
    found = work.cut(rows.observe(seen, F.sum(measure).alias("x")), name)
    return found, seen.get["x"] or 0


#: Edges of a bucket, about: the number of buckets follows from the graph, so that a round of a
#: small one has few tasks and a task of a large one stays small.
BUCKET_EDGES = 1 << 21

#: Rows of a state, a few numbers each, that may be broadcast.
FEW = 1 << 16

#: Accounts whose edges are kept apart number at most this many: each has over a
#: ``1 / HUBS`` of all edges, and at least ``HUB_EDGES``.
HUBS, HUB_EDGES = 4096, 1024


class Adjacency:
    """Edges ``src, dst`` (repeated ones count once) laid out once, so that rounds move what
    the accounts say and never the edges.

    Edges lie in buckets of ``src``, an account's as one list (``near``), so that a round
    sorts and joins accounts and unfolds their edges after; a state written in the same
    buckets (:meth:`placed`) meets them where it lies.  Those of hubs, which would
    fill a bucket, are spread over a table of their own and meet their hubs' state by a
    broadcast of at most ``HUBS`` rows; a list is no longer than an account's edges that
    make no hub.  Where there are hubs, ``far_hub`` says whether ``dst`` is one.
    """

    def __init__(self, work: Workspace, edges: DataFrame, hub_edges: int = HUB_EDGES):
        self.work, self.edges = work, edges.select("src", "dst")
        counts, total = _observed(work, self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "counts", F.col("n"))
        self.parts = max(work.spark.sparkContext.defaultParallelism, int(total) // BUCKET_EDGES)
        self.hubs = work.cut(counts.where(F.col("n") > max(hub_edges, total // HUBS)).select("src"), "hubs")
        self.some = not self.hubs.isEmpty()
        if not self.some:
            self.rest = self._lists(self.edges, "dst")
            self.degree = work.cut(self.rest.select("src", "degree"), "degree")
            return
        far = F.broadcast(self.hubs.select(F.col("src").alias("dst"), F.lit(True).alias("far_hub")))
        marked = self.edges.join(far, "dst", "left").select("src", "dst", F.coalesce("far_hub", F.lit(False)).alias("far_hub"))
        self.rest = self._lists(marked.join(F.broadcast(self.hubs), "src", "left_anti"), "dst", "far_hub")
        self.of_hubs = work.cut(self.only_hubs(marked).distinct(), "of-hubs")
        of_hubs = self.of_hubs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        self.degree = work.cut(self.rest.select("src", "degree").unionByName(of_hubs), "degree")

    def _lists(self, edges: DataFrame, *columns: str) -> DataFrame:
        one = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
        found = self.moved(edges, "src").groupBy("src").agg(F.collect_set(one).alias("near"))
        return self.work.bucketed(found.withColumn("degree", F.size("near").cast("long")), "rest", "src", self.parts)

    def moved(self, rows: DataFrame, by: str) -> DataFrame:
        """Rows where the buckets' tasks find those of their ``by``."""
        return rows.repartition(self.parts, by)

    def placed(self, state: DataFrame, name: str, measure: Column, by: str = "src") -> tuple[DataFrame, float]:
        """The state, written in the buckets of the edges, and a sum over it.  Rows that
        lie there already, as those of a join with a placed state do, do not move."""
        seen = Observation()
        found = self.work.bucketed(state.observe(seen, F.sum(measure).alias("x")), name, by, self.parts)
        return found, seen.get["x"] or 0

    def heard(self, said: DataFrame, what: str, *keys: str) -> DataFrame:
        """The sums of ``what`` by ``dst`` and ``keys`` of rows that go along edges to ``dst``.
        They move to their receiver once; those to hubs are summed before."""
        if self.some:
            far = said.where("far_hub").groupBy("dst", *keys).agg(F.sum(what).alias(what))
            said = said.where("not far_hub").select("dst", *keys, what).unionByName(far)
        return self.moved(said, "dst").groupBy("dst", *keys).agg(F.sum(what).alias(what))

    def only_hubs(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.hubs), "src", "left_semi")

    def along(self, state: DataFrame, rows: float | None = None) -> DataFrame:
        """Edges with the state of their ``src`` (one row an account); of accounts
        without state, none.  Lists are not sorted for it: the state is hashed, bucket by
        bucket, or if its ``rows`` are known to be few, whole."""
        few = rows is not None and rows <= FEW
        near = self.rest.drop("degree").join(state.hint("broadcast" if few else "shuffle_hash"), "src")
        near = near.selectExpr("*", "inline(near)" if self.some else "explode(near) as dst").drop("near")
        return near.unionByName(self.of_hubs.join(F.broadcast(self.only_hubs(state)), "src")) if self.some else near

def pagerank(
    spark: SparkSession,
    pairs: DataFrame,
    damping: float = 0.85,
    rounds: int = 30,
    seeds: DataFrame | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """``account_id, pagerank`` over distinct ``src, dst`` pairs.

    The mass of accounts without outgoing pairs is spread like the restart: evenly,
    or over ``seeds`` (``account_id``) for the personalised form.  Ranks sum to 1.
    A round moves the shares, summed by receiver where they arise.
    """
    work = Workspace(spark, "pagerank")
    graph = Adjacency(work, work.cut(pairs.select("src", "dst"), "edges"), hub_edges)
    nodes = graph.degree.select(F.col("src").alias("id")).union(graph.edges.select("dst").distinct()).distinct()
    nodes = nodes.join(graph.degree.withColumnRenamed("src", "id"), "id", "left")
    if seeds is None:
        nodes = nodes.withColumn("start", F.lit(1.0))
    else:
        marked = seeds.select(F.col("account_id").alias("id"), F.lit(1.0).alias("start")).distinct()
        nodes = nodes.join(marked, "id", "left").fillna({"start": 0.0})
    nodes, total = _observed(work, nodes, "nodes", F.col("start"))
    ranks = nodes.select("id", "degree", (F.col("start") / F.lit(float(total or 1))).alias("start")).withColumn("rank", F.col("start"))
    dangling = F.when(F.col("degree").isNull(), F.col("rank")).otherwise(0.0)
    ranks, loose = graph.placed(graph.moved(ranks, "id"), "ranks-0", dangling, "id")
    for i in range(1, rounds + 1):
        giving = ranks.where("degree is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
        given = graph.heard(graph.along(giving), "share").select(F.col("dst").alias("id"), F.col("share").alias("given"))
        now = ranks.join(given.hint("shuffle_hash"), "id", "left").select(
            "id", "degree", "start",
            ((1 - damping) * F.col("start") + damping * (F.coalesce("given", F.lit(0.0)) + float(loose) * F.col("start"))).alias("rank"),
        )
        ranks, loose = graph.placed(now, f"ranks-{i}", dangling, "id")
        work.drop(f"ranks-{i - 1}")
    return ranks.select(F.col("id").alias("account_id"), F.col("rank").alias("pagerank"))


#: The h-index of values and their counts: the most of which as many are as large.
_H_INDEX = """aggregate(sort_array(map_entries(seen), false), named_struct('upto', 0L, 'h', 0L),
  (a, e) -> named_struct('upto', a.upto + e.value, 'h', greatest(a.h, least(e.key, a.upto + e.value))), a -> a.h)"""
#: Counts by value, those of ``core`` and more together.
_UP_TO_CORE = """map_concat(map_filter(seen, (k, n) -> k < core and n <> 0),
  map(core, aggregate(map_values(map_filter(seen, (k, n) -> k >= core)), 0L, (a, n) -> a + n)))"""


def kcore(spark: SparkSession, pairs: DataFrame, max_rounds: int = 500, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``account_id, kcore_number`` of the undirected simple graph.

    Core numbers are the fixed point of "h-index of the neighbours' values", from the
    degree down.  While most accounts fall, all say their value to their neighbours.
    From then on an account keeps how many of its neighbours have which value below its own,
    and how many have no less, and only those that fell say from what to what.  An account's state lies in the bucket of its edges.  A self-loop is a neighbour
    of itself.  Raises ``RuntimeError`` if ``max_rounds`` do not suffice.
    """
    work = Workspace(spark, "kcore")
    pairs = work.cut(pairs.select("src", "dst"), "edges")
    graph = Adjacency(work, pairs.union(pairs.select("dst", "src")), hub_edges)
    core = graph.degree.select("src", F.col("degree").alias("core"), F.col("degree").alias("before"))
    core, accounts = graph.placed(graph.moved(core, "src"), "core-0", F.lit(1))
    fallen, kept = accounts, False
    for i in range(1, max_rounds + 1):
        if kept:
            fell = graph.along(core.where("core < before").select("src", "core", "before"), fallen)
            said = fell.selectExpr("* except(src, core, before)", "inline(array(struct(core as value, 1L as n), struct(before as value, -1L as n)))")
        else:
            said = graph.along(core.select("src", F.col("core").alias("value"))).drop("src").withColumn("n", F.lit(1).cast("long"))
        keep = kept or 2 * fallen < accounts
        was = core.withColumnRenamed("core", "was")
        if keep or graph.some:
            heard = graph.heard(said, "n", "value").where("n <> 0").groupBy(F.col("dst").alias("src"))
            heard = heard.agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("heard"))
            now = was.join(heard.hint("shuffle_hash"), "src", "left")
            if kept:  # what fell from above one's own value is taken off by the sum from above
                now = now.withColumn("seen", F.expr("if(heard is null, seen, map_zip_with(seen, heard, (k, a, b) -> coalesce(a, 0L) + coalesce(b, 0L)))"))
            else:
                now = now.withColumn("seen", F.col("heard"))
            now = now.selectExpr("src", f"if(heard is null, was, least(was, {_H_INDEX})) as core", "was as before", "seen", "heard is not null as new")
            now = now.selectExpr("src", "core", "before", *[f"if(new, {_UP_TO_CORE}, seen) as seen"] * keep)
        else:  # lists of values are as short as those of edges
            heard = graph.moved(said, "dst").groupBy(F.col("dst").alias("src")).agg(F.sort_array(F.collect_list("value"), asc=False).alias("heard"))
            now = was.join(heard.hint("shuffle_hash"), "src", "left")
            now = now.selectExpr("src", "if(heard is null, was, least(was, size(filter(heard, (v, i) -> v > i)))) as core", "was as before")
        core, fallen = graph.placed(now, f"core-{i}", (F.col("core") < F.col("before")).cast("int"))
        work.drop(f"core-{i - 1}")
        if not fallen:
            return core.select(F.col("src").alias("account_id"), F.col("core").alias("kcore_number"))
        kept = keep
    raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")


def clusters(spark: SparkSession, tx: DataFrame, min_size: int = 3, high: int = 20, medium: int = 5) -> DataFrame:
    """Components of the illicit transfers: ``cluster_id, root, size, illicit_edges,
    risk_level, sample``; ids count by size, then root."""
    illicit = tx.where("is_laundering = 1").select(F.col("from_account").alias("a"), F.col("to_account").alias("b"))
    work = Workspace(spark, "clusters")
    illicit = work.cut(illicit, "illicit")
    found = connected_components(illicit, work, "components")
    nodes = illicit.select(F.col("a").alias("node")).union(illicit.select("b")).distinct()
    member = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    member = work.cut(member, "members")
    edges = illicit.join(member, illicit.a == member.node).groupBy("root").agg(F.count(F.lit(1)).alias("illicit_edges"))
    first = Window.partitionBy("root").orderBy("node")
    sample = (
        member.withColumn("i", F.row_number().over(first)).where("i <= 5").groupBy("root")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("node")).cast("array<string>")).alias("sample"))
    )
    sized = member.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    placed = ranked(work, sized, [F.col("size").desc(), F.col("root")], "placed")
    return placed.join(edges, "root").join(sample, "root").select(
        F.format_string("C%04d", "place").alias("cluster_id"), "root", "size", "illicit_edges",
        F.when(F.col("size") >= high, "HIGH").when(F.col("size") >= medium, "MEDIUM").otherwise("LOW").alias("risk_level"), "sample",
    )


def cluster_detail(
    spark: SparkSession, tx: DataFrame, seed: int | None = None, scores: DataFrame | None = None, max_nodes: int = 120, max_hops: int = 20
) -> DataFrame:
    """What a drawing of a cluster shows: breadth-first from a seed, riskier and busier
    accounts first, up to ``max_nodes`` accounts (the operator's feature): ``account_id,
    hops, degree, risk_score``.  Without a seed the account of largest ``degree * 1000 +
    risk_score`` is it (the least id of equals); ``scores`` has ``account_id, risk_score``."""
    work = Workspace(spark, "detail")
    pairs = distinct_pairs(tx).where("src <> dst")
    both = work.cut(pairs.union(pairs.select("dst", "src")).distinct(), "both")
    nodes = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if scores is None:
        nodes = nodes.withColumn("risk", F.lit(0.0))
    else:
        risk = scores.groupBy(F.col("account_id").alias("id")).agg(F.max("risk_score").alias("risk"))
        nodes = nodes.join(risk, "id", "left").fillna({"risk": 0.0})
    nodes = work.cut(nodes, "nodes")
    if seed is None:
        best = nodes.orderBy((F.col("degree") * 1000 + F.col("risk")).desc(), "id").select("id").first()
        seed = best["id"] if best else None
    reached = work.cut(nodes.where(F.col("id").eqNullSafe(F.lit(seed))).select("id", F.lit(0).alias("hops")), "hop-0")
    size = reached.count()
    for hop in range(1, max_hops + 1):
        near = both.join(reached.where(F.col("hops") == hop - 1).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        near = near.join(reached, "id", "left_anti").join(nodes, "id")
        near = near.orderBy(F.col("risk").desc(), F.col("degree").desc(), "id").limit(max(0, max_nodes - size)).select("id", F.lit(hop).alias("hops"))
        reached = work.cut(reached.union(near), f"hop-{hop}")
        before, size = size, reached.count()
        if size in (before, max_nodes):
            break
    return reached.join(nodes, "id").select(F.col("id").alias("account_id"), "hops", "degree", F.col("risk").alias("risk_score"))


def cluster_drawing(
    spark: SparkSession, tx: DataFrame, place: int = 1, scores: DataFrame | None = None, max_nodes: int = 120, max_edges: int = 2000
) -> DataFrame:
    """The drawing of one cluster of illicit transfers, the ``place``-th by size and root:
    all transfers, licit ones too, among the accounts that :func:`cluster_detail` shows of
    it, the oldest ``max_edges`` of them (both bounds are the operator's feature).

    Gives ``tx_id, from_account, from_hops, from_risk, to_account, to_hops, to_risk, amount,
    is_laundering``; a cluster that is not there has no rows.
    """
    work = Workspace(spark, "drawing")
    illicit = work.cut(tx.where("is_laundering = 1").select(F.col("from_account").alias("a"), F.col("to_account").alias("b")), "illicit")
    found = connected_components(illicit, work, "components")
    ends = illicit.select(F.col("a").alias("node")).union(illicit.select("b")).distinct()
    member = work.cut(ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root")), "members")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "root")
    chosen = sizes.limit(place).collect()[place - 1 :]
    if not chosen:
        own = member.where("false").select("node")
    else:
        own = work.cut(member.where(F.col("root") == F.lit(chosen[0]["root"])).select("node"), "cluster")
    inside = tx.join(own.withColumnRenamed("node", "from_account"), "from_account", "left_semi")
    inside = work.cut(inside.join(own.withColumnRenamed("node", "to_account"), "to_account", "left_semi"), "inside")
    shown = cluster_detail(spark, inside, scores=scores, max_nodes=max_nodes).drop("degree")
    side = lambda p: shown.select(*[F.col(c).alias(n) for c, n in (("account_id", f"{p}_account"), ("hops", f"{p}_hops"), ("risk_score", f"{p}_risk"))])
    drawn = inside.join(side("from"), "from_account").join(side("to"), "to_account")
    return drawn.orderBy("tx_timestamp", "tx_id", "amount").limit(max_edges).select(
        "tx_id", "from_account", "from_hops", "from_risk", "to_account", "to_hops", "to_risk", F.col("amount").cast("double").alias("amount"), "is_laundering"
    )


def component_stats(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """One row over all edges: ``nodes, components, largest``."""
    work = Workspace(spark, "wcc")
    found = connected_components(pairs.select("src", "dst"), work, "components")
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    member = nodes.join(found, "node", "left").select(F.coalesce("component", "node").alias("root"))
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


def cluster_report(spark: SparkSession, tx: DataFrame, top: int = 10) -> DataFrame:
    """The largest clusters of illicit transfers (a top list): ``cluster_id, size,
    illicit_edges, risk_level``."""
    return clusters(spark, tx, min_size=1).orderBy("cluster_id").limit(top).select("cluster_id", "size", "illicit_edges", "risk_level")


def active_network_features(spark: SparkSession, tx: DataFrame, days: int = 30) -> DataFrame:
    """PageRank and core numbers over the whole graph, for accounts with a transfer in
    the last days: what a periodic refresh writes back to them."""
    tx = Workspace(spark, "writeback").cut(tx.select("from_account", "to_account", "tx_timestamp"), "tx")
    last = tx.agg(F.max("tx_timestamp").alias("last_"))
    recent = tx.crossJoin(F.broadcast(last)).where(F.col("tx_timestamp") >= F.col("last_") - F.expr(f"interval {int(days)} days"))
    active = recent.select(F.col("from_account").alias("account_id")).union(recent.select("to_account")).distinct()
    ranks, cores = network(spark, distinct_pairs(tx))
    return ranks.join(cores, "account_id").join(active, "account_id", "left_semi")


def network(spark: SparkSession, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PageRank and core numbers, found side by side."""
    pairs = Workspace(spark, "network").cut(pairs, "pairs")
    ranks, cores = together(spark, lambda: pagerank(spark, pairs), lambda: kcore(spark, pairs))
    return ranks, cores


#: What the 24 columns and the label are made of.
LEDGER_COLUMNS = ("from_account", "to_account", "amount", "channel", "tx_timestamp", "device_id", "institution_id", "is_laundering")


def narrow_ledger(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """The columns of a ledger that features use, written once: ``tx`` may be a view that
    joins, and the features read it a dozen times."""
    return Workspace(spark, "ledger").cut(tx.select(*LEDGER_COLUMNS), "tx")


def causal_network(spark: SparkSession, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PageRank and core numbers over transfers up to the validation cut-off."""
    until = spark.sql(f"with {cutoff(SPARK)} select cutoff from cut_", tx=ledger)
    causal = ledger.crossJoin(F.broadcast(until)).where("tx_timestamp <= cutoff")
    return network(spark, distinct_pairs(causal))


def full_feature_table(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """The 24 feature columns of every account, and its label; PageRank and core numbers
    count transfers up to the validation cut-off only, and are 0 for later accounts."""
    return features_of(spark, narrow_ledger(spark, tx))


def features_of(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    """The full feature table of a ledger that is a written table."""
    table = OPERATORS["feat_account_table"].apply(spark, {"tx": ledger})
    ranks, cores = causal_network(spark, ledger)
    found = table.join(ranks, "account_id", "left").join(cores, "account_id", "left")
    found = found.fillna({"pagerank": 0.0, "kcore_number": 0})
    return found.select("account_id", *FEATURE_COLUMNS, "is_laundering_label")


def networks(spark: SparkSession, sightings: DataFrame) -> DataFrame:
    """Components of accounts (``rekening``) and the sites (``url``) they appear on,
    risky first; single-site ones are left out."""
    edges = sightings.select(F.concat(F.lit("acc:"), "rekening").alias("a"), F.concat(F.lit("site:"), "url").alias("b"))
    found = connected_components(edges, Workspace(spark, "networks"), "networks")
    member = sightings.select(F.concat(F.lit("acc:"), "rekening").alias("node"), "rekening", "url").join(found, "node", "left")
    return (
        member.withColumn("root", F.coalesce("component", "node"))
        .groupBy("root")
        .agg(F.count_distinct("rekening").alias("accounts"), F.count_distinct("url").alias("sites"))
        .where("sites >= 2")
        .withColumn("risk_level", F.when(F.col("sites") >= 3, "HIGH").otherwise("MED"))
    )


def _pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pairs(fixture(spark, sf_dir, "tx"))


def feat_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(spark, _pairs_of(spark, sf_dir)).withColumn("pagerank", F.round("pagerank", 12))


def graph_personal_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs_of(spark, sf_dir)
    seeds = pairs.where("src = 42").select(F.col("src").alias("account_id"))
    return pagerank(spark, pairs, seeds=seeds).withColumn("pagerank", F.round("pagerank", 12))


def feat_kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kcore(spark, _pairs_of(spark, sf_dir))


def feat_full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_feature_table(spark, fixture(spark, sf_dir, "tx")).withColumn("pagerank", F.round("pagerank", 12))


def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, fixture(spark, sf_dir, "tx"), min_size=2)


def graph_cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixture_tables(spark, sf_dir, "{tx} {predictions}")
    return cluster_detail(spark, tables["tx"].where("is_laundering = 1"), scores=tables["predictions"])


def graph_cluster_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixture_tables(spark, sf_dir, "{tx} {predictions}")
    return cluster_drawing(spark, tables["tx"], scores=tables["predictions"])


def graph_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_stats(spark, _pairs_of(spark, sf_dir))


def graph_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(spark, fixture(spark, sf_dir, "tx"))


def graph_active_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_network_features(spark, fixture(spark, sf_dir, "tx")).withColumn("pagerank", F.round("pagerank", 12))


def osint_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks(spark, fixture(spark, sf_dir, "found"))


QUERIES = {
    "feat_pagerank": feat_pagerank,
    "feat_kcore": feat_kcore,
    "feat_full_table": feat_full_table,
    "graph_personal_pagerank": graph_personal_pagerank,
    "graph_clusters": graph_clusters,
    "graph_cluster_detail": graph_cluster_detail,
    "graph_cluster_drawing": graph_cluster_drawing,
    "graph_cluster_report": graph_cluster_report,
    "graph_component_stats": graph_component_stats,
    "graph_active_writeback": graph_active_writeback,
    "osint_networks": osint_networks,
}

COVERS = {
    "feat_pagerank": "F20 D5 O11", "feat_kcore": "F21 D15", "feat_full_table": "F22 F26", "graph_personal_pagerank": "G2",
    "graph_clusters": "G3 G5 M15", "graph_cluster_detail": "G6", "graph_cluster_drawing": "G6 J9", "graph_cluster_report": "G9", "graph_component_stats": "G4",
    "graph_active_writeback": "G12", "osint_networks": "N9",
}


def _components_sql(edges: str) -> str:
    """CTEs ``u`` and ``cc`` (``node, root``): labels that fall to the least id within reach."""
    return f"""e AS ({edges}), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  cc(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM u
    UNION SELECT u.b, min(now.root) FROM cc AS now JOIN u ON now.node = u.a JOIN recurring.cc AS old ON old.node = u.b
      WHERE now.root < old.root GROUP BY u.b)"""


def _pagerank_ctes(pairs: str, rounds: int, start: str) -> list[str]:
    """Unrolled power iterations, a CTE per round; ``r<rounds>`` has ``id, r``."""
    parts = [
        f"deg AS MATERIALIZED (SELECT from_account AS src, count(*) AS d FROM {pairs} GROUP BY 1)",
        "nodes AS MATERIALIZED (SELECT id, d, CAST(s AS DOUBLE) / sum(s) OVER () AS st FROM (SELECT id, d, "
        f"{start} AS s FROM (SELECT from_account AS id FROM {pairs} UNION SELECT to_account FROM {pairs}) v LEFT JOIN deg ON id = src) q)",
        "r0 AS MATERIALIZED (SELECT id, d, st, st AS r FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT n.id, n.d, n.st, 0.15 * n.st + 0.85 * (coalesce(g, 0) + "
            f"(SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE d IS NULL) * n.st) AS r FROM nodes n LEFT JOIN (SELECT to_account, sum(r / d) AS g "
            f"FROM {pairs} JOIN r{i - 1} ON from_account = id GROUP BY 1) x ON n.id = x.to_account)"
        )
    return parts


def _kcore_ctes(pairs: str) -> list[str]:
    """h-index steps by plain ranks of the neighbours, until no value falls; ``core`` has ``id, c``."""
    return [
        f"un AS MATERIALIZED (SELECT from_account AS a, to_account AS b FROM {pairs} UNION SELECT to_account, from_account FROM {pairs})",
        "core(id, c) USING KEY (id) AS (SELECT a, count(*) FROM un GROUP BY a "
        "UNION SELECT a, max(least(theirs, place)) FROM (SELECT a, old.c AS own, near.c AS theirs, row_number() OVER (PARTITION BY a ORDER BY near.c DESC) AS place "
        "FROM un JOIN recurring.core AS near ON b = near.id JOIN recurring.core AS old ON a = old.id) h GROUP BY a, own HAVING max(least(theirs, place)) < own)",
    ]


def _pagerank_sql(rounds: int, start: str) -> str:
    parts = [fixture_sql("{pairs}"), *_pagerank_ctes("pairs", rounds, start)]
    return f"WITH {', '.join(parts)} SELECT id AS account_id, {DUCK.round('r', 12)} AS pagerank FROM r{rounds}"


def _kcore_sql() -> str:
    return f"WITH RECURSIVE {', '.join([fixture_sql('{pairs}'), *_kcore_ctes('pairs')])} SELECT id AS account_id, c AS kcore_number FROM core"


def _full_sql() -> str:
    causal = f"causal AS MATERIALIZED (WITH {cutoff(DUCK)} SELECT DISTINCT from_account, to_account FROM tx CROSS JOIN cut_ WHERE tx_timestamp <= cutoff)"
    base = f"base AS ({OPERATORS['feat_account_table'].build(DUCK)})"
    parts = [fixture_sql("{tx}"), base, causal, *_pagerank_ctes("causal", 30, "1.0"), *_kcore_ctes("causal")]
    return (
        f"WITH RECURSIVE {', '.join(parts)} SELECT b.*, coalesce({DUCK.round('r', 12)}, 0) AS pagerank, coalesce(c, 0) AS kcore_number "
        f"FROM base b LEFT JOIN r30 ON b.account_id = r30.id LEFT JOIN core k ON b.account_id = k.id"
    ).replace("{tx}", "tx")


def _writeback_sql() -> str:
    parts = [fixture_sql("{pairs}"), *_pagerank_ctes("pairs", 30, "1.0"), *_kcore_ctes("pairs")]
    return (
        f"WITH RECURSIVE {', '.join(parts)}, late AS (SELECT * FROM tx WHERE tx_timestamp >= (SELECT max(tx_timestamp) FROM tx) - INTERVAL 30 DAY) "
        f"SELECT r30.id AS account_id, {DUCK.round('r', 12)} AS pagerank, c AS kcore_number FROM r30 JOIN core k ON r30.id = k.id "
        "WHERE r30.id IN (SELECT from_account FROM late UNION SELECT to_account FROM late)"
    )


_CLUSTERS = f"""WITH RECURSIVE {fixture_sql("{tx}")},
  {_components_sql("SELECT from_account AS a, to_account AS b FROM tx WHERE is_laundering = 1")},
  sized AS (SELECT root, count(*) AS size, list(node ORDER BY node)[1:5] AS first FROM cc GROUP BY root),
  n AS (SELECT root, count(*) AS illicit_edges FROM e JOIN cc ON a = node GROUP BY root),
  listed AS (SELECT printf('C%04d', row_number() OVER (ORDER BY size DESC, s.root)) AS cluster_id, s.root, size, illicit_edges,
    CASE WHEN size >= 20 THEN 'HIGH' WHEN size >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, array_to_string(first, ',') AS sample
    FROM sized s JOIN n ON s.root = n.root WHERE size >= @least)"""

def _drawing_sql(max_nodes: int = 120, max_edges: int = 2000, max_hops: int = 20) -> str:
    """Levels from the seed, unrolled; each takes what is left of the nodes."""
    parts = [
        _CLUSTERS.replace("@least", "1"),
        "own AS MATERIALIZED (SELECT node FROM cc WHERE root = (SELECT root FROM sized ORDER BY size DESC, root LIMIT 1))",
        "inside AS MATERIALIZED (SELECT * FROM tx WHERE from_account IN (SELECT node FROM own) AND to_account IN (SELECT node FROM own))",
        "near AS MATERIALIZED (SELECT from_account AS a, to_account AS b FROM inside WHERE from_account <> to_account "
        "UNION SELECT to_account, from_account FROM inside WHERE from_account <> to_account)",
        fixture_sql("{predictions}"),
        "nodes AS MATERIALIZED (SELECT a AS id, any_value(degree) AS degree, coalesce(max(risk_score), 0) AS risk FROM "
        "(SELECT a, count(*) AS degree FROM near GROUP BY a) d LEFT JOIN predictions ON a = account_id GROUP BY a)",
        "h0 AS MATERIALIZED (SELECT id, 0 AS hops FROM nodes ORDER BY degree * 1000 + risk DESC, id LIMIT 1)",
    ]
    for i in range(1, max_hops + 1):
        parts.append(
            f"h{i} AS MATERIALIZED (SELECT * FROM h{i - 1} UNION ALL SELECT id, {i} FROM (SELECT id, row_number() OVER (ORDER BY risk DESC, degree DESC, id) AS rn FROM nodes "
            f"WHERE id IN (SELECT b FROM near JOIN h{i - 1} ON a = id WHERE hops = {i - 1}) AND id NOT IN (SELECT id FROM h{i - 1})) q "
            f"WHERE rn <= {max_nodes} - (SELECT count(*) FROM h{i - 1}))"
        )
    return f"""{", ".join(parts)}
SELECT tx_id, from_account, x.hops AS from_hops, m.risk AS from_risk, to_account, y.hops AS to_hops, n.risk AS to_risk, CAST(amount AS DOUBLE) AS amount, is_laundering
FROM inside JOIN h{max_hops} x ON from_account = x.id JOIN h{max_hops} y ON to_account = y.id JOIN nodes m ON m.id = x.id JOIN nodes n ON n.id = y.id
ORDER BY tx_timestamp, tx_id, inside.amount LIMIT {max_edges}"""


SQL = {
    "graph_cluster_drawing": _drawing_sql(),
    "feat_pagerank": _pagerank_sql(30, "1.0"),
    "feat_kcore": _kcore_sql(),
    "feat_full_table": _full_sql(),
    "graph_personal_pagerank": _pagerank_sql(30, "CASE WHEN id = 42 THEN 1.0 ELSE 0.0 END"),
    "graph_active_writeback": _writeback_sql(),
    "graph_clusters": _CLUSTERS.replace("@least", "2") + " SELECT * FROM listed",
    "graph_cluster_report": _CLUSTERS.replace("@least", "1") + " SELECT cluster_id, size, illicit_edges, risk_level FROM listed ORDER BY cluster_id LIMIT 10",
    "graph_component_stats": f"""WITH RECURSIVE {fixture_sql("{pairs}")}, {_components_sql("SELECT from_account AS a, to_account AS b FROM pairs")},
  sized AS (SELECT root, count(*) AS n FROM cc GROUP BY root)
SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest FROM sized""",
    "osint_networks": f"""WITH RECURSIVE {fixture_sql("{found}")},
  {_components_sql("SELECT DISTINCT 'acc:' || rekening AS a, 'site:' || url AS b FROM found")}
SELECT root, count(DISTINCT a) AS accounts, count(DISTINCT b) AS sites, CASE WHEN count(DISTINCT b) >= 3 THEN 'HIGH' ELSE 'MED' END AS risk_level
FROM e JOIN cc ON a = node GROUP BY root HAVING count(DISTINCT b) >= 2""",
}
