"""Traversal, reflection, clustering, hierarchy and merging."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import scoring as S, vec as V
from memloom.operators import graph as G
from memloom.operators.components import connected_components
from memloom.plans.base import ASSOC, EDGES, HIER, NODES, query, r6
from memloom.plans.retrieval import VECTORS, vector_topk, vectors
from memloom.sources import tables as T
from memloom.sources.shared import materialize

LATERAL = "('CO_ACTIVATED_WITH', 'ASSOCIATED_WITH')"

REFLECT = f"""with recursive {EDGES}, und as (select distinct src, dst from edges_m where rel_type in {LATERAL} union select dst, src from edges_m where rel_type in {LATERAL}),
roots as (select space_id, min(node_id) root from nodes_m group by 1), """


def reflect_roots(spark, d):
    n = T.nodes(spark, d)
    return n.groupBy("space_id").agg(F.min("node_id").alias("root")).select("root", F.col("root").alias("node"))


def undirected(edges):
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query(
    "reflect_lateral",
    REFLECT
    + """w(root, node, dist) as (select root, root, 0 from roots union select w.root, u.dst, w.dist + 1 from w join und u on u.src = w.node where w.dist < 3),
m as (select root, node, min(dist) dist from w group by 1, 2), k as (select *, row_number() over (partition by root order by dist, node) r from m)
select root, node, dist::int as distance, round(1.0 / (1 + dist), 6) as score from k where r <= 200""",
)
def reflect_lateral(spark, d):
    """Breadth-first from each space's first node over learned and similarity links, 3 steps, 200 nodes."""
    e = undirected(T.edges(spark, d).where(f"rel_type in {LATERAL}"))
    return G.bfs(reflect_roots(spark, d), e, 3, 200).select("root", "node", "distance", r6(1.0 / (1 + F.col("distance"))).alias("score"))


def vector_core(spark, d):
    """(root, node): the nodes of the 20 observations nearest to each that ``vector_topk`` asks for."""
    near = vector_topk(spark, d).select(F.col("query_id").alias("root"), F.col("node_id").alias("obs_id"))
    return near.join(T.observations(spark, d, "node_id").where("node_id is not null"), "obs_id").select("root", "node_id").distinct().withColumnRenamed("node_id", "node")


@query("reflect_queries")
def reflect_queries(spark, d):
    """``reflect_lateral`` from the vector core of every observation whose number is divisible by 100, 3 steps, 200 nodes a query."""
    e = undirected(T.edges(spark, d).where(f"rel_type in {LATERAL}"))
    return G.bfs(vector_core(spark, d), e, 3, 200).select("root", "node", "distance", r6(1.0 / (1 + F.col("distance"))).alias("score"))


@query(
    "reflect_abstractions",
    f"""with recursive {NODES}, {HIER}, w(root, node, dist) as (select src, dst, 1 from hier where rel_type = 'GENERALIZES' union select w.root, h.dst, w.dist + 1 from w join hier h on h.src = w.node where w.dist < 3)
select w.root, w.node, min(dist)::int as distance, round((1 + 0.1 * any_value(n.layer)) / (1 + min(dist)), 6) as score from w join nodes_m n on n.node_id = w.node group by 1, 2""",
)
def reflect_abstractions(spark, d):
    """Everything above each base node, up to three steps."""
    e = T.hierarchy_edges(spark, d)
    seeds = e.where("rel_type = 'GENERALIZES'").select(F.col("src").alias("root"), F.col("src").alias("node"))
    up = G.bfs(seeds, e, 3).where("distance > 0").join(T.nodes(spark, d).select(F.col("node_id").alias("node"), "layer"), "node")
    return up.select("root", "node", "distance", r6((1 + 0.1 * F.col("layer")) / (1 + F.col("distance"))).alias("score"))


@query(
    "graph_triangles",
    f"""with {ASSOC}, e as (select distinct least(src, dst) x, greatest(src, dst) y from assoc where dim_semantic >= 0.8)
select p.x as a, p.y as b, q.y as c from e p join e q on q.x = p.y join e r on r.x = p.x and r.y = q.y""",
)
def graph_triangles(spark, d):
    return G.triangles(T.similar_edges(spark, d).where("dim_semantic >= 0.8"))


@query(
    "triangle_clusters",
    f"""with recursive {ASSOC}, e as (select distinct least(src, dst) x, greatest(src, dst) y from assoc where dim_semantic >= 0.8),
t as (select p.x a, p.y b, q.y c from e p join e q on q.x = p.y join e r on r.x = p.x and r.y = q.y),
l as (select a x, b y from t union select b, c from t union select a, c from t), u as (select x, y from l union select y, x from l),
w(root, node) as (select x, x from u union select w.root, u.y from w join u on u.x = w.node where u.y > w.root)
select node, min(root) as cluster from w group by 1""",
)
def triangle_clusters(spark, d):
    """Triangles that share an edge grow together."""
    t = materialize(G.triangles(T.similar_edges(spark, d).where("dim_semantic >= 0.8")), "triangles")
    pairs = t.select("a", "b").unionByName(t.select(F.col("b").alias("a"), F.col("c").alias("b"))).unionByName(t.select("a", F.col("c").alias("b")))
    return connected_components(pairs, "a", "b").select("node", F.col("component").alias("cluster"))


@query(
    "ancestor_paths",
    f"""with recursive {NODES}, {HIER}, w(node_id, ancestor, depth) as (select src, dst, 1 from hier union all select w.node_id, h.dst, depth + 1 from w join hier h on h.src = w.ancestor where depth < 5)
select node_id, ancestor, min(depth)::int as depth from w group by 1, 2""",
)
def ancestor_paths(spark, d):
    e = T.hierarchy_edges(spark, d)
    return G.bfs(e.select(F.col("src").alias("root"), F.col("src").alias("node")), e, 5).where("distance > 0").select(F.col("root").alias("node_id"), F.col("node").alias("ancestor"), F.col("distance").alias("depth"))


@query(
    "related_concepts",
    f"""with recursive {NODES}, {HIER}, w(node_id, up, depth) as (select src, dst, 1 from hier where rel_type = 'ABSTRACTS_TO' or rel_type = 'GENERALIZES' union all select w.node_id, h.dst, depth + 1 from w join hier h on h.src = w.up where depth < 3),
r as (select query_id, node_id from retrieve_results where node_id is not null group by 1, 2), c as (select query_id, count(*) n from r group by 1),
g as (select r.query_id, w.up, count(distinct r.node_id) k from r join w using (node_id) group by 1, 2),
s as (select g.query_id, up concept, k / c.n rel, n.layer from g join c using (query_id) join nodes_m n on n.node_id = up where n.layer >= 2),
k as (select *, row_number() over (partition by query_id order by round(rel, 9) desc, layer, concept) rk from s) select query_id, concept, round(rel, 6) as relevance, rk as rank from k where rk <= 5""",
)
def related_concepts(spark, d):
    """The share of a query's results that reach a concept within three steps up."""
    e = T.hierarchy_edges(spark, d)
    r = T.table(spark, d, "retrieve_results").where("node_id is not null").select("query_id", "node_id").distinct()
    up = G.bfs(e.select(F.col("src").alias("root"), F.col("src").alias("node")), e, 3).where("distance > 0").select(F.col("root").alias("node_id"), F.col("node").alias("concept"))
    n = r.groupBy("query_id").agg(F.count("*").alias("n"))
    s = r.join(up, "node_id").groupBy("query_id", "concept").agg(F.count_distinct("node_id").alias("k")).join(n, "query_id")
    s = s.join(T.nodes(spark, d).where("layer >= 2").select(F.col("node_id").alias("concept"), "layer"), "concept").withColumn("rel", F.col("k") / F.col("n"))
    k = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rel", 9).desc(), "layer", "concept")).cast("long"))
    return k.where("rank <= 5").select("query_id", "concept", r6("rel").alias("relevance"), "rank")


PAIRS_SQL = f"{VECTORS}, sp as (select a.space_id, a.obs_id a, b.obs_id b, round(list_cosine_similarity(a.v, b.v), 6) sim from vecs a join vecs b on a.space_id = b.space_id and a.obs_id < b.obs_id)"


def _grouped(spark, d):
    return vectors(spark, d).withColumnRenamed("space_id", "grp")


@query("similar_pairs_98", f"with {PAIRS_SQL} select space_id, a, b, sim from sp where sim >= 0.98")
def similar_pairs_98(spark, d):
    """Merge candidates: pairs of one space at 0.98 or more."""
    return G.similar_pairs(_grouped(spark, d), 0.98).withColumnRenamed("grp", "space_id")


DBSCAN = f"""with recursive {PAIRS_SQL}, p as (select a, b from sp where sim >= 0.9 union all select b, a from sp where sim >= 0.9),
core as (select a id from p group by 1 having count(*) >= 3), cc as (select p.a, p.b from p where a in (select id from core) and b in (select id from core)),
w(root, id) as (select id, id from core union select w.root, cc.b from w join cc on cc.a = w.id where cc.b > w.root), lab as (select id, min(root) cluster from w group by 1),
brd as (select p.a id, min(l.cluster) cluster from p join lab l on l.id = p.b where p.a not in (select id from core) group by 1), lb as (select * from lab union all select * from brd)"""


@query("dbscan_labels", DBSCAN + " select v.space_id, v.obs_id as obs_id, lb.cluster from vecs v left join lb on lb.id = v.obs_id")
def dbscan_labels(spark, d):
    return G.dbscan(_grouped(spark, d), 0.1, 3).withColumnsRenamed({"grp": "space_id", "id": "obs_id"})


def clusters_with_vectors(spark, d):
    lab = materialize(G.dbscan(_grouped(spark, d), 0.1, 3).where("cluster is not null"), "dbscan")
    return lab, vectors(spark, d).join(lab.select("id", "cluster"), "id")


@query(
    "cluster_centroids",
    DBSCAN
    + """, ex as (select cluster, unnest(v) x, unnest(range(1, 65)) pos from vecs join lb on lb.id = obs_id), m as (select cluster, pos, avg(x) x from ex group by 1, 2), c as (select cluster, list(x order by pos) c from m group by 1)
select lb.cluster, count(*) as size, round(avg(list_cosine_similarity(v.v, c.c)), 6) as cohesion from vecs v join lb on lb.id = v.obs_id join c on c.cluster = lb.cluster group by 1""",
)
def cluster_centroids(spark, d):
    """Size of each cluster and its members' mean cosine to the centroid."""
    _, rows = clusters_with_vectors(spark, d)
    rows = materialize(rows, "members")
    mean = G.mean_vectors(rows, "cluster")
    return rows.join(mean, "cluster").groupBy("cluster").agg(F.count("*").alias("size"), r6(F.avg(V.cosine(F.col("vec"), F.col("mean")))).alias("cohesion"))


@query(
    "hidden_nodes",
    DBSCAN
    + f""", {NODES}, mm as (select lb.cluster, o.obs_id, n.path, row_number() over (partition by lb.cluster order by o.obs_id) r from lb join (select distinct obs_id, node_id from observations) o on o.obs_id = lb.id left join nodes_m n on n.node_id = o.node_id),
ch as (select cluster, (r - 1) // 20 chunk, count(*) n, min(obs_id) first_member, count(distinct split_part(path, '/', 3)) dirs from mm group by 1, 2)
select cluster || '#' || chunk as hidden_id, n as members, first_member, dirs, 'Pattern of ' || n || ' elements in ' || dirs || ' groups' as summary from ch""",
)
def hidden_nodes(spark, d):
    """Clusters above 20 members are cut into chunks in order; each gets a node and a summary."""
    lab, _ = clusters_with_vectors(spark, d)
    o = T.observations(spark, d, "node_id")
    m = lab.join(o, lab["id"] == o["obs_id"]).join(T.nodes(spark, d).select("node_id", "path"), "node_id", "left")
    m = m.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("cluster").orderBy("obs_id")) - 1) / 20))
    g = m.groupBy("cluster", "chunk").agg(F.count("*").alias("members"), F.min("obs_id").alias("first_member"), F.count_distinct(F.split("path", "/")[2]).alias("dirs"))
    text = F.concat(F.lit("Pattern of "), F.col("members").cast("string"), F.lit(" elements in "), F.col("dirs").cast("string"), F.lit(" groups"))
    return g.select(F.concat_ws("#", "cluster", F.col("chunk").cast("string")).alias("hidden_id"), "members", "first_member", "dirs", text.alias("summary"))


CHILD = f"""{VECTORS}, {NODES}, {HIER}, nv as (select n.node_id, o.v from nodes_m n join (select distinct node_id, embedding::double[] v from observations where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0) o using (node_id))"""


def node_vectors(spark, d):
    v = T.observations(spark, d, "node_id", "embedding").where(V.usable(F.col("embedding")))
    return v.select("node_id", F.col("embedding").alias("vec")).distinct()


def unlinked_base(spark, d):
    """(grp, id, path, vec): nodes of layer 0 without a parent, with the vector of their first observation."""
    v = T.observations(spark, d, "node_id", "embedding").where(V.usable(F.col("embedding")) & F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min_by("embedding", "obs_id").alias("vec"))
    linked = T.hierarchy_edges(spark, d).where("rel_type = 'GENERALIZES'").select(F.col("src").alias("node_id"))
    base = T.nodes(spark, d).where("layer = 0 and space_id is not null").select("space_id", "node_id", "path").join(linked, "node_id", "left_anti")
    return base.join(v, "node_id").select(F.col("space_id").alias("grp"), F.col("node_id").alias("id"), "path", "vec")


def _hidden_members(spark, d):
    base = materialize(unlinked_base(spark, d), "base")
    lab = materialize(G.dbscan(base.select("grp", "id", "vec"), 0.1, 3).where("cluster is not null"), "dbscan")
    return materialize(G.split_clusters(base.join(lab.select("id", "cluster"), "id"), 200, 2, 3), "members")


@query("hidden_layer")
def hidden_layer(spark, d):
    """A node per cluster of unlinked base nodes, with its centroid; clusters above 200 are cut by path and then in runs of 200."""
    m = _hidden_members(spark, d)
    mean = G.mean_vectors(m, "hidden_id").withColumnRenamed("mean", "centroid")
    g = m.groupBy("hidden_id").agg(F.first("grp").alias("space_id"), F.count("*").alias("members"), F.min("id").alias("first_member"), F.count_distinct("prefix").alias("dirs"))
    text = F.concat(F.lit("Pattern of "), F.col("members").cast("string"), F.lit(" elements in "), F.col("dirs").cast("string"), F.lit(" groups"))
    return g.join(mean, "hidden_id").withColumn("summary", text)


@query("hidden_edges")
def hidden_edges(spark, d):
    """GENERALIZES from every member to its hidden node; the weight is 1 less half the distance to the centroid."""
    m = _hidden_members(spark, d)
    gap = F.zip_with("vec", "mean", lambda x, y: x.cast("double") - y)
    e = m.join(G.mean_vectors(m, "hidden_id"), "hidden_id")
    return e.select(F.col("grp").alias("space_id"), F.col("id").alias("src"), F.col("hidden_id").alias("dst"), F.lit("GENERALIZES").alias("rel_type"), r6(1.0 - V.norm(gap) / 2).alias("weight"))


@query(
    "forward_pass",
    f"""with {CHILD}, ex as (select h.dst, h.weight w, unnest(c.v) x, unnest(range(1, 65)) pos from hier h join nv c on c.node_id = h.src), m as (select dst, pos, sum(w * x) / sum(w) x from ex group by 1, 2), a as (select dst, list(x order by pos) agg from m group by 1),
f as (select a.dst node_id, list_transform(list_zip(p.v, a.agg), lambda z: 0.6 * z[1] + 0.4 * z[2]) nw, p.v from a join nv p on p.node_id = a.dst) select node_id, round(list_cosine_similarity(nw, v), 6) as stability from f""",
)
def forward_pass(spark, d):
    """0.6 of the node's own vector and 0.4 of its children's weighted mean; reports how near it stays to itself."""
    v = materialize(node_vectors(spark, d), "vectors")
    e = T.hierarchy_edges(spark, d).select(F.col("src").alias("node_id"), "dst", "weight")
    mean = G.mean_vectors(e.join(v, "node_id").select("dst", "weight", "vec"), "dst", weight=F.col("weight")).withColumnRenamed("dst", "node_id")
    new = F.zip_with("vec", "mean", lambda x, y: 0.6 * x.cast("double") + 0.4 * y)
    return mean.join(v, "node_id").select("node_id", r6(V.cosine(new, F.col("vec"))).alias("stability"))


@query(
    "backward_pass",
    f"""with {CHILD}, b as (select h.dst node_id, unnest(c.v) x, unnest(range(1, 65)) pos from hier h join nv c on c.node_id = h.src), bm as (select node_id, list(x order by pos) base from (select node_id, pos, avg(x) x from b group by 1, 2) group by 1),
u as (select h.src node_id, unnest(c.v) x, unnest(range(1, 65)) pos from hier h join nv c on c.node_id = h.dst), um as (select node_id, list(x order by pos) up from (select node_id, pos, avg(x) x from u group by 1, 2) group by 1),
f as (select nv.node_id, v, list_transform(list_zip(v, coalesce(base, v), coalesce(up, v)), lambda z: 0.2 * z[1] + 0.5 * z[2] + 0.3 * z[3]) nw from nv join nodes_m n using (node_id) left join bm using (node_id) left join um using (node_id) where n.layer = 1)
select node_id, round(list_cosine_similarity(nw, v), 6) as stability from f""",
)
def backward_pass(spark, d):
    """0.2 self, 0.5 mean of the children, 0.3 mean of the parents; a missing side falls back to the node itself."""
    v = materialize(node_vectors(spark, d), "vectors")
    e = T.hierarchy_edges(spark, d)
    base = G.mean_vectors(e.select(F.col("src").alias("node_id"), F.col("dst").alias("to")).join(v, "node_id"), "to").select(F.col("to").alias("node_id"), F.col("mean").alias("base"))
    up = G.mean_vectors(e.select(F.col("dst").alias("node_id"), F.col("src").alias("to")).join(v, "node_id"), "to").select(F.col("to").alias("node_id"), F.col("mean").alias("up"))
    own = v.join(T.nodes(spark, d).where("layer = 1").select("node_id"), "node_id", "left_semi").join(base, "node_id", "left").join(up, "node_id", "left")
    self_ = F.transform("vec", lambda x: x.cast("double"))
    two = F.zip_with(self_, F.coalesce("base", self_), lambda x, y: 0.2 * x + 0.5 * y)
    new = F.zip_with(two, F.coalesce("up", self_), lambda x, y: x + 0.3 * y)
    return own.select("node_id", r6(V.cosine(new, F.col("vec"))).alias("stability"))


KIND = """case when sim >= 0.7 and la = lb then 'ANALOGOUS_TO' when sim <= 0.3 and co >= 0.5 then 'CONTRASTS_WITH' when co >= 0.5 and sim >= 0.4 and sim < 0.7 then 'COMPOSES_WITH'
  when la <> lb and sim >= 0.4 and sim < 0.7 then 'BRIDGES' when la <> lb and sim >= 0.7 then case when la < lb then 'GENERALIZES_TO' else 'SPECIALIZES' end else 'INFLUENCES' end"""
KCONF = """case when sim >= 0.7 and la = lb then sim when sim <= 0.3 and co >= 0.5 then co * (1 - sim) when co >= 0.5 and sim >= 0.4 and sim < 0.7 then co
  when la <> lb and sim >= 0.4 and sim < 0.7 then least(1.0, sim * (1 + 0.1 * abs(la - lb))) when la <> lb and sim >= 0.7 then sim else 0.5 end"""


@query(
    "dynamic_edges",
    f"""with {CHILD}, p as (select n.space_id, a.node_id a, b.node_id b, round(list_cosine_similarity(a.v, b.v), 6) sim, n.layer la, m.layer lb, 0.0 co from nv a join nodes_m n on n.node_id = a.node_id join nodes_m m on m.space_id = n.space_id and m.node_id > n.node_id join nv b on b.node_id = m.node_id where n.layer >= 2 and m.layer >= 2),
q as (select *, {KIND} kind, {KCONF} conf, row_number() over (partition by space_id order by sim desc, a, b) r from p where sim > 0.3 and not exists (select 1 from hier h where (h.src = a and h.dst = b) or (h.src = b and h.dst = a)))
select space_id, a, b, sim, kind, round(conf, 6) as confidence from q where r <= 50 and conf >= 0.5""",
)
def dynamic_edges(spark, d):
    """The 50 most similar unlinked pairs of upper nodes of each space, typed; kept from a confidence of 0.5."""
    n = T.nodes(spark, d).where("layer >= 2").select("space_id", "node_id", "layer")
    up = node_vectors(spark, d).join(n, "node_id").select(F.col("space_id").alias("grp"), F.col("node_id").alias("id"), "vec")
    pairs = G.similar_pairs(up, 0.300001)
    e = T.hierarchy_edges(spark, d)
    linked = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    layer = n.select("node_id", "layer")
    p = pairs.join(linked, ["a", "b"], "left_anti").join(layer.withColumnsRenamed({"node_id": "a", "layer": "la"}), "a").join(layer.withColumnsRenamed({"node_id": "b", "layer": "lb"}), "b")
    kind, conf = S.edge_kind(F.col("sim"), F.lit(0.0), F.col("la"), F.col("lb"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("sim"), "a", "b"))).where("r <= 50")
    return p.withColumn("kind", kind).withColumn("conf", conf).where("conf >= 0.5").select(F.col("grp").alias("space_id"), "a", "b", "sim", "kind", r6("conf").alias("confidence"))


@query(
    "emergent_components",
    f"""with recursive {ASSOC}, {NODES}, tp as (select space_id, src, dst from (select *, row_number() over (partition by space_id order by dim_semantic desc, src, dst) r from assoc where dim_semantic >= 0.7) where r <= 20),
u as (select src x, dst y from tp union select dst, src from tp), w(root, node) as (select x, x from u union select w.root, u.y from w join u on u.x = w.node where u.y > w.root), c as (select node, min(root) c from w group by 1)
select c as component, count(*) as members, 'Emergent: ' || array_to_string(list(n.name order by node)[1:3], ' + ') as name from c join nodes_m n on n.node_id = c.node group by 1""",
)
def emergent_components(spark, d):
    """Components of each space's 20 strongest links, named after their first three members."""
    top = T.similar_edges(spark, d).where("dim_semantic >= 0.7").withColumn("r", F.row_number().over(Window.partitionBy("space_id").orderBy(F.desc("dim_semantic"), "src", "dst"))).where("r <= 20")
    c = connected_components(top, "src", "dst").join(T.nodes(spark, d).select(F.col("node_id").alias("node"), "name"), "node")
    w = Window.partitionBy("component")
    c = c.withColumn("r", F.row_number().over(w.orderBy("node"))).withColumn("members", F.count("*").over(w))
    first = c.where("r <= 3").groupBy("component", "members").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("f"))
    return first.select("component", "members", F.concat(F.lit("Emergent: "), F.array_join(F.transform("f", lambda x: x["name"]), " + ")).alias("name"))


@query(
    "node_types",
    f"""with {EDGES}, nx as (select distinct node_id, split_part(path, '/', 3) dom from nodes_m), inn as (select dst node_id, count(*) i, count(distinct dom) / count(*) div from edges_m e join nx on nx.node_id = e.src group by 1), outt as (select src node_id, count(*) o from edges_m group by 1),
x as (select e.a node_id, count(distinct n2.dom) c from (select src a, dst b from edges_m union all select dst, src from edges_m) e join nx n1 on n1.node_id = e.a join nx n2 on n2.node_id = e.b where n1.dom <> n2.dom group by 1),
s as (select node_id, max(stability_score) st from observations group by 1),
m as (select n.node_id, n.layer, coalesce(i, 0) i, coalesce(o, 0) o, coalesce(i, 0) + coalesce(o, 0) dg, coalesce(c, 0) c, coalesce(st, 0) st, coalesce(div, 0) div from nodes_m n left join inn using (node_id) left join outt using (node_id) left join x using (node_id) left join s using (node_id) where n.layer >= 1)
select node_id, case when c >= 3 then 'bridge' when dg >= 10 then 'hub' when st >= 0.8 and layer >= 2 then 'principle' when st >= 0.8 then 'established' when i >= 3 and div >= 0.5 then 'pattern' when st < 0.5 then 'emergent' else 'pattern' end as node_type,
  round(case when c >= 3 then c / greatest(dg, 1) when dg >= 10 then least(1.0, dg / 20) when st >= 0.8 then st when i >= 3 and div >= 0.5 then div when st < 0.5 then 1 - st else 0.5 end, 6) as confidence from m""",
)
def node_types(spark, d):
    e = materialize(T.edges(spark, d).select("src", "dst"), "edges")
    n = T.nodes(spark, d)
    dom = n.select("node_id", F.split("path", "/")[2].alias("dom")).distinct()
    inn = e.join(dom.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("i"), (F.count_distinct("dom") / F.count("*")).alias("div"))
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    x = both.join(dom.withColumnsRenamed({"node_id": "src", "dom": "d1"}), "src").join(dom.withColumnsRenamed({"node_id": "dst", "dom": "d2"}), "dst").where("d1 <> d2")
    x = x.groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("d2").alias("c"))
    s = T.table(spark, d, "observations").groupBy("node_id").agg(F.max("stability_score").alias("st"))
    m = n.where("layer >= 1").select("node_id", "layer").join(inn, "node_id", "left").join(out, "node_id", "left").join(x, "node_id", "left").join(s, "node_id", "left").fillna(0, ["i", "o", "c", "st", "div"])
    i, c, st, div, dg = F.col("i"), F.col("c"), F.col("st"), F.col("div"), F.col("i") + F.col("o")
    kind = F.when(c >= 3, "bridge").when(dg >= 10, "hub").when((st >= 0.8) & (F.col("layer") >= 2), "principle").when(st >= 0.8, "established").when((i >= 3) & (div >= 0.5), "pattern").when(st < 0.5, "emergent").otherwise("pattern")
    conf = F.when(c >= 3, c / F.greatest(dg, F.lit(1))).when(dg >= 10, F.least(F.lit(1.0), dg / 20)).when(st >= 0.8, st).when((i >= 3) & (div >= 0.5), div).when(st < 0.5, 1 - st).otherwise(0.5)
    return m.select("node_id", kind.alias("node_type"), r6(conf).alias("confidence"))


@query(
    "merge_redundant",
    f"""with recursive {CHILD}, p as (select a.node_id a, b.node_id b from nv a join nodes_m n on n.node_id = a.node_id join nodes_m m on m.space_id = n.space_id and m.layer = n.layer and m.node_id > n.node_id join nv b on b.node_id = m.node_id where round(list_cosine_similarity(a.v, b.v), 6) >= 0.98),
u as (select a x, b y from p union select b, a from p), w(root, node) as (select x, x from u union select w.root, u.y from w join u on u.x = w.node where u.y > w.root), c as (select node, min(root) c from w group by 1),
s as (select c.c, arg_min(node, (created_at, node)) survivor from c join nodes_m n on n.node_id = node group by 1) select node as node_id, survivor from c join s using (c) where node <> survivor""",
)
def merge_redundant(spark, d):
    """Nodes of one space and layer at 0.98 or more merge into the oldest of their component."""
    n = T.nodes(spark, d)
    v = node_vectors(spark, d).join(n.select("node_id", F.concat_ws("/", "space_id", F.col("layer").cast("string")).alias("grp")), "node_id")
    pairs = G.similar_pairs(v.select("grp", F.col("node_id").alias("id"), "vec"), 0.98)
    c = connected_components(pairs, "a", "b").join(n.select(F.col("node_id").alias("node"), "created_at"), "node")
    s = c.groupBy("component").agg(F.min(F.struct("created_at", "node")).alias("s"))
    return c.join(s, "component").where(F.col("node") != F.col("s.node")).select(F.col("node").alias("node_id"), F.col("s.node").alias("survivor"))


@query(
    "unlinked_observations",
    f"with {NODES}, {HIER} select n.node_id from nodes_m n where n.layer = 0 and n.role_type = 'conversation_observation' and not exists (select 1 from hier h where h.src = n.node_id)",
)
def unlinked_observations(spark, d):
    """Base nodes no upper node covers."""
    n = T.nodes(spark, d).where("layer = 0 and role_type = 'conversation_observation'").select("node_id")
    return n.join(T.hierarchy_edges(spark, d).select(F.col("src").alias("node_id")), "node_id", "left_anti")


@query(
    "edges_among_results",
    f"with {ASSOC}, r as (select distinct query_id, node_id from retrieve_results where node_id is not null) select a.query_id, e.src, e.dst, round(e.dim_semantic, 6) as sim from assoc e join r a on a.node_id = e.src join r b on b.node_id = e.dst and b.query_id = a.query_id",
)
def edges_among_results(spark, d):
    """Links with both ends among one query's results."""
    r = T.table(spark, d, "retrieve_results").where("node_id is not null").select("query_id", "node_id").distinct()
    e = T.similar_edges(spark, d).select("src", "dst", "dim_semantic")
    x = e.join(r.withColumnRenamed("node_id", "src"), "src").join(r.withColumnsRenamed({"node_id": "dst"}), ["query_id", "dst"], "left_semi")
    return x.select("query_id", "src", "dst", r6("dim_semantic").alias("sim"))
