"""Graph features of (gene, disease) pairs (F1-F20). Sums are taken before joins where algebra allows, so no path is materialised."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hypergeometric_z, inverse_power
from . import walks
from .products import products
from .store import release, written

GATE = 20
#: Members of a group in one slice, about.
MEMBERS = 4096


def module_size(assoc: DataFrame, gate: int = GATE) -> DataFrame:
    """(disease_index, module_size): distinct genes, of diseases with ``gate`` or more (F1, A3)."""
    return assoc.groupBy("disease_index").agg(F.countDistinct("gene_index").alias("module_size")).where(F.col("module_size") >= gate)


def degrees(edges: DataFrame, node: str, out: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("gene_index")).agg(F.count("*").alias(out))


def degree_controls(genes: DataFrame, ppi: DataFrame, assoc: DataFrame, pathway: DataFrame) -> DataFrame:
    """Per gene: interactions (edges are stored both ways and counted half), diseases, pathways; 0 if none (F2)."""
    out = genes.select("gene_index").join(degrees(ppi.select("x_index").unionAll(ppi.select("y_index")), "x_index", "d"), "gene_index", "left")
    out = out.join(degrees(assoc, "gene_index", "n_diseases"), "gene_index", "left").join(degrees(pathway, "gene_index", "n_pathways"), "gene_index", "left")
    return out.select("gene_index", F.coalesce(F.expr("d div 2"), F.lit(0)).cast("long").alias("ppi_degree"), F.coalesce("n_diseases", F.lit(0)).cast("long").alias("n_diseases"), F.coalesce("n_pathways", F.lit(0)).cast("long").alias("n_pathways"))


def dwpc_ggd(ppi: DataFrame, assoc: DataFrame, gate: int = GATE, w: float = 0.4) -> DataFrame:
    """Degree-weighted paths gene - gene - disease (F3): the sum over m of (deg_g deg_m assoc_m (module_D - [g in D])) ** -w.

    ppi holds every edge both ways; each of its rows is a path's first step. The factor of the last node is split by whether g is
    in the module, so the sum runs over (m, D) factors once.
    """
    ppi, assoc = written(ppi.select("x_index", "y_index")), written(assoc)
    modules = module_size(assoc, gate)
    deg = degrees(ppi, "x_index", "deg")
    seen = degrees(assoc, "gene_index", "n_assoc")
    ends = assoc.join(modules, "disease_index").join(seen, "gene_index").join(deg, "gene_index").select(F.col("gene_index").alias("m"), "disease_index", "module_size", inverse_power(F.col("deg") * F.col("n_assoc"), w).alias("f"))
    found = products(ppi, ends.select("m", "disease_index", "f", "module_size"), ["rows", "s0", "own", "attribute"], assoc.withColumn("inside", F.lit(1)), attribute=True)
    inside = F.col("own").isNotNull().cast("long")
    return found.select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), (F.col("s0") * inverse_power(F.col("rows"), w) * inverse_power(F.col("attribute") - inside, w)).alias("dwpc")).where("dwpc > 0")


def dwpc_through(annotation: DataFrame, assoc: DataFrame, gate: int = GATE, w: float = 0.4, max_fanout: int | None = None, eligible_only: bool = False) -> DataFrame:
    """Degree-weighted paths gene - term - gene - disease (F4, F6): the term's degree counts twice, the path back to g is left out.

    ``max_fanout`` drops terms of more genes; ``eligible_only`` counts a gene's associations over gated diseases only. The middle
    table is (term, disease); a gene's own share of it is subtracted instead of filtered out of the paths.
    """
    annotation, assoc = written(annotation), written(assoc)
    modules = module_size(assoc, gate)
    if max_fanout:
        wide = annotation.groupBy("term_index").agg(F.count("*").alias("fan")).where(F.col("fan") <= max_fanout).select("term_index")
        annotation = annotation.join(wide, "term_index", "left_semi")
    terms = annotation.groupBy("term_index").agg(F.count("*").alias("term_deg"))
    deg = degrees(annotation, "gene_index", "deg")
    scope = assoc.join(modules, "disease_index", "left_semi") if eligible_only else assoc
    seen = degrees(scope, "gene_index", "n_assoc")
    ends = assoc.join(modules, "disease_index").join(seen, "gene_index").join(deg, "gene_index").select("gene_index", "disease_index", "module_size", inverse_power(F.col("deg") * F.col("n_assoc"), w).alias("f"))
    ends = written(ends)
    middle = annotation.join(ends, "gene_index").groupBy("term_index", "disease_index").agg(F.sum("f").alias("f"), (F.count("*") - 1).alias("others"), F.max("module_size").alias("module_size"))
    first = annotation.join(terms, "term_index").select("gene_index", "term_index", F.pow(inverse_power(F.col("term_deg"), w), F.lit(2.0)).alias("t"))
    found = products(first, middle, ["rows", "total", "s0", "s1", "own", "attribute"], ends.select("gene_index", "disease_index", "f"), attribute=True)
    # A gene of the module has its own share f * t in each of its terms.
    inside = F.col("own").isNotNull().cast("long")
    value = (F.col("s0") - F.coalesce(F.col("own") * F.col("total"), F.lit(0.0))) * inverse_power(F.col("rows"), w) * inverse_power(F.col("attribute") - inside, w)
    # A pair is there if some path leads over another gene; the difference of sums alone couldn't tell a small rest from rounding.
    return found.where("own IS NULL OR s1 > 0").select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), F.greatest(value, F.lit(0.0)).alias("dwpc"))


def dwpc_via_drug(drug_protein: DataFrame, drug_disease: DataFrame, w: float = 0.4) -> DataFrame:
    """Degree-weighted paths gene - drug - disease over both relations, no leave-one-out."""
    gd, dd = written(drug_protein.select("gene_index", "drug").distinct()), written(drug_disease.select("drug", "disease_index").distinct())
    deg = lambda df, key, out: df.groupBy(key).agg(F.count("*").alias(out))
    left = gd.join(deg(gd, "gene_index", "a"), "gene_index").join(deg(gd, "drug", "b"), "drug").select("gene_index", "drug", inverse_power(F.col("a") * F.col("b"), w).alias("f"))
    right = dd.join(deg(dd, "drug", "c"), "drug").join(deg(dd, "disease_index", "d"), "disease_index").select("drug", "disease_index", inverse_power(F.col("c") * F.col("d"), w).alias("h"))
    return products(left, right, ["s0"]).select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), F.col("s0").alias("dwpc"))


def neighbourhood(ppi: DataFrame, assoc: DataFrame, gate: int = GATE) -> DataFrame:
    """Common neighbours, Adamic-Adar and Jaccard of a gene's neighbours with a module (F7). Simple degrees; leaves weigh 0."""
    simple, assoc = written(ppi.select("x_index", "y_index").distinct()), written(assoc)
    modules = module_size(assoc, gate)
    deg = degrees(simple, "x_index", "deg")
    weight = F.when(F.col("deg") > 1, 1 / F.ln("deg")).otherwise(F.lit(0.0))
    ends = assoc.join(modules, "disease_index").join(deg, "gene_index").select(F.col("gene_index").alias("m"), "disease_index", "module_size", weight.alias("w"))
    found = products(simple, ends.select("m", "disease_index", "w", "module_size"), ["n", "rows", "s0", "own", "attribute"], assoc.withColumn("inside", F.lit(1)), attribute=True)
    union = F.col("rows") + F.col("attribute").cast("long") - F.col("own").isNotNull().cast("long") - F.col("n")
    return found.select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), F.col("n").alias("common"), F.col("s0").alias("adamic_adar"), F.when(union > 0, F.col("n") / union).otherwise(0.0).alias("jaccard"))


def shared_terms(annotation: DataFrame, assoc: DataFrame, gate: int = GATE) -> DataFrame:
    """Distinct terms a gene shares with other genes of a module, and their share of its own (F8)."""
    annotation, assoc = written(annotation.select("gene_index", "term_index")), written(assoc)
    modules = module_size(assoc, gate).select("disease_index")
    genes = annotation.join(assoc, "gene_index").join(modules, "disease_index").groupBy("term_index", "disease_index").agg((F.count("*") == 1).cast("long").alias("single"))
    found = products(annotation, genes, ["n", "rows", "s0", "own"], assoc.withColumn("inside", F.lit(1)))
    # A term counts for g if some other gene of the module has it. One that a single gene of g's own module has is g's alone.
    shared = F.col("n") - F.when(F.col("own").isNotNull(), F.col("s0").cast("long")).otherwise(0)
    return found.select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), shared.alias("shared"), (shared / F.col("rows")).alias("fraction")).where("shared > 0")


def disease_context(assoc: DataFrame, disease_edges: DataFrame) -> DataFrame:
    """For each pair, the neighbour diseases (a, b) that the gene is linked to."""
    return disease_edges.join(assoc.withColumnRenamed("disease_index", "b"), "b").groupBy("gene_index", F.col("a").alias("disease_index")).agg(F.countDistinct("b").alias("n_context"))


def disease_context_of_groups(assoc: DataFrame, members: DataFrame, group: str = "group") -> DataFrame:
    """The same where all diseases of a group are neighbours, without their pairs (F9). members: (disease_index, group), one row a disease.

    A gene's links into a group are counted once; a disease has those of its group less its own.
    """
    assoc = assoc.select("gene_index", "disease_index").distinct()
    fullest = members.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, ceil(fullest / MEMBERS))
    at = F.pmod(F.xxhash64("disease_index"), F.lit(slices)).alias("slice")
    # Each count goes to every slice of its group with those of the slice that are the gene's own, so nothing is looked up by pair.
    part = assoc.join(members, "disease_index").groupBy("gene_index", group, at).agg(F.collect_list("disease_index").alias("mine"))
    of_gene = part.groupBy("gene_index", group).agg(F.sum(F.size("mine")).alias("n"), F.map_from_entries(F.collect_list(F.struct("slice", "mine"))).alias("mine"))
    counts = of_gene.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).select("gene_index", group, "slice", "n", F.coalesce(F.try_element_at("mine", F.col("slice")), F.array().cast("array<long>")).alias("own"))
    every = counts.join(members.withColumn("slice", at), [group, "slice"])
    return every.select("gene_index", "disease_index", (F.col("n") - F.array_contains("own", F.col("disease_index")).cast("long")).alias("n_context")).where("n_context > 0")


def keyword_flag(annotation: DataFrame, terms: DataFrame, words: list[str]) -> DataFrame:
    """(gene_index, flag = 1) of genes with a term whose name holds a word, case-sensitive."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("name").contains(w)
    return annotation.join(terms.where(hit), "term_index").select("gene_index").distinct().withColumn("flag", F.lit(1).cast("long"))


def common_neighbour_z(ppi: DataFrame, assoc: DataFrame) -> DataFrame:
    """Hypergeometric z of the common neighbours, within the interaction graph and ungated."""
    simple = written(ppi.select("x_index", "y_index").distinct())
    deg = degrees(simple, "x_index", "deg")
    inside = assoc.join(deg.select("gene_index"), "gene_index", "left_semi")
    size = inside.groupBy("disease_index").agg(F.count("*").alias("k"))
    n = F.broadcast(deg.agg(F.count("*").alias("n")).withColumnRenamed("n", "n_nodes"))
    found = products(simple, inside.join(size, "disease_index").select("gene_index", "disease_index", "k"), ["n", "rows", "attribute"], attribute=True)
    return found.crossJoin(n).select(F.col("g").alias("gene_index"), F.col("d").alias("disease_index"), F.col("n").alias("x"), hypergeometric_z(F.col("n"), F.col("n_nodes"), F.col("rows"), F.col("attribute").cast("long")).alias("z"))


def proximity(ppi: DataFrame, assoc: DataFrame, gate: int = GATE, min_seeds: int = 5, hops: int = 3) -> DataFrame:
    """Closest and mean distance, exp(-d) kernel and number of seeds reached within ``hops``, a gene's own seed left out.

    A gene that seeds many diseases is searched once. The graph stays partitioned by node and a row carries the bits of 1,024 seeds.
    """
    simple = written(ppi.select("x_index", "y_index").distinct())
    inside = assoc.join(simple.select(F.col("x_index").alias("gene_index")).distinct(), "gene_index", "left_semi")
    fit = inside.groupBy("disease_index").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("disease_index").join(module_size(assoc, gate).select("disease_index"), "disease_index")
    seeds = written(inside.join(fit, "disease_index").select("disease_index", F.col("gene_index").alias("seed")).distinct())
    return walks.proximities(simple, seeds, hops)


def random_walk(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, tolerance: float = 1e-9, max_rounds: int = 300, floor: float | None = None) -> DataFrame:
    """(walk_id, node, score) above ``floor``, 1/n if none is given: random walk with restart at each walk's seeds.

    Edges count in both directions and once; seeds: (walk_id, node). Scores are settled: the walk goes on until what is left to change adds
    up to less than n times the tolerance, so where it started makes no difference. A walk's seeds without edges don't count; a walk
    without any other has no rows, nor have nodes that no seed leads to.
    """
    simple = written(_both_ways(edges))
    inside = seeds.join(simple.select(F.col("x_index").alias("node")).distinct(), "node", "left_semi").distinct()
    return walks.restarts(simple, inside, alpha, tolerance, max_rounds, floor)[0]


def _both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select("x_index", "y_index")
    return one.unionAll(one.select(F.col("y_index").alias("x_index"), F.col("x_index").alias("y_index"))).distinct()


def held_out_walk(edges: DataFrame, assoc: DataFrame, folds: int = 5, gate: int = GATE, alpha: float = 0.85, tolerance: float = 1e-9, max_rounds: int = 300) -> DataFrame:
    """(gene_index, disease_index, score): a seed is scored by the walk that leaves its fold out, others by the walk of all seeds if above 1/n.

    Every seed with edges has a row, even one that no other seed leads to, if its walk has other seeds. Folds come from a hash of the
    pair, not from a shuffled order.
    """
    assoc, simple = written(assoc), written(_both_ways(edges))
    inside = assoc.join(module_size(assoc, gate).select("disease_index"), "disease_index").join(simple.select(F.col("x_index").alias("gene_index")).distinct(), "gene_index", "left_semi")
    seeds = written(inside.select("gene_index", "disease_index", F.pmod(F.xxhash64("gene_index", "disease_index"), F.lit(folds)).alias("fold")))
    walk_id = lambda d, f: d * (folds + 1) + f
    full = seeds.select(walk_id(F.col("disease_index"), F.lit(folds)).alias("walk_id"), F.col("gene_index").alias("node"))
    left = seeds.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("f <> fold").select(walk_id(F.col("disease_index"), F.col("f")).alias("walk_id"), F.col("gene_index").alias("node"))
    restarts = full.unionAll(left)
    score, n = walks.restarts(simple, restarts, alpha, tolerance, max_rounds)
    own = seeds.select("gene_index", "disease_index", walk_id(F.col("disease_index"), F.col("fold")).alias("walk_id"), F.col("gene_index").alias("node"))
    own = own.join(left.select("walk_id").distinct(), "walk_id", "left_semi").join(score, ["walk_id", "node"], "left")
    own = own.select("gene_index", "disease_index", F.coalesce("score", F.lit(0.0)).alias("score"))
    others = score.where((F.col("walk_id") % (folds + 1) == folds) & (F.col("score") > 1 / max(n, 1)))
    others = others.select(F.col("node").alias("gene_index"), F.expr(f"walk_id div {folds + 1}").alias("disease_index"), "score").join(seeds, ["gene_index", "disease_index"], "left_anti")
    return own.unionAll(others)


def evidence_depth(metadata: DataFrame) -> DataFrame:
    """Per gene: mean number of sources of its links and the share with several (F14, A6). ``sources``: a "+"-joined set."""
    n = F.size(F.split("sources", "\\+"))
    ends = metadata.where("sources is not null").select("x_index", "y_index", n.alias("n"))
    each = ends.select(F.col("x_index").alias("gene_index"), "n").unionAll(ends.select("y_index", "n"))
    return each.groupBy("gene_index").agg(F.avg("n").alias("depth"), F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("multi_fraction"))


def localisation(annotation: DataFrame, edges: DataFrame, membrane: list[int], secreted: list[int]) -> DataFrame:
    """Per gene: whether a term at or below the anchors is annotated, and the class that follows."""
    from .ontology import closure

    down = closure(edges)
    spark = annotation.sparkSession

    def members(anchors, out):
        own = spark.createDataFrame([(a,) for a in anchors], "term_index long")
        below = down.join(F.broadcast(own.withColumnRenamed("term_index", "ancestor")), "ancestor").select(F.col("descendant").alias("term_index"))
        return annotation.join(own.unionAll(below).distinct(), "term_index").select("gene_index").distinct().withColumn(out, F.lit(1).cast("long"))

    out = annotation.select("gene_index").distinct()
    for anchors, name in ((membrane, "is_membrane"), (secreted, "is_secreted")):
        out = out.join(members(anchors, name), "gene_index", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    kind = F.when((F.col("is_membrane") == 1) & (F.col("is_secreted") == 1), "both").when(F.col("is_membrane") == 1, "membrane").when(F.col("is_secreted") == 1, "secreted").otherwise("intracellular_or_unannotated")
    return out.withColumn("localisation", kind)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, score), summing to 1; edges hold both directions, so no mass is lost (F16)."""
    graph = walks.Blocks(edges.select("x_index", "y_index").distinct())
    n = max(graph.nodes, 1)
    state = graph.start(1 / n)
    for i in range(rounds):
        new = graph.step(state, True, (1 - damping) / n, damping)
        if i:
            release(state)
        state = new
    return graph.values(state).select("node", "score")


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, score): power iteration, the largest value 1; edges hold both directions (F16)."""
    graph = walks.Blocks(edges.select("x_index", "y_index").distinct())
    state = graph.start(1.0)
    for i in range(rounds):
        new = graph.step(state, False, 0.0, 1.0, scaled=True)
        if i:
            release(state)
        state = new
    return graph.values(state).select("node", (F.col("score") / F.col("most")).alias("score"))


def _counted(nodes: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    nodes, code = np.unique(nodes, return_inverse=True)
    return {"g": nodes, "d": nodes, "n": np.bincount(code, n, len(nodes)).astype(np.int64)}


def _closed(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What pairs that are edges count, for both ends."""
    edge = ~np.isnan(found["own"])
    return _counted(np.concatenate((found["g"][edge], found["d"][edge])), np.tile(found["n"][edge], 2))


def _closed_far(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The same for d alone."""
    edge = ~np.isnan(found["own"])
    return _counted(found["d"][edge], found["n"][edge])


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering) (F16). Edges are oriented from the lower to the higher degree, so hubs open few wedges."""
    und = edges.where("x_index <> y_index").select(F.least("x_index", "y_index").alias("a"), F.greatest("x_index", "y_index").alias("b")).distinct()
    deg = und.select(F.col("a").alias("node")).unionAll(und.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    da, db = deg.select(F.col("node").alias("a"), F.col("degree").alias("ka")), deg.select(F.col("node").alias("b"), F.col("degree").alias("kb"))
    low = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    out = written(und.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("t")))
    back, edge = out.select("t", "s"), out.withColumn("met", F.lit(1))
    # s and the far end count the middle nodes between them; the middle one counts the far ends that s and it share.
    ends = products(out, out, ["n"], edge, each=_closed)
    middle = products(out, written(back), ["n"], edge, each=_closed_far)
    corner = ends.unionAll(middle).groupBy(F.col("g").alias("node")).agg(F.sum("n").alias("triangles"))
    k, t = F.col("degree"), F.coalesce("triangles", F.lit(0)).cast("long")
    return deg.join(corner, "node", "left").select("node", "degree", t.alias("triangles"), F.when(k > 1, 2.0 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def merge_interactomes(parts: dict[str, DataFrame]) -> DataFrame:
    """(a, b, sources): unordered pairs of several sources, each named in a "+"-joined set."""
    from .sets import tag_and_concat

    every = tag_and_concat(parts, "source").where("x_index <> y_index").select(F.least("x_index", "y_index").alias("a"), F.greatest("x_index", "y_index").alias("b"), "source")
    return every.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def explain_paths(first: DataFrame, second: DataFrame, gene: int, disease: int, limit: int = 40) -> DataFrame:
    """Paths gene - middle - disease in a fixed order, the feature being the first ``limit`` (F18). first: (gene_index, middle), second: (middle, disease_index)."""
    left, right = first.where(F.col("gene_index") == gene), second.where(F.col("disease_index") == disease)
    return left.join(right, "middle").where(F.col("middle") != gene).select("gene_index", "middle", "disease_index").distinct().orderBy("middle").limit(limit)


def resolve_names(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node_name, node_index); raises unless every name has exactly one node."""
    found = nodes.where(F.col("node_name").isin(names)).select("node_name", "node_index")
    hits = {r[0]: r[1] for r in found.groupBy("node_name").count().collect()}
    wrong = {n: hits.get(n, 0) for n in names if hits.get(n, 0) != 1}
    if wrong:
        raise ValueError(f"names without exactly one node: {wrong}")
    return found


def admitted(pairs: DataFrame, routes: tuple[str, ...] = ("dwpc_ggd", "dwpc_gpgd", "dwpc_gcd")) -> DataFrame:
    """Pairs with some route."""
    return pairs.where(F.coalesce(*routes).isNotNull())
