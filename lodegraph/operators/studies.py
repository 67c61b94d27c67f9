"""Whole studies over rankings: staged filters (E6), the panel report (E21), the calibration page (E30), the hierarchy
annotation (G5) and the explanation routes (F18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import auc_from_ascending, hanley_mcneil_se, poisson_upper, ratio
from .evaluate import hits, spearman
from .joins import PAIR, flag_members
from .intervals import reach_counts
from .ranking import average_rank, rank_first


def staged_filters(scored: DataFrame, filters: list[tuple[str, Column]], truth: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    """Per filter and disease: pool, known targets kept and in all, hits, median percentile, AUC and retention.

    The filters are independent: a row counts for each one it passes. Diseases without a known target in their whole pool
    are left out; a filter that keeps none of a disease's targets has null percentile and AUC.
    """
    flagged = flag_members(scored, truth, PAIR, "is_known")
    total = flagged.groupBy("disease_index").agg(F.sum("is_known").cast("long").alias("n_known_total")).where("n_known_total > 0")
    passed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filters]))
    rows = flagged.join(total, "disease_index").withColumn("filter", F.explode(passed))
    group = ["filter", "disease_index"]
    ranked = rank_first(rows, group, score, "gene_index").withColumn("__a", average_rank(group, score))
    known = F.col("is_known") == 1
    per = ranked.groupBy(*group).agg(
        F.count("*").alias("pool"), F.sum("is_known").cast("long").alias("n_known_kept"), F.first("n_known_total").alias("n_known_total"),
        hits("rank", k, F.col("is_known")).alias(f"hits_at_{k}"), F.percentile(F.when(known, F.col("rank")), F.lit(0.5)).alias("__m"),
        F.sum(F.when(known, F.col("__a"))).alias("__s"),
    )
    per = per.withColumn("median_pct", F.col("__m") / F.col("pool"))
    per = per.withColumn("auc", auc_from_ascending(F.col("__s"), F.col("n_known_kept"), F.col("pool") - F.col("n_known_kept")))
    return per.withColumn("retention", F.col("n_known_kept") / F.col("n_known_total")).drop("__m", "__s")


def filter_summary(per_disease: DataFrame) -> DataFrame:
    """Per filter: diseases, retention of all known targets, hits, mean AUC and mean median percentile."""
    return per_disease.groupBy("filter").agg(
        F.count("*").alias("n_diseases"), F.sum("pool").alias("pool"), F.sum("n_known_kept").alias("kept"), F.sum("n_known_total").alias("known"),
        (F.sum("n_known_kept") / F.sum("n_known_total")).alias("retention"), F.sum("hits_at_50").alias("hits"),
        F.avg("auc").alias("macro_auc"), F.avg("median_pct").alias("mean_median_pct"),
    )


def _panel_rows(scored: DataFrame, panel: DataFrame, score: str) -> DataFrame:
    """The panel's rows with their rank among all and, where unlabelled, among the novel ones."""
    ranked = rank_first(scored.join(panel.select("disease_index").distinct(), "disease_index", "left_semi"), "disease_index", score, "gene_index")
    novel = Window.partitionBy("disease_index", "is_target").orderBy(F.desc_nulls_last(score), "gene_index")
    return ranked.withColumn("novel_rank", F.when(F.col("is_target") == 0, F.row_number().over(novel)).cast("long"))


def panel_report(scored: DataFrame, panel: DataFrame, tractable: DataFrame, truths: dict[str, DataFrame], names: DataFrame, score: str = "proba", k: int = 50, trust: int = 30) -> DataFrame:
    """Per term of a panel (E21): AUC with its interval, hits with the Poisson verdict, the novel head's tractable genes, linked
    novel genes by truth with expectation and lift, and the names of the first ten novel genes."""
    rows = _panel_rows(scored, panel, score).withColumn("__a", average_rank("disease_index", score))
    rows = flag_members(rows, tractable, ["gene_index"], "__t").join(names.select("gene_index", "gene_name"), "gene_index", "left")
    for name, pairs in truths.items():
        rows = flag_members(rows, pairs, PAIR, f"__{name}")
    novel, head = F.col("is_target") == 0, F.col("novel_rank") <= k
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("long")
    first = F.sort_array(F.collect_list(F.when(F.col("novel_rank") <= 10, F.struct("novel_rank", F.coalesce("gene_name", F.col("gene_index").cast("string")).alias("name")))))
    per = rows.groupBy("disease_index").agg(
        F.count("*").alias("pool"), F.sum("is_target").cast("long").alias("n_known"), hits("rank", k, F.col("is_target")).alias("hits"),
        F.sum(F.when(~novel, F.col("__a"))).alias("__s"), F.count_if(novel).alias("n_novel"), total("__t", head).alias("novel_tractable"),
        F.count_if(head).alias("__head"), F.array_join(F.transform(first, lambda x: x["name"]), ", ").alias("top_novel"),
        *[total(f"__{n}", novel).alias(f"{n}_total") for n in truths], *[total(f"__{n}", head).alias(f"{n}_hits") for n in truths],
    )
    n, known = F.col("pool"), F.col("n_known")
    per = per.withColumn("auc", auc_from_ascending(F.col("__s"), known, n - known)).withColumn("auc_se", hanley_mcneil_se(F.col("auc"), known, n - known))
    per = per.withColumns({"auc_lo95": F.col("auc") - 1.96 * F.col("auc_se"), "auc_hi95": F.col("auc") + 1.96 * F.col("auc_se"), "base_rate_pct": 100.0 * known / n, "expected": F.lit(float(k)) * known / n})
    per = per.withColumns({"poisson_p": poisson_upper(F.col("hits"), F.col("expected")), "enrichment": ratio(F.col("hits"), F.col("expected"))})
    verdict = F.when(F.col("poisson_p") > 0.05, "not significant").when(F.col("hits") < 3, "significant but fragile").otherwise("significant")
    out = {"verdict": verdict, "trustworthy": (known >= trust).cast("long"), "novel_tractable_pct": 100.0 * F.col("novel_tractable") / F.greatest("__head", F.lit(1))}
    for name in truths:
        share = F.col(f"{name}_total") / F.when(F.col("n_novel") > 0, F.col("n_novel"))
        out |= {f"{name}_expected": k * share, f"{name}_lift": ratio(F.col(f"{name}_hits") / F.lit(float(k)), share)}
    return per.withColumns(out).drop("__s", "__head")


#: Terms of a panel, at most.
PANEL_TERMS = 10_000


def panel_pairs(scored: DataFrame, panel: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    """Per pair of panel terms: genes that their first k share, novel ones and all, and whether the lists are distinct.

    Shared genes are found through the genes of the lists, at most 2 k rows a term; pairs that share none come from the panel, a chosen
    list of at most PANEL_TERMS terms.
    """
    rows = _panel_rows(scored, panel, score)
    lists = [rows.where(F.col(c) <= k).select("disease_index", "gene_index", F.lit(c == "novel_rank").alias("novel")) for c in ("novel_rank", "rank")]
    top = lists[0].unionAll(lists[1])
    left, right = top.withColumnRenamed("disease_index", "a"), top.withColumnRenamed("disease_index", "b")
    shared = left.join(right, ["gene_index", "novel"]).where("a < b").groupBy("a", "b").agg(F.count_if("novel").alias("__n"), F.count_if(~F.col("novel")).alias("__a"))
    terms = rows.select(F.col("disease_index").alias("a")).distinct()
    if terms.count() > PANEL_TERMS:
        raise ValueError(f"a panel has at most {PANEL_TERMS} terms")
    every = terms.join(F.broadcast(terms.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))
    out = every.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("__n", F.lit(0)).alias("novel_overlap"), F.coalesce("__a", F.lit(0)).alias("all_overlap"))
    share = lambda c: 100.0 * F.col(c) / k
    return out.withColumns({"novel_overlap_pct": share("novel_overlap"), "all_overlap_pct": share("all_overlap"), "distinct": (F.col("novel_overlap") <= k * 0.25).cast("long")})


def umbrella_overlap(pairs: DataFrame, umbrella: list[int], k: int = 50) -> DataFrame:
    """Per term that isn't an umbrella: the largest novel overlap with an umbrella term, and how specific its list is."""
    both = pairs.select(F.col("a").alias("disease_index"), F.col("b").alias("other"), "novel_overlap").unionAll(pairs.select("b", "a", "novel_overlap"))
    best = both.where(~F.col("disease_index").isin(umbrella)).groupBy("disease_index").agg(F.coalesce(F.max(F.when(F.col("other").isin(umbrella), F.col("novel_overlap"))), F.lit(0)).alias("best"))
    tag = F.when(F.col("best") >= k * 0.5, "generic").when(F.col("best") >= k * 0.25, "partly specific").otherwise("subtype-specific")
    return best.withColumn("tag", tag)


def _facts(one: DataFrame, section: str) -> DataFrame:
    """(section, name, value): the columns of a one-row table."""
    row = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in one.columns])
    return one.select(F.explode(row).alias("x")).select("x.*")


def calibration_page(per_disease: DataFrame, per_drug: DataFrame, tagged: DataFrame, modules: DataFrame, per_family: DataFrame, routes: DataFrame, degrees: DataFrame, gate: int = 20) -> DataFrame:
    """(section, name, value): everything the calibration page shows.

    per_disease: disease_index, auc, enrichment; per_drug: disease_index, auc; tagged: split, disease_index, split_key,
    is_target; modules: disease_index, module_size; per_family: auc; routes: one column a route, null if it doesn't admit the
    pair; degrees: degree, score. Scores are summarised by group, never pooled; enrichment by its quartiles.
    """
    v = F.col("auc")
    auc = per_disease.where(v.isNotNull()).agg(F.count("*").alias("n_diseases"), F.avg(v).alias("macro"), F.percentile(v, F.lit(0.5)).alias("median"), F.count_if(v < 0.5).alias("below_chance"))
    e = F.col("enrichment")
    quartile = lambda p: F.percentile(e, F.lit(p))
    enrichment = per_disease.where(v.isNotNull() & e.isNotNull()).agg(quartile(0.5).alias("median"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max(e).alias("max"), F.count("*").alias("n"))
    both = per_disease.select("disease_index", F.col("auc").alias("x")).join(per_drug.select("disease_index", F.col("auc").alias("y")), "disease_index").where("x IS NOT NULL AND y IS NOT NULL")
    fit = both.agg(F.count("*").alias("n"), F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("pearson_r"), F.avg("y").alias("drug_macro_auc")).withColumn("r2", F.col("pearson_r") * F.col("pearson_r"))
    size = F.col("module_size") >= gate
    eligibility = modules.agg(F.count("*").alias("total"), F.count_if(size).alias("eligible")).withColumn("excluded", F.col("total") - F.col("eligible"))
    eligibility = eligibility.withColumn("pct_excluded", F.round(100.0 * F.col("excluded") / F.greatest("total", F.lit(1)), 1))
    families = per_family.where(v.isNotNull()).agg(F.count("*").alias("n"), F.avg(v).alias("macro_auc"))
    # Splits and their leakage: keys and diseases that stand in a split and in another one too; all must be zero.
    spread = lambda key: tagged.groupBy(key).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"straddling_{key}"))
    leakage = spread("split_key").crossJoin(spread("disease_index"))
    y = F.col("is_target")
    per_split = tagged.groupBy("split").agg(F.count("*").alias("rows"), F.sum(y).alias("positives"), (100.0 * F.avg(y)).alias("pos_rate_pct"), F.countDistinct("disease_index").alias("n_diseases"), F.countDistinct("split_key").alias("n_split_keys"))
    measures = ["rows", "positives", "pos_rate_pct", "n_diseases", "n_split_keys"]
    splits = per_split.select(*[F.col(m).cast("double").alias(m) for m in measures], "split").unpivot("split", measures, "measure", "value")
    splits = splits.select(F.lit("splits").alias("section"), F.concat_ws(" ", "split", "measure").alias("name"), F.round("value", 4).alias("value"))
    counts = routes.agg(*[F.count(c).alias(c) for c in routes.columns])
    admitted = sum((F.col(c) for c in routes.columns), F.lit(0))
    rate = F.avg(F.when(F.col("split") == "validation", y))
    pool = tagged.agg(F.count("*").alias("union_rows"), (100.0 * F.avg(y)).alias("pos_rate_pct"), rate.alias("base_rate"))
    pool = pool.crossJoin(counts.select(admitted.alias("route_admissions"))).withColumn("duplicates_removed", F.col("route_admissions") - F.col("union_rows"))
    pool = pool.crossJoin(modules.agg(F.count_if(size).alias("__e"))).withColumn("pairs_per_disease", F.round(F.col("union_rows") / F.when(F.col("__e") > 0, F.col("__e")))).drop("__e")
    from .aggregates import histogram

    bins = histogram(per_disease.where(v.isNotNull()), "auc", 0.0, 1.0, 20).select(F.lit("histogram").alias("section"), F.col("bin").cast("string").alias("name"), F.col("n").cast("double").alias("value"))
    parts = [("auc", auc), ("enrichment", enrichment), ("orthogonality", fit), ("eligibility", eligibility), ("families", families), ("leakage", leakage), ("routes", counts), ("pool", pool), ("hub", spearman(degrees, "degree", "score"))]
    out = splits.unionAll(bins)
    for section, one in parts:
        out = out.unionAll(_facts(one, section))
    return out


def annotated_hierarchy(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, modules: DataFrame, family: DataFrame, gate: int = 20) -> DataFrame:
    """The 27 columns of a disease hierarchy's annotation.

    nodes: node, node_id, name, node_source; edges: parent, child; anchors: anchor, doid, label; modules: node, module_size;
    family: node, anchor, depth. Counts of ancestors and descendants come from interval labels. Names are joined by " | " in
    order and cut to 400 (parents) and 300 (anchor children) characters, as the page shows them.
    """
    eligible = modules.where(F.col("module_size") >= gate).select("node", F.lit(1).alias("eligible"))
    direct = edges.select("parent", "child").distinct()
    every = nodes.select("node").unionAll(direct.select("parent")).unionAll(direct.select("child")).distinct()
    reach = reach_counts(every, direct, {"eligible": eligible, "anchor": anchors.select(F.col("anchor").alias("node"))})
    of = lambda df, key, *by: df.select(F.col("node" if "node" in df.columns else "anchor").alias(key), *by)
    is_anchor = anchors.select("anchor", F.lit(1).alias("anchored"), "label")
    names = nodes.select("node", "name")

    def below(pairs, prefix):
        joined = pairs.join(of(eligible, "child", "eligible"), "child", "left").join(of(is_anchor, "child", "anchored", "label"), "child", "left")
        return joined.groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias(f"n_{prefix}"), F.count("eligible").alias(f"n_eligible_{prefix}"), F.count("anchored").alias(f"n_anchor_{prefix}"),
            F.substring(F.array_join(F.array_sort(F.collect_list("label")), " | "), 1, 300).alias(f"anchor_{prefix}_names"),
        )

    up = direct.join(of(names, "parent", "name"), "parent", "left").groupBy(F.col("child").alias("node")).agg(
        F.count("*").alias("n_parents"), F.substring(F.array_join(F.array_sort(F.collect_list("name")), " | "), 1, 400).alias("parent_names")
    )
    tops = names.select(F.col("node").alias("family_id"), F.col("name").alias("family_name")).join(anchors.select(F.col("anchor").alias("family_id"), F.col("label").alias("anchor_name")), "family_id", "left")
    out = nodes.join(modules, "node", "left").join(eligible, "node", "left").join(anchors.withColumnRenamed("anchor", "node"), "node", "left")
    out = out.join(family.select("node", F.col("anchor").alias("family_id"), F.col("depth").alias("hop_depth")), "node", "left").join(tops, "family_id", "left")
    for part in (below(direct, "children"), reach, up):
        out = out.join(part, "node", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    flag = lambda c: c.cast("long")
    return out.select(
        "node", "node_id", "name", "node_source", "module_size", n("eligible").alias("is_eligible"), flag(F.col("doid").isNotNull()).alias("is_anchor"),
        F.col("doid").alias("anchor_doid"), F.col("label").alias("anchor_label"), "family_id", "family_name", "anchor_name", "hop_depth",
        n("n_parents").alias("n_parents"), n("n_children").alias("n_children"), n("n_eligible_children").alias("n_eligible_children"),
        n("n_anchor_children").alias("n_anchor_children"), flag(n("n_eligible_children") >= 1).alias("is_parent_term"),
        F.coalesce("parent_names", F.lit("")).alias("parent_names"), F.coalesce("anchor_children_names", F.lit("")).alias("anchor_children_names"),
        n("n_anchor_ancestors").alias("n_anchor_ancestors"), n("n_anchor_descendants").alias("n_anchor_descendants"),
        flag(n("n_anchor_descendants") > 0).alias("is_ancestor_of_anchor"), flag(n("n_anchor_ancestors") > 0).alias("is_descendant_of_anchor"),
        flag((n("n_anchor_descendants") == 0) & (n("n_anchor_ancestors") == 0)).alias("antichain_ok_as_anchor"),
        n("n_descendants").alias("n_descendants"), n("n_eligible_descendants").alias("n_eligible_descendants"),
    )


#: The routes through a shared term: their caps, and the greatest degree of a term.
TERM_ROUTES = {"pathway": (100, None), "molecular_function": (60, 200), "biological_process": (100, 200)}
PPI_CAP, DRUG_CAP = 100, 40


def _first(rows: DataFrame, route: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows in order, with their place; a route's answer is capped, so one task numbers few rows."""
    top = rows.distinct().orderBy(*order).limit(cap)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    given = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    return top.select(F.lit(route).alias("route"), place.alias("place"), given("term_index", "long"), given("middle", "long"), given("relation", "string"))


def explanation_routes(gene: int, disease: int, assoc: DataFrame, ppi: DataFrame, terms: dict[str, DataFrame], drug_protein: DataFrame, drug_disease: DataFrame, degrees: dict[str, int | None] | None = None) -> DataFrame:
    """(route, place, term_index, middle, relation): the five ways that explain a pair, each in its order and up to its cap.

    A protein partner of the disease; a shared pathway, molecular function or biological process with such a partner, terms of
    too great a degree left out; a drug that acts on the gene and is indicated or investigated for the disease.
    """
    partners = assoc.where(F.col("disease_index") == disease).select(F.col("gene_index").alias("middle")).where(F.col("middle") != gene)
    out = _first(ppi.where(F.col("x_index") == gene).select(F.col("y_index").alias("middle")).join(partners, "middle"), "ppi", ["middle"], PPI_CAP)
    for route, (cap, greatest) in TERM_ROUTES.items():
        greatest = (degrees or {}).get(route, greatest)
        edges = terms[route].select("gene_index", "term_index").distinct()
        own = edges.where(F.col("gene_index") == gene).select("term_index")
        near = edges.join(own, "term_index")
        if greatest is not None:
            small = near.groupBy("term_index").agg(F.count("*").alias("n")).where(F.col("n") <= greatest).select("term_index")
            near = near.join(small, "term_index")
        out = out.unionAll(_first(near.withColumnRenamed("gene_index", "middle").join(partners, "middle").select("term_index", "middle"), route, ["term_index", "middle"], cap))
    used = drug_disease.where((F.col("disease_index") == disease) & F.lower("relation").isin("indication", "drug_investigated_for"))
    drugs = drug_protein.where(F.col("gene_index") == gene).select("drug").distinct().join(used, "drug").select(F.col("drug").alias("term_index"), "relation")
    return out.unionAll(_first(drugs, "drug", ["term_index", "relation"], DRUG_CAP))
