"""Evaluation of rankings (E1-E34). ``scored``: disease_index, gene_index, is_target (0/1), and a score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import auc_from_ascending, auc_from_descending, hanley_mcneil_se, poisson_upper, ratio
from .joins import PAIR, flag_members
from .ranking import average_rank, either_top, percentile_bins, rank_bins, rank_first, rank_pct, running_total, value_counts_upto


def hits(rank: str, k: int, label: Column) -> Column:
    return F.sum(F.when(F.col(rank) <= k, label).otherwise(0)).cast("long")


def auc_by_group(scored: DataFrame, group: str = "disease_index", score: str = "proba", label: str = "is_target") -> DataFrame:
    """(group, n_pos, n_neg, auc), the rank-sum AUC on ascending average ranks (E1); null with one class only."""
    ranked = scored.withColumn("__r", average_rank(group, score))
    y = F.col(label)
    sums = ranked.groupBy(group).agg(F.sum(y).cast("long").alias("n_pos"), F.sum(1 - y).cast("long").alias("n_neg"), F.sum(F.when(y == 1, F.col("__r"))).alias("rs"))
    return sums.select(group, "n_pos", "n_neg", auc_from_ascending(F.col("rs"), F.col("n_pos"), F.col("n_neg")).alias("auc"))


def auc_with_interval(scored: DataFrame, group: str = "disease_index", score: str = "proba", trust: int = 30) -> DataFrame:
    """AUC from descending competition ranks with its Hanley-McNeil interval, hits, recall and enrichment."""
    r = F.rank().over(Window.partitionBy(group).orderBy(F.desc(score)))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "gene_index"))
    ranked = scored.withColumn("__r", r).withColumn("__f", first)
    y = F.col("is_target")
    agg = ranked.groupBy(group).agg(
        F.sum(F.when(y == 1, F.col("__r"))).cast("long").alias("target_rank_sum"), F.sum(y).cast("long").alias("n_pos"), F.sum(1 - y).cast("long").alias("n_neg"),
        *[hits("__f", k, y).alias(f"hits_at_{k}") for k in (10, 20, 50)],
    )
    out = agg.withColumn("auc", auc_from_descending(F.col("target_rank_sum"), F.col("n_pos"), F.col("n_neg")))
    out = out.withColumn("auc_se", hanley_mcneil_se(F.col("auc"), F.col("n_pos"), F.col("n_neg")))
    out = out.withColumn("auc_lo95", F.col("auc") - 1.96 * F.col("auc_se")).withColumn("auc_hi95", F.col("auc") + 1.96 * F.col("auc_se"))
    trusted = F.coalesce((F.col("auc_hi95") <= 1) & (F.col("n_pos") >= trust), F.lit(False)).cast("long")
    return out.withColumn("trustworthy", trusted).withColumn("recall_at_20", ratio(F.col("hits_at_20"), F.col("n_pos"))).withColumn("recall_at_50", ratio(F.col("hits_at_50"), F.col("n_pos"))).withColumn("enrichment_at_50", ratio(F.col("hits_at_50") / 50.0, F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))))


def pooled_auc(scored: DataFrame, score: str = "proba", label: str = "is_target") -> DataFrame:
    """One AUC over all rows (E4). Ranks come from counts per distinct score, so no task ranks the table."""
    y = F.col(label)
    counts = scored.groupBy(F.col(score).alias("value")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    upto = running_total(counts.where("value IS NOT NULL"), "value", "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    sums = upto.agg(F.sum("pos").cast("long").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).cast("long").alias("n_neg"), F.sum(F.col("rank") * F.col("pos")).alias("rs"))
    return sums.select("n_pos", "n_neg", auc_from_ascending(F.col("rs"), F.col("n_pos"), F.col("n_neg")).alias("auc"))


def macro_summary(per_group: DataFrame, value: str = "auc") -> DataFrame:
    """Mean, median, extremes and number of groups below chance."""
    v = F.col(value)
    return per_group.where(v.isNotNull()).agg(F.count("*").alias("n_groups"), F.avg(v).alias("macro"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("worst"), F.max(v).alias("best"), F.sum(F.when(v < 0.5, 1).otherwise(0)).cast("long").alias("below_chance"))


def target_benchmark(scored: DataFrame, truth: DataFrame, score: str = "proba", ks: tuple[int, ...] = (50,)) -> DataFrame:
    """Per disease with a known target: median percentile, best rank, hits, and the AUCs of both labels (E5)."""
    known = scored.join(truth.select("disease_index").distinct(), "disease_index", "left_semi")
    flagged = flag_members(known, truth, PAIR, "is_known")
    ranked = rank_first(flagged, "disease_index", score, "gene_index").withColumn("pool", F.count("*").over(Window.partitionBy("disease_index")))
    ranked = ranked.withColumn("__a", average_rank("disease_index", score))
    k = F.col("is_known")
    pct = 100.0 * F.col("rank") / F.col("pool")
    out = ranked.groupBy("disease_index").agg(
        F.max("pool").alias("pool"), F.sum(k).cast("long").alias("n_known"), F.percentile(F.when(k == 1, pct), F.lit(0.5)).alias("median_pct"), F.min(F.when(k == 1, F.col("rank"))).alias("best_rank"),
        *[hits("rank", x, k).alias(f"hits_at_{x}") for x in ks],
        F.sum(F.when((F.col("rank") * 100 <= F.col("pool")), k).otherwise(0)).cast("long").alias("hits_top_1pct"), F.sum(F.when((F.col("rank") * 10 <= F.col("pool")), k).otherwise(0)).cast("long").alias("hits_top_10pct"),
        F.sum(F.when(k == 1, F.col("__a"))).alias("rk"), F.sum(F.when(F.col("is_target") == 1, F.col("__a"))).alias("ra"), F.sum("is_target").cast("long").alias("n_assoc"),
    )
    n = F.col("pool")
    return out.where("n_known > 0").withColumn("auc_known", auc_from_ascending(F.col("rk"), F.col("n_known"), n - F.col("n_known"))).withColumn("auc_assoc", auc_from_ascending(F.col("ra"), F.col("n_assoc"), n - F.col("n_assoc"))).drop("rk", "ra")


def filter_ladder(scored: DataFrame, stages: list[tuple[str, Column]], truth: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    """Per stage of cumulative filters: rows kept, known targets kept, hits in the top k, retention and lift.

    One pass: each row says how many stages it passes, and is repeated for those.
    """
    flagged = flag_members(scored, truth, PAIR, "is_known")
    passed, through = F.lit(1), F.lit(True)
    for _, condition in stages:
        through = through & F.coalesce(condition, F.lit(False))
        passed = passed + through.cast("int")
    rows = flagged.withColumn("passed", passed).withColumn("stage", F.explode(F.sequence(F.lit(0), F.col("passed") - 1)))
    ranked = rank_first(rows, ["stage", "disease_index"], score, "gene_index")
    sums = ranked.groupBy("stage").agg(F.count("*").alias("n_rows"), F.sum("is_known").cast("long").alias("n_known"), F.sum(F.when(F.col("rank") <= k, F.col("is_known")).otherwise(0)).cast("long").alias("hits"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias("picked"))
    names = F.array(F.lit("all"), *[F.lit(n) for n, _ in stages])
    first = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = lambda c: F.first(c).over(first)
    return sums.select(
        F.col("stage").cast("long").alias("stage"), F.element_at(names, F.col("stage") + 1).alias("name"), "n_rows", "n_known", "hits",
        ratio(F.col("n_known"), base("n_known")).alias("recall"), ratio(F.col("n_rows"), base("n_rows")).alias("kept"),
        ratio(ratio(F.col("hits"), F.col("picked")), ratio(base("n_known"), base("n_rows"))).alias("lift"),
    )


def novel_discovery(scored: DataFrame, truths: dict[str, DataFrame], score: str = "proba", ks: tuple[int, ...] = (10, 50), min_novel: int = 200, min_linked: int = 1) -> DataFrame:
    """Per truth and k, over unlabelled pairs: hits, expected hits and lift, of diseases with enough novel and linked genes."""
    novel = rank_first(scored.where("is_target = 0"), "disease_index", score, "gene_index")
    for name, t in truths.items():
        novel = flag_members(novel, t, PAIR, name)
    long = novel.unpivot(["disease_index", "gene_index", "rank"], list(truths), "truth", "linked")
    per = long.groupBy("truth", "disease_index").agg(F.count("*").alias("n"), F.sum("linked").alias("m"), *[hits("rank", k, F.col("linked")).alias(f"h{k}") for k in ks]).where((F.col("n") >= min_novel) & (F.col("m") >= min_linked))
    return per.select("truth", "n", "m", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x")).groupBy("truth", F.col("x.k").alias("k")).agg(
        F.count("*").alias("n_diseases"), F.sum("x.h").cast("long").alias("hits"), F.sum(F.least(F.col("x.k"), F.col("n")) * F.col("m") / F.col("n")).alias("expected")
    ).withColumn("lift", ratio(F.col("hits"), F.col("expected")))


def compare_models(scored: DataFrame, models: dict[str, str], baseline: str) -> DataFrame:
    """Per model: macro AUC and, on the same diseases, its mean paired difference to the baseline and wins."""
    long = scored.select(*PAIR, "is_target", *[F.col(c).cast("double").alias(n) for n, c in models.items()]).unpivot([*PAIR, "is_target"], list(models), "model", "value")
    ranked = long.withColumn("__r", average_rank(["model", "disease_index"], "value"))
    y = F.col("is_target")
    per = ranked.groupBy("model", "disease_index").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"), F.sum(F.when(y == 1, F.col("__r"))).alias("rs")).select("model", "disease_index", auc_from_ascending(F.col("rs"), F.col("p"), F.col("q")).alias("auc")).where("auc is not null")
    base = per.where(F.col("model") == baseline).select("disease_index", F.col("auc").alias("base"))
    d = F.col("auc") - F.col("base")
    return per.join(base, "disease_index").groupBy("model").agg(F.avg("auc").alias("macro_auc"), F.count("*").alias("n_diseases"), F.avg(d).alias("mean_delta"), F.sum(F.when(d > 0, 1).otherwise(0)).cast("long").alias("n_better"))


def attribute_lift(df: DataFrame, attributes: list[str], labels: list[str], least: int = 2000) -> DataFrame:
    """Per attribute value with ``least`` rows: each label's rate over its rate at large (E10). Nulls are a value."""
    base = df.agg(*[F.avg(x).alias(f"base_{x}") for x in labels])
    long = df.select(*labels, *[F.coalesce(F.col(a).cast("string"), F.lit("(null)")).alias(a) for a in attributes]).unpivot(labels, attributes, "attribute", "value")
    rates = long.groupBy("attribute", "value").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"{x}_rate") for x in labels]).where(F.col("n") >= least)
    return rates.crossJoin(F.broadcast(base)).select("attribute", "value", "n", *[f"{x}_rate" for x in labels], *[ratio(F.col(f"{x}_rate"), F.col(f"base_{x}")).alias(f"{x}_lift") for x in labels])


def hub_bias(positives: DataFrame, degree: str, score: str, threshold: float, k: int = 5) -> DataFrame:
    """Per degree quantile of positives: rows, genes, median degree, mean score, share predicted."""
    bins = percentile_bins(positives, degree, k, "quintile")
    return bins.groupBy("quintile").agg(F.count("*").alias("n_rows"), F.countDistinct("gene_index").alias("n_genes"), F.percentile(degree, F.lit(0.5)).cast("double").alias("median_degree"), F.avg(score).alias("mean_score"), (100.0 * F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0))).alias("pct_predicted"))


def degree_matched(scored: DataFrame, degree: str, score: str = "proba", k: int = 50, bins: int = 10) -> DataFrame:
    """Per disease: hits in the top k against what the same degree bins would give."""
    binned = rank_bins(scored, "disease_index", degree, "gene_index", bins)
    ranked = rank_first(binned, "disease_index", score, "gene_index")
    rate = ranked.groupBy("disease_index", "bin").agg(F.avg("is_target").alias("rate"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("picked"), hits("rank", k, F.col("is_target")).alias("h"))
    return rate.groupBy("disease_index").agg(F.sum("h").cast("long").alias("hits"), F.sum(F.col("picked") * F.col("rate")).alias("expected")).withColumn("lift", ratio(F.col("hits"), F.col("expected")))


def reachability_ceiling(truth: DataFrame, pool: DataFrame, genes: DataFrame, diseases: DataFrame) -> DataFrame:
    """Why known pairs aren't in the pool, counted (E13, J11): gene unknown, disease unknown, or no path."""
    out = truth.join(pool.select(*PAIR).distinct().withColumn("in_pool", F.lit(1)), PAIR, "left").join(genes.select("gene_index").distinct().withColumn("has_gene", F.lit(1)), "gene_index", "left").join(diseases.select("disease_index").distinct().withColumn("has_disease", F.lit(1)), "disease_index", "left")
    cause = F.when(F.col("in_pool") == 1, "reachable").when(F.col("has_gene").isNull(), "gene_absent").when(F.col("has_disease").isNull(), "disease_absent").otherwise("no_path")
    counts = out.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.countDistinct("disease_index").alias("n_diseases"))
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total))


def coverage(truth: DataFrame, pool: DataFrame) -> DataFrame:
    """Per disease: known pairs and how many the pool holds."""
    return truth.join(pool.select(*PAIR).distinct().withColumn("__in", F.lit(1)), PAIR, "left").groupBy("disease_index").agg(F.count("*").alias("n_known"), F.count("__in").alias("n_reachable")).withColumn("coverage", F.col("n_reachable") / F.col("n_known"))


def reachability_by_group(scored: DataFrame, truth: DataFrame, features: list[str]) -> DataFrame:
    """Per group (both, drug_only, assoc_only, neither) and feature: mean within-disease percentile and null rate."""
    kept = flag_members(scored.join(truth.select("disease_index").distinct(), "disease_index", "left_semi"), truth, PAIR, "is_known")
    t, v = F.col("is_target") == 1, F.col("is_known") == 1
    kept = kept.withColumn("group", F.when(t & v, "both").when(v, "drug_only").when(t, "assoc_only").otherwise("neither"))
    long = kept.select("disease_index", "group", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["disease_index", "group"], features, "feature", "value")
    ranked = rank_pct(long, ["disease_index", "feature"], "value")
    return ranked.groupBy("group", "feature").agg(F.avg("pct").alias("mean_pct"), F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("null_rate"))


def supported_auc(scored: DataFrame, routes: DataFrame, unsupported: Column, score: str = "proba") -> DataFrame:
    """AUC by disease without the positives that only an unsupported route admits."""
    drop = routes.where(unsupported).select(*PAIR)
    positives = scored.where("is_target = 1").join(drop, PAIR, "left_anti")
    return auc_by_group(scored.where("is_target = 0").unionByName(positives), score=score)


def persona_funnel(candidates: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """Candidates with each criterion as 0/1 and how many they meet."""
    flags = {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in criteria.items()}
    out = candidates.withColumns(flags)
    return out.withColumn("n_met", sum((F.col(n) for n in flags), F.lit(0)).cast("long"))


def upsert_config(first: DataFrame, second: DataFrame, key: str, second_wins: list[str]) -> DataFrame:
    """Rows of both; on a shared key the second's columns in ``second_wins`` count, others only where the first has none."""
    cols = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c != key]
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, key, "full_outer")

    def pick(c):
        if c not in first.columns or c not in second.columns:
            return F.col(c)
        order = (f"b.{c}", f"a.{c}") if c in second_wins else (f"a.{c}", f"b.{c}")
        return F.coalesce(*order).alias(c)

    return joined.select(key, *[pick(c) for c in cols])


def top_lists(scored: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    return rank_first(scored, "disease_index", score, "gene_index").where(F.col("rank") <= k)


def panel_overlap(top: DataFrame, depth: DataFrame, near: float = 0.6) -> DataFrame:
    """Pairs of a family's diseases: shared genes, Jaccard, depth gap, near-duplicates (E18). depth: disease_index, family_id, depth."""
    from .sets import set_overlap

    pairs = set_overlap(top, "disease_index", "gene_index")
    at = lambda e: depth.select(F.col("disease_index").alias(e), F.col("family_id").alias(f"f{e}"), F.col("depth").alias(f"d{e}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").where("fa = fb")
    return both.select("a", "b", F.col("fa").alias("family_id"), "shared", "jaccard", F.abs(F.col("da") - F.col("db")).cast("long").alias("depth_gap"), (F.col("jaccard") > near).cast("long").alias("near_duplicate"))


def gap_profile(overlap: DataFrame) -> DataFrame:
    """Mean overlap by depth gap."""
    return overlap.groupBy("depth_gap").agg(F.count("*").alias("pairs"), F.avg("jaccard").alias("mean_jaccard"), F.max("jaccard").alias("max_jaccard"), F.sum("near_duplicate").cast("long").alias("near_duplicates"))


def programme_scope(top: DataFrame, families: DataFrame) -> DataFrame:
    """Per family and gene of the top lists: in all, some or one of its members."""
    named = top.join(families, "disease_index").select("family_id", "disease_index", "gene_index").distinct()
    size = named.groupBy("family_id").agg(F.countDistinct("disease_index").alias("n_leaves"))
    n = named.groupBy("family_id", "gene_index").agg(F.count("*").alias("n_in")).join(size, "family_id")
    scope = F.when(F.col("n_in") == F.col("n_leaves"), "common").when(F.col("n_in") == 1, "specific").otherwise("partial")
    return n.withColumn("scope", scope)


def hits_with_verdict(scored: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    """Per disease: hits in the top k, expected hits, the Poisson tail and its verdict."""
    ranked = rank_first(scored, "disease_index", score, "gene_index")
    per = ranked.groupBy("disease_index").agg(F.count("*").alias("pool"), F.sum("is_target").cast("long").alias("n_known"), hits("rank", k, F.col("is_target")).alias("hits"))
    per = per.withColumn("expected", F.lit(float(k)) * F.col("n_known") / F.col("pool")).withColumn("poisson_p", poisson_upper(F.col("hits"), F.col("expected")))
    verdict = F.when(F.col("poisson_p") > 0.05, "not significant").when(F.col("hits") < 3, "significant but fragile").otherwise("significant")
    return per.withColumn("enrichment", ratio(F.col("hits"), F.col("expected"))).withColumn("verdict", verdict)


def calibration_bins(scored: DataFrame, score: str = "proba", k: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) over equal-mass bins."""
    return percentile_bins(scored, score, k).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg("is_target").alias("rate"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def threshold_scan(scored: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1) (E24). Rows are counted between thresholds once; the scan sums those counts."""
    edges = F.array(*[F.lit(t) for t in thresholds])
    level = F.size(F.filter(edges, lambda t: t <= F.col(score)))
    counts = scored.groupBy(level.alias("level")).agg(F.sum("is_target").alias("p"), F.count("*").alias("n"))
    spine = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "at int, threshold double")
    total = F.broadcast(counts.agg(F.sum("p").alias("all_p")))
    tp = spine.join(F.broadcast(counts), F.col("level") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return tp.crossJoin(total).select("threshold", ratio(F.col("tp"), F.col("n")).alias("precision"), ratio(F.col("tp"), F.col("all_p")).alias("recall"), ratio(2 * F.col("tp"), F.col("n") + F.col("all_p")).alias("f1"))


def feature_auc(scored: DataFrame, features: list[str]) -> DataFrame:
    """Macro AUC of each single feature."""
    per = scored.select("disease_index", "is_target", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["disease_index", "is_target"], features, "feature", "value").where("value is not null")
    ranked = per.withColumn("__r", average_rank(["feature", "disease_index"], "value"))
    y = F.col("is_target")
    auc = ranked.groupBy("feature", "disease_index").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"), F.sum(F.when(y == 1, F.col("__r"))).alias("rs")).select("feature", auc_from_ascending(F.col("rs"), F.col("p"), F.col("q")).alias("auc"))
    return auc.groupBy("feature").agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_diseases"))


def parent_child(auc: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent and child AUC of the edges whose ends are both scored, and their difference."""
    p, c = auc.select(F.col("disease_index").alias("parent"), F.col("auc").alias("auc_parent")), auc.select(F.col("disease_index").alias("child"), F.col("auc").alias("auc_child"))
    return edges.join(p, "parent").join(c, "child").select("parent", "child", "auc_parent", "auc_child", (F.col("auc_child") - F.col("auc_parent")).alias("delta"))


def score_buckets(known: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """Per score bucket: rows and the share that holds (E22). Buckets are closed below."""
    b = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(score))).cast("long")
    return known.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("is_known").alias("known_rate"), F.min(score).alias("lowest"))


def expected_check(expected: DataFrame, served: DataFrame, k: int = 20) -> DataFrame:
    """Per disease: expected genes, how many are served in the top k, best rank."""
    return expected.join(served.select(*PAIR, "rank"), PAIR, "left").groupBy("disease_index").agg(F.count("*").alias("n_expected"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"in_top_{k}"), F.min("rank").alias("best_rank"))


def over_representation(scored: DataFrame, value: str, score: str = "proba", k: int = 50, bins: int = 5) -> DataFrame:
    """Share of each value quintile in the top k over its share of the pool."""
    binned = percentile_bins(scored, value, bins)
    ranked = rank_first(binned, "disease_index", score, "gene_index")
    counts = ranked.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias("top"))
    every = F.broadcast(counts.agg(F.sum("n").alias("an"), F.sum("top").alias("at")))
    return counts.crossJoin(every).select("bin", "n", "top", ratio(F.col("top") / F.col("at"), F.col("n") / F.col("an")).alias("ratio"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks (A18), ranked by counts of distinct values."""
    def ranks(c, out):
        r = value_counts_upto(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), c)
        return r.select(F.col("value").alias(c), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))

    return df.join(ranks(x, "__x"), x).join(ranks(y, "__y"), y).agg(F.corr("__x", "__y").alias("rho"))


def panel_either_top(scored: DataFrame, score: str = "proba", k: int = 50) -> DataFrame:
    """The union of the top k of all and of the novel pairs."""
    return either_top(scored, "disease_index", score, "gene_index", F.col("is_target") == 0, k)
