"""Statistics of vertices, edges, components and cuts against permutations.

Counts keep the meaning of their definition, not of their name: ``nless`` counts permutations above the real value (the real one is less), ``ngreater`` those below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import fisher_pvalue, mannwhitney
from ..tables import settle
from .edges import diedge_ends
from .flows import component_flows, flowstats
from .hierarchy import cuts, thresholds

#: Scale that makes the median absolute deviation of a normal sample its standard deviation.
MAD_SCALE = 1.4826
METRICS = [
    "ncomponents", "ncomponents_nontrivial", "ncomponents_signif_mw", "ncomponents_signif_fisher", "components_signif_sizesum_mw", "components_signif_sizesum_fisher", "maxcomponent_size", "topn_components_sizesum", "log10_maxcomponent_size", "log10_topn_components_sizesum", "ncompsources", "topn_nsources", "ncompsinks", "topn_nsinks", "nflows", "ncompflows",
    "flow_avglen", "flow_avginvlen", "compflow_avglen", "compflow_avginvlen", "flow_avgweight", "flow_avghopweight", "compflow_avgweight", "flow_avgminedgeweight", "compflow_avgminedgeweight", "flow_distance", "compflow_distance",
]


def _perm_name(value: str) -> str:
    """weight -> permweight, walkweight -> walkpermweight."""
    return "walkpermweight" if value == "walkweight" else f"perm{value}"


def permweight_stats(real: DataFrame, perms: DataFrame, keys: Sequence[str], value: str = "weight", compat: bool = False) -> DataFrame:
    """keys, value and its permutations' mean, std, median, mad, nless, ngreater and delta (value less median; compat: the mean stands for the median)."""
    keys, name = list(keys), _perm_name(value)
    joined = perms.select(*keys, F.col(value).alias("p")).join(real.select(*keys, value), keys)
    mid = joined.groupBy(*keys).agg(F.avg("p").alias("mid") if compat else F.median("p").alias("mid"))
    joined = joined.join(mid, keys)
    out = joined.groupBy(*keys).agg(
        F.first(value).alias(value), F.avg("p").alias(f"{name}_mean"), F.stddev_samp("p").alias(f"{name}_std"), F.first("mid").alias(f"{name}_median"), (F.median(F.abs(F.col("p") - F.col("mid"))) * MAD_SCALE).alias(f"{name}_mad"),
        F.sum((F.col("p") > F.col(value)).cast("int")).alias(f"nless_{value}"), F.sum((F.col("p") < F.col(value)).cast("int")).alias(f"ngreater_{value}"),
    )
    return out.withColumn(f"{value}_delta", F.col(value) - F.col(f"{name}_median"))


def _graph_stats(real: DataFrame, keys: Sequence[str], permweights: DataFrame | None, permwalk: DataFrame | None, compat: bool) -> DataFrame:
    out = real
    for perms, value in ((permweights, "weight"), (permwalk, "walkweight")):
        if perms is not None:
            out = out.join(permweight_stats(real, perms, keys, value, compat).drop(value), list(keys), "left")
    return out


def vertex_stats(weights: DataFrame, walkweights: DataFrame, permweights: DataFrame | None = None, permwalk: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """vertex, weight, walkweight and, where permutations (perm, vertex, ...) are given, their statistics."""
    return _graph_stats(weights.select("vertex", "weight").join(walkweights.select("vertex", "walkweight"), "vertex"), ["vertex"], permweights, permwalk, compat)


def diedge_stats(edges: DataFrame, permweights: DataFrame | None = None, permwalk: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """src, dest, weight, walkweight and the statistics of their permutations (perm, src, dest, weight or walkweight)."""
    return _graph_stats(edges.select("src", "dest", "weight", "walkweight"), ["src", "dest"], permweights, permwalk, compat)


def indexed_diedge_stats(n: int, edges: DataFrame, permweights: DataFrame | None = None, permwalk: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """As ``diedge_stats`` for pairs of vertices 1..n named by one number, ``diedge``, column by column: src, dest instead of it."""
    src, dest = diedge_ends(F.col("diedge"), n)
    out = _graph_stats(edges.select("diedge", "weight", "walkweight"), ["diedge"], permweights, permwalk, compat)
    return out.select(src.alias("src"), dest.alias("dest"), *[c for c in out.columns if c != "diedge"])


def component_stats(components: DataFrame, vertices: DataFrame | None = None, perms: DataFrame | None = None, average: bool = True, weight_tests: bool = False, mannwhitney_tests: bool = False) -> DataFrame:
    """component, nvertices and, with vertices (vertex, weight, walkweight, is_hit), hits and Fisher's p-value.

    average: means and medians of the weights and, with perms (perm, vertex, weight, walkweight), of the permuted ones. mannwhitney_tests: p-values of the walk weights against the permuted ones; weight_tests: of the weights too.
    ``components`` may have a column threshold: then every threshold has its own components.
    """
    keys = [c for c in ("threshold", "component") if c in components.columns]
    out = components.groupBy(*keys).agg(F.count("*").alias("nvertices"))
    if vertices is None:
        return out
    joined = components.join(vertices, "vertex")
    hits = vertices.agg(F.sum(F.col("is_hit").cast("int")).alias("all_hits"), F.count("*").alias("total"))
    parts = [F.sum(F.col("is_hit").cast("int")).alias("nhits")]
    middle = lambda c, name: [F.median(c).alias(f"{name}_median"), F.avg(c).alias(f"{name}_mean")]
    if average:
        parts += middle("weight", "weight") + middle("walkweight", "walkweight")
    out = out.join(joined.groupBy(*keys).agg(*parts), keys).crossJoin(F.broadcast(hits))  # one row
    out = out.withColumn("pvalue_walkweight_fisher", fisher_pvalue(F.col("nhits"), F.col("nvertices"), F.col("all_hits"), F.col("total"))).drop("all_hits", "total")
    if perms is not None:
        permuted = components.join(perms.select("vertex", "weight", "walkweight"), "vertex")
        if average:
            out = out.join(permuted.groupBy(*keys).agg(*middle("weight", "permweight"), *middle("walkweight", "walkpermweight")), keys, "left")
        for c in (["weight"] if weight_tests else []) + ["walkweight"] if mannwhitney_tests else []:
            rows = joined.select(*keys, F.col(c).alias("x"), F.lit(True).alias("real")).union(permuted.select(*keys, F.col(c), F.lit(False)))
            out = out.join(mannwhitney(rows, keys, "x", "real").select(*keys, F.col("pvalue").alias(f"pvalue_{c}_mw")), keys, "left")
    return out


def treecut_stats(merge: DataFrame, vertices: DataFrame, walk: DataFrame | None = None, sources: DataFrame | None = None, sinks: DataFrame | None = None, weights: DataFrame | None = None, maxweight: float | None = None, top_count: int = 5) -> DataFrame:
    """One row for each threshold of the tree, weak to strong."""
    cut = settle(cuts(merge, vertices, thresholds(merge)))
    sizes = cut.groupBy("threshold", "component").agg(F.count("*").alias("size"))
    for name, v in (("nsources", sources), ("nsinks", sinks)):
        n = F.lit(0).cast("long") if v is None else None
        if v is None:
            sizes = sizes.withColumn(name, n)
        else:
            inside = cut.join(v.select("vertex"), "vertex", "left_semi").groupBy("threshold", "component").agg(F.count("*").alias(name))
            sizes = sizes.join(inside, ["threshold", "component"], "left").fillna(0, [name])
    sizes = settle(sizes)
    parts = [F.count("*").alias("ncomponents"), F.sum((F.col("size") > 1).cast("int")).alias("ncomponents_nontrivial"), F.max("size").alias("maxcomponent_size")]
    tops = [F.sum("size").alias("topn_components_sizesum")]
    for name, v in (("sources", sources), ("sinks", sinks)):
        if v is not None:
            parts.append(F.sum((F.col(f"n{name}") > 0).cast("int")).alias(f"ncomp{name}"))
            tops.append(F.sum(f"n{name}").alias(f"topn_n{name}"))
    out = sizes.groupBy("threshold").agg(*parts).join(topn_components(sizes, top_count).groupBy("threshold").agg(*tops), "threshold")
    out = out.withColumns({f"log10_{c}": F.log10(c) for c in ("maxcomponent_size", "topn_components_sizesum")})
    if walk is None or sources is None or sinks is None:
        return out
    f = flowstats(cut, component_flows(cut, walk, sources, sinks), sources, sinks, weights, maxweight, zero_as_threshold=True).drop("ncompsources", "ncompsinks")
    v = F.lit(sources.count() * sinks.count()).cast("double")
    c = (F.col("ncompsources") * F.col("ncompsinks")).cast("double")
    per = lambda x, n: F.when(n == 0, F.lit(float("nan"))).otherwise(F.col(x) / F.when(n != 0, n))
    k = F.col("ncomponents") + 1
    out = out.join(f, "threshold", "left").fillna(0, ["nflows", "ncompflows", "flowlen_sum", "flowinvlen_sum", "compflowlen_sum", "compflowinvlen_sum", "flow_minedgeweight_sum", "compflow_minedgeweight_sum"])
    return out.select(
        *[x for x in out.columns if x in METRICS or x == "threshold"], per("flowlen_sum", F.col("nflows")).alias("flow_avglen"), per("flowinvlen_sum", v).alias("flow_avginvlen"), per("compflowlen_sum", F.col("ncompflows")).alias("compflow_avglen"), per("compflowinvlen_sum", c).alias("compflow_avginvlen"),
        per("floweight_sum", v).alias("flow_avgweight"), per("flowavghopweight_sum", v).alias("flow_avghopweight"), per("compfloweight_sum", c).alias("compflow_avgweight"), per("flow_minedgeweight_sum", v).alias("flow_avgminedgeweight"), per("compflow_minedgeweight_sum", c).alias("compflow_avgminedgeweight"),
        F.when(v > 0, ((v - F.col("nflows")) * k + F.col("flowlen_sum")) / v).alias("flow_distance"), F.when(c > 0, ((c - F.col("ncompflows")) * k + F.col("compflowlen_sum")) / F.when(c > 0, c)).alias("compflow_distance"),
    )


def topn_components(sizes: DataFrame, top_count: int = 5) -> DataFrame:
    """The largest components of each threshold (threshold, component, size, ...), with their rank; of equal ones the one with the smaller vertex."""
    rank = F.row_number().over(Window.partitionBy("threshold").orderBy(F.desc("size"), "component"))
    return sizes.withColumn("rank", rank).where(F.col("rank") <= top_count)


def treecut_compstats(cut: DataFrame, vertices: DataFrame, perms: DataFrame | None = None, mannwhitney_tests: bool = False, pvalue_mw_max: float = 0.05, pvalue_fisher_max: float = 0.05) -> DataFrame:
    """threshold, and counts and size sums of significant components of more than one vertex, for every threshold of cut (threshold, component, vertex); vertices and perms as for ``component_stats``."""
    size = cut.groupBy("threshold", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = component_stats(cut.join(size, ["threshold", "component"]), vertices, perms, average=False, mannwhitney_tests=mannwhitney_tests)
    sums = lambda p, a, n: [F.sum((F.col(p) <= a).cast("int")).alias(f"ncomponents_signif_{n}"), F.sum(F.when(F.col(p) <= a, F.col("nvertices")).otherwise(0)).alias(f"components_signif_sizesum_{n}")]
    parts = sums("pvalue_walkweight_fisher", pvalue_fisher_max, "fisher")
    if mannwhitney_tests:
        parts += sums("pvalue_walkweight_mw", pvalue_mw_max, "mw")
    out = cut.select("threshold").distinct().join(found.groupBy("threshold").agg(*parts), "threshold", "left")
    return out.fillna(0, [c for c in out.columns if c != "threshold"])


def threshold_bins(df: DataFrame, nbins: int = 100, maxwidth: float | None = None, threshold_range: tuple[float, float] | None = None) -> list[float]:
    """Boundaries over the sorted thresholds of df, one for each row: a new one once a bin has its share of the rows or is too wide.

    The thresholds are counted and sorted by all tasks; one task then walks over the different ones as a stream and keeps the boundaries only: about nbins, and the range over maxwidth.
    """
    used = df.where("threshold is not null")
    if threshold_range:
        used = used.where(F.col("threshold").between(*threshold_range))
    counted = settle(used.groupBy(F.col("threshold").cast("double").alias("threshold")).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_at, seen = None, 0, 0
        for batch in batches:
            out = []
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, end = seen + 1, seen + n  # places of the rows of this threshold
                seen = end
                if last is None:
                    out.append(t)
                    last, last_at = t, first
                    continue
                # the first place at which the bin has its share, or the very last row
                full = max(first, -(-total // nbins) - 1 + last_at)
                place = first if maxwidth is not None and t - last >= maxwidth else full if full <= end else end if end == total else None
                if place is not None:
                    out.append(t)
                    last, last_at = t, place
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["bound"])

    stream = counted.orderBy("threshold").coalesce(1)
    return [r.bound for r in stream.mapInArrow(walk, "bound double").collect()]


def add_bins(df: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """threshold_bin: how many of the sorted boundaries are at most the threshold."""
    array = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    return df.withColumn("threshold_bin", F.size(F.filter(array, lambda b: b <= F.col("threshold"))))


def bin_treecut_stats(df: DataFrame, by: Sequence[str] = (), nbins: int = 100, maxwidth: float | None = None, threshold_range: tuple[float, float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Medians of the metrics in each bin of thresholds, with the bin's ends and middle (null outside the boundaries). A range limits the boundaries, not the rows: what lies outside is in the first and the last bin."""
    columns = [c for c in METRICS if c in df.columns] if columns is None else list(columns)
    bounds = threshold_bins(df, nbins, maxwidth, threshold_range)
    return with_bin_ends(add_bins(df, bounds).groupBy(*by, "threshold_bin").agg(*[F.median(c).alias(c) for c in columns]), bounds)


def with_bin_ends(binned: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """binned with threshold_binmin, threshold_binmax and threshold_binmid of its threshold_bin, null outside the boundaries."""
    array = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    b = F.col("threshold_bin")
    inside = (b > 0) & (b < len(bounds))
    at = lambda k: F.when(inside, F.element_at(array, F.when(inside, k).otherwise(1)))
    out = binned.withColumn("threshold_binmin", at(b)).withColumn("threshold_binmax", at(b + 1))
    return out.withColumn("threshold_binmid", (F.col("threshold_binmin") + F.col("threshold_binmax")) / 2)


def aggregate_binstats(df: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.025, 0.25, 0.5, 0.75, 0.975), columns: Sequence[str] | None = None) -> DataFrame:
    """Quantiles across permutations in each bin, one row a quantile (0.5 always among them); a missing value makes the quantile NaN."""
    columns = [c for c in METRICS if c in df.columns] if columns is None else list(columns)
    qs = sorted({*quantiles, 0.5})
    safe = lambda c: F.when(F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")) > 0, F.array(*[F.lit(float("nan"))] * len(qs))).otherwise(F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q in qs])))
    out = df.groupBy(*by, "threshold_bin").agg(F.first("threshold_binmid", True).alias("threshold_binmid"), *[safe(c).alias(c) for c in columns])
    out = out.select("*", F.posexplode(F.array(*[F.lit(q) for q in qs])).alias("k", "quantile"))
    return out.select(*by, "threshold_bin", "threshold_binmid", "quantile", *[F.col(c)[F.col("k")].alias(c) for c in columns])


def extreme_treecut_stats(stats: DataFrame, perm_agg: DataFrame, extra: Sequence[str] = (), columns: Sequence[str] | None = None, weight: Column | None = None, relative: bool = False, maxquantile: float = 0.25, threshold_range: tuple[float, float] | None = None) -> DataFrame:
    """For every quantile and metric the thresholds at which the real value is farthest below (min) and above (max) the permuted one: the optimum (of equal ones the smallest threshold), and the largest and smallest threshold of that tail.

    Without a permuted value there is no difference: such thresholds are farthest from both extremes.
    """
    columns = [c for c in METRICS if c in stats.columns and c in perm_agg.columns] if columns is None else list(columns)
    extra = list(extra)
    near = lambda k, tag: perm_agg.select(*extra, "quantile", (F.col("threshold_bin") + k).alias("threshold_bin"), F.col("threshold_binmid").alias(f"mid_{tag}"), *[F.col(c).cast("double").alias(f"{c}_{tag}") for c in columns])
    on = [*extra, "threshold_bin", "quantile"]
    bins = near(0, "own").join(near(-1, "next"), on, "left").join(near(1, "prev"), on, "left")
    joined = stats.join(bins, [*extra, "threshold_bin"], "left")  # rows of bins without permutations stay, with a null quantile
    if threshold_range:
        joined = joined.where(F.col("threshold").between(*threshold_range))
    before = F.col("threshold") < F.col("mid_own")
    other = F.when(before, F.coalesce("mid_prev", "mid_own")).otherwise(F.coalesce("mid_next", "mid_own"))
    gap = F.col("mid_own") - other
    k = F.when(gap != 0, (F.col("mid_own") - F.col("threshold")) / F.when(gap != 0, gap))
    at = lambda c: F.col(f"{c}_own") * (1 - k) + F.when(before, F.coalesce(f"{c}_prev", f"{c}_own")).otherwise(F.coalesce(f"{c}_next", f"{c}_own")) * k
    metric = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), at(c).alias("permuted_value")) for c in columns])).alias("m")
    factor = F.lit(1.0) if weight is None else weight
    long = joined.select(*extra, "quantile", "threshold", "threshold_bin", factor.alias("factor"), metric).select("*", "m.*").drop("m")
    diff = F.col("value") - F.col("permuted_value")
    scaled = F.when(F.col("permuted_value") != 0, diff / F.abs(F.when(F.col("permuted_value") != 0, F.col("permuted_value")))) if relative else diff
    long = long.withColumn("delta", diff).withColumn("score", scaled * F.col("factor"))
    bad = F.col("score").isNull() | F.isnan("score")
    keys = [*extra, "quantile", "metric"]
    out = None
    for stat, sign in (("min", 1.0), ("max", -1.0)):
        one = long.withColumn("s", F.when(bad, float("inf")).otherwise(F.col("score") * sign))
        limit = F.percentile("s", maxquantile).over(Window.partitionBy(*keys))
        one = one.withColumn("limit", limit)
        row = F.struct("value", "permuted_value", "delta", "threshold", "threshold_bin")
        picked = one.groupBy(*keys).agg(
            F.min_by(row, F.struct("s", "threshold")).alias("opt"), F.max_by(F.when(F.col("s") <= F.col("limit"), row), F.when(F.col("s") <= F.col("limit"), F.col("threshold"))).alias("small"), F.min_by(F.when(F.col("s") <= F.col("limit"), row), F.when(F.col("s") <= F.col("limit"), F.col("threshold"))).alias("big"),
        )
        part = picked.select(*keys, F.lit(stat).alias("stat"), F.explode(F.array(*[F.struct(F.lit(n).alias("value_type"), F.col(n).alias("r")) for n in ("opt", "small", "big")])).alias("x"))
        part = part.select(*keys, "stat", "x.value_type", "x.r.*")
        out = part if out is None else out.union(part)
    return out
