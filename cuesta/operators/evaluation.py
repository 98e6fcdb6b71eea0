"""Evaluation of detectors and of the drainage rule: leaderboards, offsets, sweeps, scorecards, picks, densest windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesta.functions.numeric import finite
from cuesta.operators.regions import components, dilate, distance, linearity
from cuesta.operators.scoring import recall_curve, top_cells

AT = ["grid_id", "r", "c"]


def linearity_at_budget(response: DataFrame, budget: float, least: int = 5) -> DataFrame:
    """The linearity of the strongest share of a response(grid_id, r, c, z)."""
    return linearity(components(top_cells(response, budget)), least)


def mask_recall(edges: DataFrame, truth: DataFrame, valid: DataFrame, tolerance: float = 1) -> DataFrame:
    """(grid_id, truth, hit, recall, edges, budget): the share of valid truth within the tolerance of an edge, and of valid cells that are edges."""
    t = truth.select(*AT).distinct().join(valid.select(*AT), AT, "left_semi")
    hit = t.join(dilate(edges, tolerance).withColumn("_h", F.lit(1)), AT, "left")
    a = hit.groupBy("grid_id").agg(F.count("*").alias("truth"), F.count("_h").alias("hit"))
    sizes = valid.groupBy("grid_id").agg(F.count("*").alias("_v"))
    b = sizes.join(edges.groupBy("grid_id").agg(F.count("*").alias("edges")), "grid_id", "left")
    out = b.join(a, "grid_id", "left").select("grid_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "hit", "edges")), "_v")
    return out.select("grid_id", "truth", "hit", (F.col("hit") / F.greatest("truth", F.lit(1))).alias("recall"), "edges", (F.col("edges") / F.col("_v")).alias("budget"))


def leaderboard(responses: Mapping[str, DataFrame], truth: DataFrame, budgets: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2), by: float = 0.05) -> DataFrame:
    """(place, band, recall_at_<k>pct, ...): recall of each band's response at equal budgets, best first; equal ones as given."""
    rows = None
    for n, (name, response) in enumerate(responses.items()):
        one = recall_curve(response, truth, budgets).select(F.lit(n).alias("_n"), F.lit(name).alias("band"), "budget", "recall")
        rows = one if rows is None else rows.unionByName(one)
    named = {float(b): f"recall_at_{round(b * 100)}pct" for b in budgets}
    wide = rows.groupBy("_n", "band").agg(*(F.max(F.when(F.col("budget") == b, F.col("recall"))).alias(n) for b, n in named.items()))
    order = Window.orderBy(F.coalesce(named[float(by)], F.lit(0.0)).desc(), "_n")  # one row a band
    return wide.select(F.row_number().over(order).alias("place"), "band", *named.values())


def compared(methods: Mapping[str, DataFrame], truth: DataFrame, budget: float = 0.05) -> DataFrame:
    """(method, recall, linearity) of responses at one budget."""
    out = None
    for name, response in methods.items():
        recall = recall_curve(response, truth, [budget]).select("grid_id", "recall")
        one = recall.join(linearity_at_budget(response, budget).select("grid_id", "linearity"), "grid_id").withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("method", "grid_id", "recall", "linearity")


def offsets(pixels: DataFrame, edges: DataFrame, truth: DataFrame) -> DataFrame:
    """(grid_id, r, c, distance) of the truth cells to the nearest edge."""
    return distance(pixels, edges).join(truth.select(*AT).distinct(), AT, "left_semi").select(*AT, "distance")


def registration(found: DataFrame, within: Sequence[float] = (0, 1, 2, 3, 5), concealed: float = 5) -> DataFrame:
    """(grid_id, n, median, p75, p90, within_<k>..., concealed) of offsets(...)."""
    p = F.percentile("distance", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    shares = [F.avg((F.col("distance") <= k).cast("double")).alias(f"within_{k}") for k in within]
    out = found.groupBy("grid_id").agg(F.count("*").alias("n"), p.alias("_p"), *shares, F.avg((F.col("distance") > concealed).cast("double")).alias("concealed"))
    return out.select("grid_id", "n", *(F.col("_p")[i].alias(n) for i, n in enumerate(("median", "p75", "p90"))), *(f"within_{k}" for k in within), "concealed")


def fairer_registration(found: DataFrame) -> DataFrame:
    """The reading for lines drawn on crests: within one to three pixels, concealed past three."""
    return registration(found, (1, 2, 3), 3)


def subsample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same ones whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))


def conditioned_misses(hand: DataFrame, min_aligned: float = 0.5, at_risk: float = 0.5, *keys: str) -> DataFrame:
    """(keys, n_at_risk, n_flagged, share): of traces(overlap, aligned) that lie on channels, those that the alignment rule flags."""
    risk = F.col("overlap") >= at_risk
    out = hand.groupBy(*keys).agg(F.count_if(risk).alias("n_at_risk"), F.count_if(risk & (F.col("aligned") >= min_aligned)).alias("n_flagged"))
    return out.withColumn("share", _share(F.col("n_flagged"), F.col("n_at_risk")))


def alignment_sweep(detected: DataFrame, hand: DataFrame, cuts: Sequence[float] = (0.3, 0.4, 0.5, 0.6), at_risk: float = 0.5) -> DataFrame:
    """(angle, min_aligned, removed_share, n_at_risk, n_flagged, missed_share) of detected(angle, aligned, length) and
    hand(angle, overlap, aligned): each row goes to every cut, so one pass serves the grid of parameters."""
    grid = F.explode(F.array(*(F.lit(float(c)) for c in cuts)))
    cut = F.col("aligned") >= F.col("min_aligned")
    gone = detected.withColumn("min_aligned", grid).groupBy("angle", "min_aligned").agg(_share(F.sum(F.when(cut, F.col("length")).otherwise(0.0)), F.sum("length")).alias("removed_share"))
    risk = F.col("overlap") >= at_risk
    missed = hand.withColumn("min_aligned", grid).groupBy("angle", "min_aligned").agg(F.count_if(risk).alias("n_at_risk"), F.count_if(risk & cut).alias("n_flagged"))
    return gone.join(missed, ["angle", "min_aligned"]).withColumn("missed_share", _share(F.col("n_flagged"), F.col("n_at_risk")))


def accumulation_sweep(network: DataFrame, cuts: Sequence[int] = (30, 15, 8, 4)) -> DataFrame:
    """(grid_id, least, channels, density, gained): channel cells at each threshold, and what the next lower one adds."""
    out = network.where("accumulation > 0").select("grid_id", "accumulation", F.explode(F.array(*(F.lit(c) for c in cuts))).alias("least")).groupBy("grid_id", "least")
    t = out.agg(F.count_if(F.col("accumulation") >= F.col("least")).alias("channels"), F.count("*").alias("_n"))
    before = F.lag("channels").over(Window.partitionBy("grid_id").orderBy(F.desc("least")))  # one row a threshold
    return t.select("grid_id", "least", "channels", (F.col("channels") / F.col("_n")).alias("density"), (F.col("channels") - F.coalesce(before, F.lit(0))).alias("gained"))


#: The discriminators that are compared, over columns overlap, aligned, monotonicity and curvature.
RULES: dict[str, str] = {
    "aligned": "aligned >= 0.5",
    "monotonic": "overlap >= 0.5 AND coalesce(monotonicity >= 0.6 AND NOT isnan(monotonicity), false)",
    "aligned or monotonic": "aligned >= 0.5 OR (overlap >= 0.5 AND coalesce(monotonicity >= 0.6 AND NOT isnan(monotonicity), false))",
    "concave": "overlap >= 0.5 AND coalesce(curvature < 0, false)",
    "aligned or concave": "aligned >= 0.5 OR (overlap >= 0.5 AND coalesce(curvature < 0, false))",
}


def scorecard(traces: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(rule, flagged, length_share, band, band_caught): each rule on all traces and on those on a channel but not along it."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.expr(e).alias("hit")) for n, e in rules.items())))
    band = (F.col("overlap") >= 0.5) & (F.col("aligned") < 0.5)
    t = traces.select("length", band.alias("_b"), rows.alias("_r"))
    hit = F.col("_r.hit")
    return t.groupBy(F.col("_r.rule").alias("rule")).agg(F.count_if(hit).alias("flagged"), _share(F.sum(F.when(hit, F.col("length")).otherwise(0.0)), F.sum("length")).alias("length_share"), F.count_if(F.col("_b")).alias("band"), F.count_if(F.col("_b") & hit).alias("band_caught"))


def residual(flags: DataFrame) -> DataFrame:
    """One row of the kept traces still on channels, and of those just under the alignment cut, with their shares of length."""
    kept = ~F.col("is_drainage")
    on, border = kept & (F.col("overlap") >= 0.5), kept & (F.col("aligned") >= 0.3)
    total = F.sum("length")
    return flags.agg(F.count_if(on).alias("on_channel"), _share(F.sum(F.when(on, F.col("length")).otherwise(0.0)), total).alias("on_channel_share"), F.count_if(border).alias("border"), _share(F.sum(F.when(border, F.col("length")).otherwise(0.0)), total).alias("border_share"))


def audit(flags: DataFrame, n: int = 24) -> DataFrame:
    """The n kept traces most like drainage: by overlap, then alignment, then id."""
    return flags.where("NOT is_drainage").orderBy(F.desc("overlap"), F.desc("aligned"), "trace_id").limit(n)


def extremes(values: DataFrame, value: str, n: int, key: str = "trace_id") -> DataFrame:
    """The n lowest and the n highest finite values, with end (low, high)."""
    v = values.where(finite(value))
    low = v.orderBy(value, key).limit(n).withColumn("end", F.lit("low"))
    return low.union(v.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("high")))


def review_queue(flags: DataFrame) -> DataFrame:
    """Flagged traces in the order of review, numbered from 1."""
    return flags.where("is_drainage").select(F.row_number().over(Window.orderBy(F.desc("rank"), "trace_id")).alias("place"), "*")


def densest_windows(cells: DataFrame, pixels: DataFrame, size: int, n: int = 4) -> list[tuple[int, int, float]]:
    """Up to n windows of ``size`` cells with the most marked cells, one after the other without overlap, as (row, column, density)."""
    from cuesta.operators.fixpoint import settled
    from cuesta.operators.stencils import box_sum

    marked = pixels.select(*AT).join(cells.select(*AT).distinct().withColumn("_m", F.lit(1.0)), AT, "left")
    left = settled(box_sum(marked, F.coalesce("_m", F.lit(0.0)), size // 2, "density").select(*AT, (F.col("density") / (2 * (size // 2) + 1) ** 2).alias("density")))
    out: list[tuple[int, int, float]] = []
    while len(out) < n:
        best = left.where("density > 0").orderBy(F.desc("density"), "r", "c").first()
        if best is None:
            break
        out.append((best.r, best.c, best.density))
        inside = (F.col("r") >= best.r - size) & (F.col("r") < best.r + size) & (F.col("c") >= best.c - size) & (F.col("c") < best.c + size)
        left = left.where(~inside)
    return out


def morphology_mix(fits: DataFrame) -> DataFrame:
    """(morphology, n, share) of the reliable fits(dip, reliable); a dip without class has a NULL morphology."""
    from cuesta.functions.angles import morphology

    t = fits.where("reliable").groupBy(morphology("dip").alias("morphology")).agg(F.count("*").alias("n"))
    return t.select("morphology", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def active(attitudes: DataFrame) -> DataFrame:
    """The selected rows of attitudes(..., selected), or all if none is; the choice is one row, broadcast."""
    chosen = F.coalesce("selected", F.lit(False))
    some = attitudes.agg(F.coalesce(F.bool_or(chosen), F.lit(False)).alias("_any"))
    return attitudes.join(F.broadcast(some)).where(~F.col("_any") | chosen).drop("_any")
