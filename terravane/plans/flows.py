"""End-to-end compositions: features, physics, training and prediction.

Every plan covers all sites in one job; ``site`` is a key, never a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import feeds as K
from terravane.functions import grids as G
from terravane.functions import physics as P
from terravane.functions import risk as R
from terravane.operators import feeds as W
from terravane.operators import features as X
from terravane.operators import flow, labels, metrics, models, sampling
from terravane.operators import risk as risk_ops
from terravane.operators import terrain as T
from terravane.operators.boxes import site_of_box
from terravane.operators.grid import fill_nulls
from terravane.operators.joins import attach_single
from terravane.session import settle

KEY = ["site", "r", "c"]


def terrain_features(dem: DataFrame, dx, dy) -> DataFrame:
    """DEM ``(site, r, c, z)`` -> elevation, slope, aspect, curvatures, twi and
    dist_to_stream.  Elevation 0 is nodata and takes the site's median.

    ``dx, dy`` are metres: numbers, or Columns of the key where sites differ.
    """
    z = fill_nulls(dem.select(*KEY, G.nodata_to_null(F.col("z"), [0.0]).alias("z")), ["z"])
    z = settle(z)
    shape = T.curvatures(z, dx, dy).select(
        *KEY, "z", T.slope_deg(F.col("dzdx"), F.col("dzdy")).alias("slope"), T.aspect_deg(F.col("dzdx"), F.col("dzdy")).alias("aspect"),
        "plan_curvature", "profile_curvature",
    )
    # Accumulation is computed once and serves both the wetness index and the streams.
    acc = settle(flow.flow_accumulation(flow.d8_receiver(z)))
    dist = T.dist_to_stream(T.streams(acc), dx, dy).select(*KEY, "acc", F.col("dist").alias("dist_to_stream"))
    return shape.join(dist, KEY).withColumn("twi", T.twi(F.col("acc"), F.col("slope"), dx, dy)).withColumnRenamed("z", "elevation").drop("acc")


def soil_parameters(df: DataFrame) -> DataFrame:
    """Raw soil layers (tenths of a percent), landcover and slope -> soil columns."""
    s = df.withColumns({k: F.coalesce(F.col(f"{k}_raw") / 10.0, F.lit(P.SOIL_AVERAGES[k])) for k in ("sand", "silt", "clay", "soc")})
    lc = F.col("landcover")
    return s.withColumns({
        "k_factor": P.k_factor(F.col("sand"), F.col("silt"), F.col("clay"), F.col("soc")),
        "cohesion": P.cohesion(F.col("silt"), F.col("clay")),
        "phi": P.friction_angle(F.col("silt"), F.col("clay")),
        "soil_depth": P.soil_depth(lc, F.col("slope")),
        "c_factor": P.c_factor(lc),
        "manning_n": P.manning_n(lc),
        "r_factor": P.r_factor_const(),
    }).drop("sand", "silt", "clay", "soc")


def stability(df: DataFrame, rain_mm_h: float = P.BASE_RAIN_MM_H) -> DataFrame:
    """Add soil loss, factor of safety and release depth to soil columns."""
    r = P.scale_by_rain(F.col("r_factor"), rain_mm_h)
    return df.withColumns({
        "rusle_soil_loss": P.soil_loss(r, F.col("k_factor"), P.ls_factor(F.col("slope")), F.col("c_factor")),
        "factor_of_safety": P.factor_of_safety(F.col("slope"), F.col("soil_depth"), F.col("cohesion"), F.col("phi")),
    }).withColumn("release", P.release_by_fs(F.col("factor_of_safety"), F.col("soil_depth")))


def physics(dem: DataFrame, layers: DataFrame, dx, dy, rain_mm_h: float = P.BASE_RAIN_MM_H) -> DataFrame:
    """Slope, soil, erosion, stability and release of every cell."""
    slope = T.gradient(dem, dx, dy).withColumn("slope", T.slope_deg(F.col("dzdx"), F.col("dzdy")))
    return stability(soil_parameters(slope.join(layers, KEY)), rain_mm_h)


def physics_summary(cells: DataFrame, dx, dy) -> DataFrame:
    return cells.groupBy("site").agg(
        F.sum(F.when(F.col("release") > 0, 1).otherwise(0)).alias("release_cells"),
        F.sum(F.col("release") * T.number(dx) * T.number(dy)).alias("release_volume"),
        F.min("factor_of_safety").alias("min_fs"),
        F.sum("rusle_soil_loss").alias("soil_loss"),
    )


def build_features(dem: DataFrame, layers: DataFrame, dx, dy, flow_layers: DataFrame | None = None) -> DataFrame:
    """The ordered feature stack of every cell."""
    df = stability(soil_parameters(terrain_features(dem, dx, dy).join(layers, KEY)))
    if flow_layers is not None:
        df = df.join(flow_layers, KEY, "left")
    have = set(df.columns)
    return df.select(*KEY, *[(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in sampling.FEATURES])


def training_sample(stack: DataFrame, label: DataFrame, n: int, seed: int) -> DataFrame:
    """Positives and slope-stratified negatives per site; safe sites give only
    negatives.  Returns the imputed training table.

    A site is safe if no cell has an event, valid or not.  Strata follow the positives that were drawn; cells
    without a slope are in no stratum but may top up.
    """
    events = settle(label.filter("label = 1").select("site").distinct())
    cells = labels.boundary_buffer(stack.drop("label").join(label.select(*KEY, "label"), KEY))
    valid = cells.filter(labels.valid_cell(F.col("landcover"), F.col("elevation")))
    # Only what sampling looks at is written; the features are joined to the few cells drawn.
    ok = settle(valid.select(*KEY, "slope", "label", "buffer"))
    positives = settle(sampling.sample_n(ok.filter("label = 1").select(*KEY, "slope", "label"), n, seed))
    negatives = ok.filter("label = 0").select(*KEY, "slope", "label", "buffer")
    at_events = settle(negatives.filter("buffer = 0").join(events, "site", "left_semi").drop("buffer"))
    at_safe = negatives.join(events, "site", "left_anti").drop("buffer")
    strata = sampling.stratified_sample(settle(at_events.filter("slope IS NOT NULL")), settle(positives.filter("slope IS NOT NULL")), n, seed, pool=at_events)
    chosen = sampling.top_up(strata, at_events, n, seed)
    cols = [*KEY, "label"]
    sample = positives.select(*cols).unionByName(chosen.select(*cols)).unionByName(sampling.sample_n(at_safe, n, seed).select(*cols))
    frame = sampling.training_frame(sample, stack)
    return sampling.impute_median(frame, sampling.FEATURES)


LEARNERS = {"forest": models.random_forest, "boosting": models.gradient_boosting}
# Weights as in the reference settings: the forest balances classes, boosting weighs positives.
WEIGHING = {"forest": "balanced", "boosting": "positive"}


def batch_training(stack: DataFrame, label: DataFrame, n: int = 2000, seed: int = 42, folds: int = 5, learners: dict[str, dict] | None = None,
                   save_to: str | None = None, site_order: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sample all sites, cross-validate every learner by spatial blocks, fit each on all rows and save it.

    ``learners`` maps names of :data:`LEARNERS` to parameters; ``site_order`` (site, site_id) adds ``site_id``.  Returns ``frame`` (training
    table), ``metrics`` (per model and fold, fold NULL for all rows), ``summary`` (mean and deviation of the fold AUC, ``best``)
    and ``importance``.  Models go to ``save_to/<name>`` with the fitted medians and scaler.
    """
    frame = settle(sampling.merge_sites([training_sample(stack, label, n, seed)], site_order))
    ready, fitted = models.prepare(frame)
    names = [f for f in X.model_features() if f in ready.columns]
    blocks = settle(X.group_folds(X.spatial_blocks(ready), folds))
    tables, importance = [], []
    for name, params in (learners or {k: {} for k in LEARNERS}).items():
        build = lambda: LEARNERS[name](names, **params)  # noqa: B023, E731  called before the next turn
        scored, model = models.cross_fit(blocks, build, folds, weigh=WEIGHING[name])
        scored = settle(scored)
        both = metrics.fold_metrics(scored, y="label").unionByName(metrics.overall_metrics(scored, y="label"))
        tables.append(settle(both.withColumn("model", F.lit(name))))
        importance.append(models.feature_importance(model, names, stack.sparkSession, name=name))
        if save_to:
            models.save_model(model, fitted, f"{save_to}/{name}")
    measured, ranked = tables[0], importance[0]
    for t, i in zip(tables[1:], importance[1:]):
        measured, ranked = measured.unionByName(t), ranked.unionByName(i)
    summary = metrics.cv_summary(measured.filter("fold IS NOT NULL"))
    return {"frame": frame, "metrics": measured, "summary": attach_single(summary, metrics.best_model(summary)), "importance": ranked}


def predict(requests: DataFrame, candidates: DataFrame, scored: DataFrame, sites: DataFrame, weather: DataFrame, baselines: Sequence = (),
            site_boxes: DataFrame | None = None) -> DataFrame:
    """Risk row per request; every request keeps its row.

    ``requests``: place, hours and optionally west, south, east, north of a box, which then stands for the place;
    ``sites``: place, [hours,] site; ``weather``: place, [hours,] rainfall_mm_h (see :func:`terravane.operators.feeds.rain_for`);
    ``site_boxes``: site, west, south, east, north: a box request takes the site it overlaps most, the place's where it overlaps none.
    A request without weather takes the default rain.

    ``score_source`` is 'site' for the score of the request's own site, else 'hour0' for that of the same place at hour 0 (where ``sites`` has
    hours), else 'baseline' for the first of the sites in ``baselines`` that has one, else 'none': such a row has no score, no risk and no
    level.  ``matched`` is 'unmatched' where neither a box nor a place was found; such a row has no risk either.
    """
    edges = ["west", "south", "east", "north"]
    boxed = all(e in requests.columns for e in edges)
    given = F.col("west").isNotNull() & F.col("south").isNotNull() & F.col("east").isNotNull() & F.col("north").isNotNull() if boxed else F.lit(False)
    keep = [c for c in requests.columns if c not in edges]
    own = {f"_{e}": F.col(e).cast("double") if boxed else F.lit(None).cast("double") for e in edges}
    placed = W.resolve_place(requests.withColumns({"_boxed": given, **own}).drop(*edges), candidates).drop("bbox", "display_name")
    centre = lambda low, high, found: F.when(F.col("_boxed"), (F.col(low) + F.col(high)) / 2).otherwise(F.col(found))
    placed = placed.withColumns({
        "lat": centre("_south", "_north", "lat"), "lon": centre("_west", "_east", "lon"),
        "matched": F.when(F.col("_boxed"), F.lit("box")).otherwise(F.col("matched")),
    })
    scores = settle(risk_ops.site_scores(scored).select("site", "score", "confidence"))
    by_hour = "hours" in sites.columns
    at = placed.join(sites.select("place", *(["hours"] if by_hour else []), "site"), ["place", *(["hours"] if by_hour else [])], "left")
    if by_hour:
        start = sites.filter("hours = 0").groupBy("place").agg(F.min("site").alias("_site0"))
        at = at.join(start, "place", "left")
    else:
        at = at.withColumn("_site0", F.lit(None).cast(sites.schema["site"].dataType))
    if site_boxes is not None and boxed:
        met = site_of_box(placed.filter("_boxed").select(*[F.col(f"_{e}").alias(e) for e in edges]), site_boxes)
        met = met.select(*[F.col(e).alias(f"_{e}") for e in edges], F.col("site").alias("_box_site"))
        at = at.join(met, [f"_{e}" for e in edges], "left").withColumn("site", F.coalesce("_box_site", "site")).drop("_box_site")
    joined = W.join_scores_weather(at, scores, weather)
    zero = scores.select(F.col("site").alias("_site0"), F.struct(F.col("score").alias("s"), F.col("confidence").alias("c")).alias("_zero"))
    joined = joined.join(zero, "_site0", "left")
    if baselines:
        rank = F.array_position(F.array(*[F.lit(b) for b in baselines]), F.col("site"))
        first = scores.filter(rank > 0).agg(F.min_by(F.struct(F.col("score").alias("s"), F.col("confidence").alias("c")), rank).alias("_base"))
        joined = attach_single(joined, first)
    else:
        joined = joined.withColumn("_base", F.lit(None).cast("struct<s:double,c:double>"))
    found = F.col("matched") != "unmatched"
    source = F.when(F.col("score").isNotNull(), "site").when(F.col("_zero.s").isNotNull(), "hour0").when(F.col("_base.s").isNotNull(), "baseline").otherwise("none")
    score = F.coalesce("score", "_zero.s", "_base.s")
    rain = F.coalesce(F.col("rainfall_mm_h"), F.lit(K.DEFAULT_CONDITIONS["rainfall_mm_h"]))
    active = score * R.weather_severity(rain)
    around = G.box_around(F.col("lon"), F.col("lat"))
    box = {e: F.when(F.col("_boxed"), F.col(f"_{e}")).otherwise(around[e]) for e in edges}
    name = F.when(F.col("_boxed"), F.concat(G.custom_site_name(F.col("lat"), F.col("lon")), F.lit("_"), F.col("hours").cast("string"), F.lit("h"))).otherwise(
        K.safe_name(F.col("place"), F.col("hours")))
    tenth = lambda e: F.when(found, F.floor(e * 10 + 0.5) / 10.0)
    return joined.select(
        *keep, "matched", F.when(found, name).alias("site_name"), "site", *[e.alias(k) for k, e in box.items()], F.when(found, source).alias("score_source"),
        tenth(score).alias("terrain_vulnerability"), tenth(active).alias("active_risk_score"),
        tenth(F.coalesce("confidence", "_zero.c", "_base.c")).alias("confidence_score"),
        F.when(found & score.isNotNull(), R.risk_level(active)).alias("risk_level"), F.when(found, rain).alias("rainfall_mm_h"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Runs ``(site, ok, seconds)`` with readable times and the totals of the batch."""
    totals = runs.agg(
        F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("successful"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    return attach_single(runs.select("site", "ok", K.elapsed_text(F.col("seconds")).alias("elapsed")), totals)


def site_names(order: Sequence[str], spark) -> DataFrame:
    """Site order table for :func:`terravane.operators.sampling.merge_sites`."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(order)], "site string, site_id int")
