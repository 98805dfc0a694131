"""Weather series, reservoir levels, alerts and place names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.functions import feeds as K
from terravane.functions.grids import in_region
from terravane.operators.joins import attach
from terravane.operators.lines import SEGMENT, with_halo
from terravane.operators.places import first_named
from terravane.operators.ranks import running_sums

DAY = 86400
# Rivers with centre and box, in order of preference.
RIVERS = [
    ("periyar", 10.05, 76.60, "Periyar River Basin, Kerala, India", (76.10, 9.75, 77.10, 10.25)),
    ("pamba", 9.35, 76.65, "Pamba River Basin, Kerala, India", (76.35, 9.20, 77.05, 9.55)),
    ("pumba", 9.35, 76.65, "Pamba River Basin, Kerala, India", (76.35, 9.20, 77.05, 9.55)),
    ("bharathapuzha", 10.80, 76.20, "Bharathapuzha (Nila) River Basin, Kerala, India", (75.90, 10.60, 76.70, 10.95)),
    ("nila", 10.80, 76.20, "Bharathapuzha (Nila) River Basin, Kerala, India", (75.90, 10.60, 76.70, 10.95)),
    ("chaliyar", 11.20, 76.00, "Chaliyar River Basin, Kerala, India", (75.75, 11.10, 76.30, 11.45)),
    ("chalakudy", 10.30, 76.40, "Chalakudy River Basin, Kerala, India", (76.15, 10.20, 76.75, 10.45)),
    ("muvattupuzha", 9.98, 76.55, "Muvattupuzha River Basin, Kerala, India", (76.30, 9.80, 76.90, 10.10)),
    ("meenachil", 9.68, 76.58, "Meenachil River Basin, Kerala, India", (76.40, 9.55, 76.85, 9.80)),
    ("kallada", 9.00, 76.75, "Kallada River Basin, Kerala, India", (76.55, 8.90, 77.15, 9.15)),
]


# ---- weather --------------------------------------------------------------------
def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def series_index(hourly: DataFrame, by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    """Add ``idx``, the 0-based position in the series, and its length ``n``."""
    on = hourly.withColumn("_s", _seconds(F.col(ts)))
    order = running_sums(on.select(*by, "_s").distinct(), by, "_s", {"k": F.lit(1)}, descending=False)
    pos = order.select(*by, "_s", (F.col("cum_k") - 1).alias("idx"), F.col("all_k").alias("n"))
    return on.join(pos, [*by, "_s"]).drop("_s")


def current_index(hourly: DataFrame, now, by: Sequence[str] = ("station",), ts: str = "hour", floor: bool = False) -> DataFrame:
    """Position of ``now`` in each series, 0 if it is not an hour of the series.

    ``now`` is a literal or a Column of ``hourly``; ``floor`` cuts it to the hour.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    at = F.date_trunc("hour", at) if floor else at.cast("timestamp")
    hour = F.col(ts).cast("timestamp")
    return hourly.groupBy(*by).agg(
        F.max(hour == at).alias("_found"), F.sum(F.when(hour < at, 1).otherwise(0)).alias("_before")
    ).select(*by, F.when(F.col("_found"), F.col("_before")).otherwise(F.lit(0)).alias("base_idx"))


def forecast_at(hourly: DataFrame, now, hours: int, defaults: dict[str, object], by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    """Values ``hours`` after ``now``, at most the last hour; NULL -> default."""
    base = current_index(hourly, now, by, ts)
    series = attach(series_index(hourly, by, ts), base, by)
    at = F.greatest(F.lit(0), F.least(F.col("base_idx") + hours, F.col("n") - 1))
    return series.filter(F.col("idx") == at).select(
        *by, "idx", ts, *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()]
    )


def peak_rain(hourly: DataFrame, rain: str = "rain_mm_h", before: int = 12, after: int = 12, by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    """Add ``peak``: maximum over rows [i - before, i + after); 0 if empty."""
    series = series_index(hourly, by, ts)
    w = W.partitionBy(*by, "_seg").orderBy("idx").rangeBetween(-before, after - 1)
    halo = with_halo(series, "idx", max(before, after), SEGMENT)
    return halo.withColumn("peak", F.coalesce(F.max(rain).over(w), F.lit(0.0))).filter("_seg = _own").drop("_seg", "_own", "n")


def rain_for(requests: DataFrame, hourly: DataFrame, now, current: DataFrame | None = None, rain: str = "rain_mm_h", reach: int = 12,
             by: str = "station", ts: str = "hour") -> DataFrame:
    """Rain per ``(by, hours)`` of ``requests``: for 0 hours the larger of the ``current`` reading ``(by, rain_instant_mm_h)`` and the
    hour's rain, later the peak of ``reach`` hours around the hour asked for, at most the last one.

    Requests of a series that does not exist have no row.
    """
    base = current_index(hourly, now, (by,), ts)
    peaks = peak_rain(hourly, rain, reach, reach, (by,), ts).select(by, "idx", F.coalesce(F.col(rain), F.lit(0.0)).alias("_rain"), "peak")
    ends = peaks.groupBy(by).agg(F.max("idx").alias("_end")).join(base, by)
    asked = requests.select(by, "hours").distinct().join(ends, by).withColumn(
        "idx", F.greatest(F.lit(0), F.least(F.col("base_idx") + F.col("hours"), F.col("_end"))))
    found = asked.join(peaks, [by, "idx"])
    instant = F.lit(0.0)
    if current is not None:
        found = found.join(current.groupBy(by).agg(F.max("rain_instant_mm_h").alias("_instant")), by, "left")
        instant = F.coalesce(F.col("_instant"), F.lit(0.0))
    return found.select(by, "hours", F.when(F.col("hours") == 0, F.greatest(instant, F.col("_rain"))).otherwise(F.col("peak")).alias("rainfall_mm_h"))


def antecedent_rain(hourly: DataFrame, rain: str = "rain_mm_h", hours: int = 48, by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    """Add the rain of the ``hours`` before each hour and its mean intensity."""
    reach = hours * 3600
    on = hourly.withColumn("_s", _seconds(F.col(ts)))
    w = W.partitionBy(*by, "_seg").orderBy("_s").rangeBetween(-reach, -1)
    # Segments of 30 days with a halo: no task holds the whole series of a station.
    out = with_halo(on, "_s", reach, 30 * DAY).withColumn("rain_before", F.coalesce(F.sum(rain).over(w), F.lit(0.0)))
    return out.filter("_seg = _own").withColumn("intensity", F.col("rain_before") / float(hours)).drop("_seg", "_own", "_s")


def daily_total(hourly: DataFrame, rain: str = "rain_mm_h", by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    return hourly.groupBy(*by, F.to_date(F.col(ts)).alias("day")).agg(F.sum(rain).alias("daily_total_mm"))


def first_day_total(hourly: DataFrame, rain: str = "rain_mm_h", by: Sequence[str] = ("station",), ts: str = "hour") -> DataFrame:
    return daily_total(hourly, rain, by, ts).groupBy(*by).agg(F.min_by("daily_total_mm", "day").alias("daily_total_mm"))


def source_priority(places: DataFrame, answers: DataFrame, order: Sequence[str], by: Sequence[str] = ("place",)) -> DataFrame:
    """Per place the answer of the first provider of ``order``, else the fixed
    defaults (source 'fallback').  Current rain is the larger of instant and hourly."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(order):
        rank = F.when(F.col("source") == name, F.lit(i)).otherwise(rank)
    numbers = [k for k, v in K.DEFAULT_CONDITIONS.items() if isinstance(v, float)]
    values = [*numbers, "description", "source"]
    ranked = answers.withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn(
        "rainfall_mm_h", F.greatest(F.col("rainfall_mm_h"), F.col("rain_instant_mm_h")))
    # Two answers of one provider: the smaller values, whatever the order of the rows.
    best = ranked.groupBy(*by).agg(F.min(F.struct("_rank", F.struct(*values).alias("b"))).alias("_m")).select(*by, "_m.b")
    out = places.select(*by).join(best, list(by), "left")
    default = lambda k: F.lit("fallback") if k == "source" else F.lit(K.DEFAULT_CONDITIONS[k])
    return out.select(*by, *[F.coalesce(F.col(f"b.{k}"), default(k)).alias(k) for k in values])


# ---- reservoirs -----------------------------------------------------------------
def normalise_dams(dams: DataFrame) -> DataFrame:
    """Alias fields and the newest nested reading -> one flat row per dam."""

    def first_of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    newest = F.get("data", F.lit(0))

    def reading(name: str, default: str | None = None) -> Column:
        parts = [F.nullif(newest[name], F.lit("")), F.nullif(F.col(name), F.lit(""))]
        if name == "waterLevel":
            parts.append(F.nullif(F.col("current_level"), F.lit("")))
        return F.coalesce(*parts, *([F.lit(default)] if default is not None else []))

    flat = dams.select(
        F.coalesce(first_of("name", "damName"), F.lit("Unknown")).alias("name"),
        F.coalesce(first_of("district", "districtAlias"), F.lit("")).alias("district"),
        K.number(reading("waterLevel")).alias("current_level"),
        K.number(first_of("FRL", "fullReservoirLevel", "full_level")).alias("full_level"),
        K.number(reading("storagePercentage")).alias("storage_pct"),
        K.number(reading("spillwayRelease", "0")).alias("spillway_release"),
        K.number(reading("inflow", "0")).alias("inflow"),
        K.number(reading("rainfall", "0")).alias("rainfall"),
        K.number(first_of("latitude", "lat")).alias("lat"),
        K.number(first_of("longitude", "lon")).alias("lon"),
        K.number(first_of("redLevel", "red_level")).alias("_red"),
        K.number(first_of("orangeLevel", "orange_level")).alias("_orange"),
        K.number(first_of("blueLevel", "blue_level")).alias("_blue"),
    )
    alert = K.dam_alert(F.col("current_level"), F.col("_red"), F.col("_orange"), F.col("_blue"))
    return flat.withColumn("alert", alert).drop("_red", "_orange", "_blue")


def district_filter(df: DataFrame, district: str | None, col: str = "district") -> DataFrame:
    if not district:
        return df
    return df.filter(F.lower(F.col(col)).contains(district.lower()))


def severity_sort(df: DataFrame, alert: str = "alert", *then) -> DataFrame:
    """RED, ORANGE, BLUE, NORMAL, others; a range-partitioned sort."""
    return df.orderBy(K.alert_rank(F.col(alert)), *then)


# ---- alerts ---------------------------------------------------------------------
def regional_alerts(items: DataFrame, districts: Sequence[str] = tuple(K.DISTRICTS), state: str = K.STATE) -> DataFrame:
    return items.filter(K.is_regional(F.col("title"), tuple(districts), state))


def dedupe_alerts(items: DataFrame, order: str, key: str = "description") -> DataFrame:
    """First item per description in feed order (partial aggregation: a much
    repeated description is reduced before the shuffle)."""
    cols = items.columns
    best = items.groupBy(F.trim(F.col(key)).alias("_key")).agg(F.min_by(F.struct(*cols), F.col(order)).alias("b"))
    return best.select("b.*")


def present_alerts(items: DataFrame) -> DataFrame:
    return items.withColumn("severity", K.alert_severity(F.col("description"))).withColumn(
        "headline", K.alert_title(F.col("title")))


def refresh_window(df: DataFrame, key: str, ts: str, minutes: int, *values: str, tie: str | None = None) -> DataFrame:
    """Latest state per key and refresh window (10 min for alerts, 60 for dams).

    Of readings at one time the one with the largest ``tie`` counts, without it the one with the largest values.
    """
    win = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    order = F.struct(ts, *([tie] if tie else []), *values)
    return df.groupBy(key, win.alias("_w")).agg(
        F.max_by(F.struct(*values), order).alias("b"), F.max(ts).alias("last_ts")
    ).select(key, F.col("_w.start").alias("window_start"), "last_ts", "b.*")


# ---- places ---------------------------------------------------------------------
def resolve_place(queries: DataFrame, candidates: DataFrame, state: str = K.STATE, rivers: Sequence[tuple] | DataFrame = tuple(RIVERS)) -> DataFrame:
    """Place text -> coordinates: a river named in the text, else the first
    candidate naming the state, else the first inside the region, else unmatched.

    ``queries``: ``place``; ``candidates``: ``place, rank, display_name, lat, lon``.  ``rivers``: a short list, or a table ``rank, key, lat, lon,
    display_name, west, south, east, north`` of any length, whose first name in the text counts (ranks are unique).
    """
    if isinstance(rivers, DataFrame):
        spot = F.struct("key", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "display_name",
                        F.array(*[F.col(e).cast("double") for e in ("west", "south", "east", "north")]).alias("bbox"))
        named = first_named(queries, rivers, "place")
        given = named.join(rivers.select(F.col("rank").cast("long").alias("name_rank"), spot.alias("_river")), "name_rank", "left").drop("name_rank")
    else:
        known = F.array(*[
            F.struct(F.lit(k).alias("key"), F.lit(la).alias("lat"), F.lit(lo).alias("lon"), F.lit(d).alias("display_name"),
                     F.array(*[F.lit(x) for x in box]).alias("bbox"))
            for k, la, lo, d, box in rivers
        ])
        text = F.lower(F.trim("place"))
        given = queries.withColumn("_river", F.get(F.filter(known, lambda k: text.contains(k["key"])), F.lit(0)))
    lat, lon = K.number(F.col("lat").cast("string")), K.number(F.col("lon").cast("string"))
    named = F.coalesce(F.lower("display_name").contains(state.lower()), F.lit(False))
    inside = F.coalesce(in_region(lon, lat), F.lit(False))
    order = F.when(named, F.struct(F.lit(0).alias("g"), F.col("rank").cast("long").alias("k"))).when(
        inside, F.struct(F.lit(1).alias("g"), F.col("rank").cast("long").alias("k")))
    found = F.struct(lat.alias("lat"), lon.alias("lon"), "display_name")
    best = candidates.withColumn("_o", order).filter("_o IS NOT NULL").groupBy("place").agg(
        F.min_by(found, F.struct("_o", "display_name", lat, lon)).alias("b"))
    out = given.join(best, "place", "left")
    got = lambda k: F.coalesce(F.col(f"_river.{k}"), F.col(f"b.{k}")).alias(k)
    how = F.when(F.col("_river").isNotNull(), "river").when(F.col("b").isNotNull(), "candidate").otherwise("unmatched")
    return out.select(*queries.columns, got("lat"), got("lon"), got("display_name"), F.col("_river.bbox").alias("bbox"), how.alias("matched"))


def join_scores_weather(places: DataFrame, scores: DataFrame, weather: DataFrame) -> DataFrame:
    """Places with the score of their site and the weather of the place, by ``hours`` where both tables have them.

    Every place stays: a site without score or a place without weather leaves NULL.
    """
    on = ["place", *(["hours"] if "hours" in places.columns and "hours" in weather.columns else [])]
    return places.join(scores, "site", "left").join(weather, on, "left")
