"""Parsing of JSON and XML feeds into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_READING = "struct<waterLevel:string,storagePercentage:string,spillwayRelease:string,inflow:string,rainfall:string>"
DAM = (
    "struct<name:string,damName:string,latitude:string,lat:string,longitude:string,lon:string,"
    "districtAlias:string,redLevel:string,red_level:string,orangeLevel:string,orange_level:string,blueLevel:string,blue_level:string,"
    "FRL:string,fullReservoirLevel:string,full_level:string,district:string,"
    "waterLevel:string,current_level:string,storagePercentage:string,spillwayRelease:string,inflow:string,rainfall:string,"
    f"data:array<{_READING}>>"
)
RSS = "channel struct<item:array<struct<title:string,description:string,pubDate:string,link:string>>>"
HOURLY = (
    "hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,"
    "precipitation:array<double>,weather_code:array<int>,wind_speed_10m:array<double>>"
)


def read_dam_feed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per dam of feeds whose root is a list or ``{"dams": [...]}``.

    A source that failed (NULL or unreadable text) contributes no rows.
    """
    # The alias "District" differs from "district" in case only, which column names cannot.
    text = F.regexp_replace(F.trim(F.col(body)), r'(?<!\\)"District"\s*:', '"districtAlias":')
    listed = F.from_json(text, f"array<{DAM}>")
    nested = F.from_json(text, f"struct<dams:array<{DAM}>>")["dams"]
    dams = F.when(text.startswith("["), listed).otherwise(nested)
    keep = [c for c in bodies.columns if c != body]
    return bodies.select(*keep, F.inline(dams))


def read_alert_rss(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS documents in feed order; missing texts are ''."""
    keep = [c for c in bodies.columns if c != body]
    parsed = bodies.select(*keep, F.posexplode(F.from_xml(F.col(body), RSS, {"rowTag": "rss"})["channel"]["item"]).alias("pos", "item"))
    text = lambda k: F.coalesce(F.trim(F.col(f"item.{k}")), F.lit("")).alias(k)
    return parsed.select(*keep, "pos", text("title"), text("description"), text("pubDate"), text("link"))


def explode_hourly(responses: DataFrame, hourly: str = "hourly", times: str = "time") -> DataFrame:
    """Parallel arrays of a struct -> one row per hour, all other columns kept."""
    fields = [f.name for f in responses.schema[hourly].dataType.fields]
    keep = [c for c in responses.columns if c != hourly]
    zipped = F.arrays_zip(*[F.col(f"{hourly}.{f}").alias(f) for f in fields])
    return responses.select(*keep, F.inline(zipped))


def parse_weather(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON weather responses -> one row per place and hour."""
    keep = [c for c in bodies.columns if c != body]
    return explode_hourly(bodies.select(*keep, F.from_json(body, f"struct<{HOURLY.replace(' struct', ':struct')}>")["hourly"].alias("hourly")))
