"""Location stops, legs, spatial clusters and the event timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions.ordered import with_next, with_row_number

# Observation types that carry a position.
POSITION_TYPES = ["FORENSIC_EXIF_GPS", "LOCATION", "GEO"]
STOP = ["case_id", "stop_id", "city", "country", "lat", "lng", "stop_time", "source_artifact", "source_type", "device"]


def _device(make: Column, model: Column, default: str) -> Column:
    joined = F.trim(F.concat_ws(" ", F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def _place(prefix: str, lat: Column, lon: Column) -> Column:
    return F.format_string(f"{prefix} (%.3f°N, %.3f°E)", F.bround(lat, 3), F.bround(lon, 3))


def image_stops(images: DataFrame) -> DataFrame:
    """Stops of images with GPS: (case_id, artifact_id, latitude, longitude, exif_datetime, device_make, device_model)."""
    located = images.filter("latitude is not null and longitude is not null")
    lat, lon = F.col("latitude"), F.col("longitude")
    return located.select(
        "case_id", F.concat(F.lit("LOC-"), "artifact_id", F.lit("-GPS")).alias("stop_id"),
        _place("Waypoint", lat, lon).alias("city"), F.lit("India").alias("country"),
        lat.alias("lat"), lon.alias("lng"), F.nullif("exif_datetime", F.lit("")).alias("stop_time"),
        F.col("artifact_id").alias("source_artifact"), F.lit("EXIF_GPS").alias("source_type"),
        _device(F.col("device_make"), F.col("device_model"), "Device Camera").alias("device"),
    )


def observation_stops(observations: DataFrame) -> DataFrame:
    """Stops of position observations; numeric times become UTC text, missing ones stay null."""
    names = ["latitude", "longitude", "datetime_created", "city", "country", "device_make", "device_model"]

    def field(name: str) -> Column:
        return F.nullif(F.col(f"_f.{name}"), F.lit(""))

    rows = observations.filter(F.col("observation_type").isin(POSITION_TYPES))
    rows = rows.withColumn("_f", F.from_json("value", ", ".join(f"{name} string" for name in names))).withColumns(
        {"_lat": field("latitude").try_cast("double"), "_lon": field("longitude").try_cast("double"), "_t": field("datetime_created")}
    )
    rows = rows.filter("_lat is not null and _lon is not null")
    numeric = F.col("_t").try_cast("double")
    written = F.date_format(F.timestamp_seconds(F.floor(numeric)), "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "case_id", F.coalesce("observation_id", F.concat(F.lit("LOC-"), "artifact_id", F.lit("-"), F.col("_lat").cast("string"))).alias("stop_id"),
        F.coalesce(field("city"), _place("Cell Tower / GPS", F.col("_lat"), F.col("_lon"))).alias("city"),
        F.coalesce(field("country"), F.lit("India")).alias("country"),
        F.col("_lat").alias("lat"), F.col("_lon").alias("lng"),
        F.when(numeric.isNotNull(), written).otherwise(F.col("_t")).alias("stop_time"),
        F.col("artifact_id").alias("source_artifact"), F.lit("FORENSIC_OBSERVATION").alias("source_type"),
        _device(field("device_make"), field("device_model"), "Mobile Station").alias("device"),
    )


def location_stops(images: DataFrame, observations: DataFrame) -> DataFrame:
    return image_stops(images).unionByName(observation_stops(observations))


def stop_order(stops: DataFrame) -> DataFrame:
    """Position of each stop in its case by time text, untimed stops last."""
    order = [F.col("stop_time").asc_nulls_last(), F.asc("stop_id")]
    return with_row_number(stops, ["case_id"], order, "stop_index")


def routes(stops: DataFrame) -> DataFrame:
    """Legs between consecutive timed stops with different times; ids carry the stop position."""
    timed = stop_order(stops.filter(F.col("stop_time").isNotNull()))
    following = {"to_city": "city", "to_lat": "lat", "to_lng": "lng", "arrival": "stop_time"}
    legs = with_next(timed, ["case_id"], [F.asc("stop_index")], following)
    moved = legs.filter(F.col("arrival").isNotNull() & (F.col("arrival") != F.col("stop_time")))
    return moved.select(
        "case_id", F.concat(F.lit("ROUTE-"), F.col("stop_index").cast("string")).alias("route_id"),
        F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"), "to_lat", "to_lng",
        F.col("city").alias("from_city"), "to_city",
        F.concat("city", F.lit(" → "), "to_city").alias("label"),
        F.col("stop_time").alias("departure"), "arrival",
    )


def grid_cell(value: Column, size: float = 5.0) -> Column:
    return (F.bround(value / F.lit(size), 0) * F.lit(size)).cast("long")


def grid_clusters(stops: DataFrame, size: float = 5.0) -> DataFrame:
    """Cells with more than one stop: mean centre and count, numbered by first appearance in time."""
    cells = stops.withColumn("lat_cell", grid_cell(F.col("lat"), size)).withColumn("lng_cell", grid_cell(F.col("lng"), size))
    first = F.min(F.struct(F.col("stop_time").isNull().alias("late"), "stop_time", "stop_id", "country")).alias("first")
    grouped = cells.groupBy("case_id", "lat_cell", "lng_cell").agg(
        F.avg("lat").alias("center_lat"), F.avg("lng").alias("center_lng"), F.count(F.lit(1)).alias("count"), first
    ).filter("count > 1")
    numbered = with_row_number(grouped, ["case_id"], [F.asc("first"), F.asc("lat_cell"), F.asc("lng_cell")], "n")
    number = F.col("n").cast("string")
    return numbered.select(
        "case_id", F.concat(F.lit("CLUST-"), number).alias("cluster_id"),
        F.concat(F.lit("Regional Cluster "), number, F.lit(" ("), "first.country", F.lit(")")).alias("name"),
        "lat_cell", "lng_cell", "center_lat", "center_lng", "count",
    )


def cluster_members(stops: DataFrame, clusters: DataFrame, size: float = 5.0) -> DataFrame:
    """Stops with the cluster they fall in."""
    cells = stops.withColumn("lat_cell", grid_cell(F.col("lat"), size)).withColumn("lng_cell", grid_cell(F.col("lng"), size))
    return cells.join(clusters.select("case_id", "cluster_id", "lat_cell", "lng_cell"), ["case_id", "lat_cell", "lng_cell"]).select(
        "case_id", "cluster_id", "stop_id"
    )


def manual_stop(stops: DataFrame, requests: DataFrame, default_time: str) -> DataFrame:
    """Requested stops (case_id, city, country, lat, lng, stop_time) with the next free manual ids.

    Requests of one case are numbered by time, city and place.
    """
    counts = stops.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    ordered = with_row_number(requests, ["case_id"], ["stop_time", "city", "lat", "lng"], "request")
    numbered = ordered.join(counts, "case_id", "left")
    ident = F.concat(F.lit("LOC-MANUAL-"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("request")).cast("string"))
    return numbered.select(
        "case_id", ident.alias("stop_id"), "city", F.coalesce("country", F.lit("India")).alias("country"),
        "lat", "lng", F.coalesce("stop_time", F.lit(default_time)).alias("stop_time"),
        F.lit("MANUAL").alias("source_artifact"), F.lit("MANUAL_ENTRY").alias("source_type"), F.lit("Manual Entry").alias("device"),
    )


def timeline_events(sources: dict[str, DataFrame]) -> DataFrame:
    """Events of several kinds, each (case_id, event_id, event_time, description), on one axis."""
    parts = [
        df.select("case_id", F.lit(kind).alias("event_kind"), "event_id", "event_time", "description")
        for kind, df in sources.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.filter(F.col("event_time").isNotNull())
