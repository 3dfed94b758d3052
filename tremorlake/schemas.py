"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

EVENT = StructType([
    StructField("event_id", StringType()), StructField("time", TimestampType()), StructField("lat", DoubleType()),
    StructField("lon", DoubleType()), StructField("depth", DoubleType()), StructField("magnitude", DoubleType()),
    StructField("mag_type", StringType()), StructField("source", StringType()), StructField("place", StringType())])
EVENT_COLUMNS = [f.name for f in EVENT]

FEED_GEOJSON = ("features array<struct<id: string, geometry: struct<type: string, coordinates: array<double>>, "
                "properties: struct<mag: double, magType: string, place: string, time: bigint>>>")
FEED_FDSN = ("features array<struct<id: string, geometry: struct<coordinates: array<double>>, "
             "properties: struct<time: string, origintime: string, mag: double, magnitude: double, depth: double, "
             "magtype: string, mag_type: string, source_id: string, unid: string, flynn_region: string, "
             "region: string, place: string>>>")
AGENCY_RECORD = "map<string, string>"  # spellings of the keys vary, also by case only
