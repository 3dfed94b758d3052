"""Spherical distance and grid arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorlake import constants as K


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, arcsine form."""
    a = F.least(_half_chord(lat1, lon1, lat2, lon2), F.lit(1.0))
    return 2 * K.EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def haversine_km_atan2(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, two-argument arctangent form."""
    a = F.least(_half_chord(lat1, lon1, lat2, lon2), F.lit(1.0))
    return K.EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cell_row(lat: Column) -> Column:
    return F.floor((lat - K.LAT_MIN) / K.STEP).cast("int")


def cell_col(lon: Column) -> Column:
    return F.floor((lon - K.LON_MIN) / K.STEP).cast("int")


def cell_no(lat: Column, lon: Column) -> Column:
    """Row-major cell number; NULL outside the half-open grid box."""
    i, j = cell_row(lat), cell_col(lon)
    inside = i.between(0, K.N_LAT - 1) & j.between(0, K.N_LON - 1)
    return F.when(inside, i * K.N_LON + j)


def center_lat(number: Column) -> Column:
    return K.LAT_MIN + F.floor(number / K.N_LON) * K.STEP + K.STEP / 2


def center_lon(number: Column) -> Column:
    return K.LON_MIN + (number % K.N_LON) * K.STEP + K.STEP / 2


def cell_id(lat: Column, lon: Column) -> Column:
    """Stable id from centre coordinates: tenths of a degree, rounded half-even."""
    lat10 = F.bround(lat * 10, 0).cast("int")
    lon10 = F.bround(lon * 10, 0).cast("int")
    return F.translate(F.format_string("C%+03d_%+04d", lat10, lon10), "+-", "pm")


def id_center(cell: Column, part: int) -> Column:
    """Latitude (part 0) or longitude (part 1) written in an id, old or new form."""
    token = F.regexp_extract(cell, r"^C([pm]?\d+)_([pm]?\d+)$", part + 1)
    sign = F.when(F.substring(token, 1, 1) == "m", -1.0).otherwise(1.0)
    modern = sign * F.regexp_replace(token, "[pm]", "").try_cast("int") / 10.0
    legacy = F.regexp_extract(cell, r"^C_([-+]?[\d.]+)_([-+]?[\d.]+)$", part + 1).try_cast("double")
    return F.when(token != "", modern).otherwise(legacy)


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def macro_region(lat: Column, lon: Column) -> Column:
    """First macro box that holds the point, in declared order; NULL elsewhere."""
    chain = None
    for name, lat_min, lon_min, lat_max, lon_max in K.MACRO_BOXES:
        test = in_box(lat, lon, lat_min, lat_max, lon_min, lon_max)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain
