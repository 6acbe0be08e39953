"""Distances, bearings and a tabular lunar calendar, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def lunar(day: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of the tabular Islamic calendar: thirty-year cycles of 10,631 days, from Julian day 1948440."""
    n = F.datediff(day, F.lit("1970-01-01")) + 2440588 - 1948440
    cycle, rest = F.floor(n / 10631), F.pmod(n, F.lit(10631))
    year_in = F.floor((rest + 0.1335) / (10631.0 / 30))
    in_year = rest - F.floor((11 * year_in + 3) / 30) - 354 * year_in
    fix = F.when(in_year < 0, -1).otherwise(0)
    y = year_in + fix
    in_year = rest - F.floor((11 * y + 3) / 30) - 354 * y
    month = F.least(F.lit(11), F.floor((in_year + 0.99) / 29.5))
    return (cycle * 30 + y + 1).cast("long"), (month + 1).cast("long"), (in_year - F.floor(29.5 * month + 0.5) + 1).cast("long")


def decimal_year(day: Column) -> Column:
    """A date as a year with the share of it that is over."""
    year = F.year(day)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return year + (F.dayofyear(day) - 1) / F.when(leap, 366.0).otherwise(365.0)


def zone(angle: Column) -> Column:
    """One of eight compass zones."""
    return F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.floor((angle + 22.5) / 45) % 8 + 1).cast("int"))


def within(places: DataFrame, lat: float, lon: float, radius: float, near: float) -> DataFrame:
    """places (id, name, lat, lon) with km, within a radius; of one name those go that lie near a nearer one.

    Neighbours are found in a grid whose cells are as wide as near, so names with many places stay cheap.
    """
    k = places.withColumn("km", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)), 4)).filter(F.col("km") <= radius)
    step = near / 111.0
    row = F.floor(F.col("lat") / step)
    wide = F.lit(step) / F.greatest(F.lit(0.02), F.cos(F.radians(F.least(F.lit(88.9), F.abs(row * step) + 1))))
    around = F.sequence(F.lit(-1), F.lit(1))
    rows = k.withColumn("_row", F.explode(F.transform(around, lambda d: row + d)))
    width = F.lit(step) / F.greatest(F.lit(0.02), F.cos(F.radians(F.least(F.lit(88.9), F.abs(F.col("_row") * step) + 1))))
    spread = rows.withColumn("_col", F.explode(F.transform(around, lambda d: F.floor(F.col("lon") / width) + d)))
    own = k.withColumn("_row", row).withColumn("_col", F.floor(F.col("lon") / wide))
    a, e = own.alias("a"), spread.alias("e")
    closer = (F.col("e.km") < F.col("a.km")) | ((F.col("e.km") == F.col("a.km")) & (F.col("e.id") < F.col("a.id")))
    met = a.join(e, (F.col("a.name") == F.col("e.name")) & (F.col("a._row") == F.col("e._row")) & (F.col("a._col") == F.col("e._col")) & closer)
    gone = met.filter(haversine(F.col("a.lat"), F.col("a.lon"), F.col("e.lat"), F.col("e.lon")) <= near).select(F.col("a.id").alias("id")).distinct()
    return k.join(gone, "id", "left_anti")
