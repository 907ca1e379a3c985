"""Sensor and target registry: lookups, insert-if-absent and cascading deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ingest import first_by_arrival, only_new

#: Hex digits of the key hash that number the slices used to assign ids.
_SLICE_DIGITS = 3


class NotFoundError(LookupError):
    """The registry holds no such row."""


def sensor_by_serial(sensor: DataFrame, serial: str) -> DataFrame:
    return sensor.where(F.col("serial_number") == serial).select("serial_number", "sample_frequency")


def sensor_id_by_serial(sensor: DataFrame, serial: str) -> int:
    row = sensor.where(F.col("serial_number") == serial).select("id").first()
    if row is None:
        raise NotFoundError(serial)
    return row.id


def lookup(serials: DataFrame, sensor: DataFrame) -> DataFrame:
    """Id and frequency for every requested serial; ``found`` is false where the registry has none."""
    wanted = serials.select("serial_number").distinct()
    return wanted.join(sensor.select("serial_number", "id", "sample_frequency"), "serial_number", "left").select(
        "serial_number", "id", "sample_frequency", F.col("id").isNotNull().alias("found"))


def sensor_list(sensor: DataFrame) -> DataFrame:
    return sensor.select("serial_number")


def target_list(target: DataFrame) -> DataFrame:
    return target.select("name")


def missing_rows(batch: DataFrame, dim: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """First arrival per key of the rows the dimension lacks; rows already there keep their values."""
    return first_by_arrival(only_new(batch, dim, [key]), [key], arrival)


def insert_missing(batch: DataFrame, dim: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """New dimension rows with ids above the ones in use.

    Ids follow the hash order of the key. They are numbered within slices of the hash; a slice's offset
    comes from the counts of the slices before it, so no task sees more than one slice and the offset
    frame has at most 16^3 rows.
    """
    digest = F.md5(F.col(key))
    new = missing_rows(batch, dim, key, arrival).withColumn("__slice", digest.substr(1, _SLICE_DIGITS))
    sizes = new.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    within = W.partitionBy("__slice").orderBy(digest, key)
    return (
        new.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "__slice")
        .select((top + F.col("__offset") + F.col("__rank")).cast(dim.schema["id"].dataType).alias("id"),
                *[c for c in new.columns if c not in ("id", "__slice")])
    )


#: Parent key -> child column, in the order deletes travel (fixed values).
CASCADES = {
    "target": [("sensor", "id", "target_id"), ("target_location", "id", "target_id")],
    "sensor": [("measurement", "id", "sensor_id")],
    "account": [("api_key", "id", "account_id")],
}
QUERY_CASCADE = ["queryid", "datname", "rolname"]


def delete_cascade(frames: Mapping[str, DataFrame], table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """The frames after deleting `doomed` (rows of `table` by id) and everything that refers to them.

    Keys nobody holds delete nothing.
    """
    out = dict(frames)
    gone = {table: doomed.select("id").distinct()}
    todo = [table]
    while todo:
        name = todo.pop(0)
        out[name] = out[name].join(gone[name], "id", "left_anti").select(*frames[name].columns)
        for child, parent_key, child_key in CASCADES.get(name, []):
            if child not in out:
                continue
            lost = gone[name].select(F.col(parent_key).alias(child_key))
            if child in CASCADES:
                gone[child] = frames[child].join(lost, child_key, "left_semi").select("id")
                todo.append(child)
            else:
                out[child] = out[child].join(lost, child_key, "left_anti").select(*frames[child].columns)
    return out


def delete_queries(queries: DataFrame, statements: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete query texts and the statistics that refer to them."""
    return (only_new(queries, doomed, QUERY_CASCADE), only_new(statements, doomed, QUERY_CASCADE))
