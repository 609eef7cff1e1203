"""The library's expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_SQL = {
    "slugify(text STRING) RETURNS STRING": "coalesce(nullif(trim('_' FROM regexp_replace(lower(text), '[^a-z0-9]+', '_')), ''), 'roi')",
    "saturation(value DOUBLE) RETURNS DOUBLE": "-log10(greatest(1 - value, 1e-6))",
    "tile_x(lon DOUBLE, zoom BIGINT) RETURNS BIGINT": "floor((pmod(lon + 180, 360D)) / 360 * pow(2, zoom))",
    "tile_y(lat DOUBLE, zoom BIGINT) RETURNS BIGINT": "floor((1 - asinh(tan(radians(greatest(least(lat, 85.05112878D), -85.05112878D)))) / pi()) / 2 * pow(2, zoom))",
}


@udtf(returnType="tick: bigint, hour: double")
class Ticks:
    """tick and hour of day of every n-th tick from a first to a last one."""

    def eval(self, first: int, last: int, every: int, start_hour: float, tick_minutes: float):
        for tick in range(first, last + 1, every):
            yield tick, (start_hour + tick * tick_minutes / 60.0) % 24.0


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in the session (temporarily); returns their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("sample_ticks", Ticks)
    return [h.split("(")[0] for h in _SQL] + ["sample_ticks"]
