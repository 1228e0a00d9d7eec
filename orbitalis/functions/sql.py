"""The key and duration functions for SQL texts, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orbitalis.functions.keys import _MASKS

_SPREAD = "v"
for _shift, _mask in _MASKS:
    _SPREAD = f"(({_SPREAD} | shiftleft({_SPREAD}, {_shift})) & {_mask}L)" if _SPREAD != "v" else f"((v | shiftleft(v, {_shift})) & {_mask}L)"

_NUMBER = "[+-]?[0-9]*[.]?[0-9]+(e[+-]?[0-9]+)?"

#: name, parameters, result, body; later ones use earlier ones.
FUNCTIONS = (
    ("morton_cell", "x DOUBLE, low DOUBLE, span DOUBLE", "BIGINT", "CAST(least(greatest(floor((x - low) / span * 2097152.0D), 0), 2097151) AS BIGINT)"),
    ("morton_spread", "v BIGINT", "BIGINT", _SPREAD),
    ("morton_key", "ix BIGINT, iy BIGINT, iz BIGINT", "BIGINT", "morton_spread(ix) | shiftleft(morton_spread(iy), 1) | shiftleft(morton_spread(iz), 2)"),
    ("morton_prefix", "k BIGINT, depth INT", "BIGINT", "shiftright(k, 63 - 3 * depth)"),
    ("cell_side", "depth INT, span DOUBLE", "DOUBLE", "span / shiftleft(1L, depth)"),
    ("duration_days", "t STRING", "DOUBLE", f"CASE WHEN lower(trim(t)) RLIKE '^{_NUMBER}[ ]*[hdy]?$' THEN CAST(regexp_extract(lower(trim(t)), '^{_NUMBER}', 0) AS DOUBLE) * CASE right(trim(t), 1) WHEN 'h' THEN 1 / 24D WHEN 'H' THEN 1 / 24D WHEN 'y' THEN 365.25D WHEN 'Y' THEN 365.25D ELSE 1D END END"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
