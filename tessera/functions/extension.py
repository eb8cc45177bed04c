"""Functions by IRI: `register` adds one; a few of the planar geometry functions are built in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions.columns import BOOLEAN, DOUBLE, Val, lexical
from tessera.namespaces import GEOF

#: IRI -> function of values to a value, on columns only.
FUNCTIONS: dict[str, Callable[[list[Val]], Val]] = {}


def register(iri: str, function: Callable[[list[Val]], Val]) -> None:
    FUNCTIONS[iri] = function


def _point(v: Val, k: int):
    return F.regexp_extract(lexical(v), r"POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)", k).try_cast("double")


def _distance(a: list[Val]) -> Val:
    """Great-circle distance of two WKT points (longitude latitude) in metres."""
    x1, y1, x2, y2 = (F.radians(_point(v, k)) for v in a[:2] for k in (1, 2))
    h = F.pow(F.sin((y2 - y1) / 2), 2) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), 2)
    return Val(F.lit(2 * 6371008.8) * F.asin(F.least(F.sqrt(h), F.lit(1.0))), replace(DOUBLE, nullable=True))


def _equals(a: list[Val]) -> Val:
    return Val((_point(a[0], 1) == _point(a[1], 1)) & (_point(a[0], 2) == _point(a[1], 2)), replace(BOOLEAN, nullable=True))


register(GEOF.distance, _distance)
register(GEOF.sfEquals, _equals)
