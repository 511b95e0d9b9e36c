"""One column specification shaping both sides of a check.

``"SITE jdate:i mean:d START_DATE:t"`` names the result columns and their kind:
text (default), ``i`` integer, ``d`` double rounded to 6 places (``d3``: 3),
``t`` date as text, ``b`` boolean. Doubles get a nudge of 1.3e-9 before
rounding so that values on a rounding tie, which both engines only know up to
floating-point noise, fall on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUDGE = 1.3e-9


def parse(spec: str) -> list[tuple[str, str, int]]:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        digits = int(kind[1:]) if kind.startswith("d") and len(kind) > 1 else 6
        out.append((name, kind[:1] or "s", digits))
    return out


def rounded(value: Column, digits: int) -> Column:
    """``round`` of a double. Only values near a tie, very large or not finite take Spark's own, which goes through decimal text."""
    scaled = value * F.lit(10.0**digits)
    below = F.floor(scaled)
    tie = F.abs(scaled - below - F.lit(0.5)) < F.lit(1e-3)
    nearest = F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(10.0**digits)
    return F.when((F.abs(value) < F.lit(1e5)) & ~tie, nearest).otherwise(F.round(value, digits))


def shape_frame(df: DataFrame, spec: str) -> DataFrame:
    def cell(name: str, kind: str, digits: int) -> Column:
        c = F.col(name)
        if kind == "d":
            c = rounded(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        return c.alias(name)

    return df.select(*[cell(*item) for item in parse(spec)])


def shape_sql(body: str, spec: str) -> str:
    cells = []
    for name, kind, digits in parse(spec):
        if kind == "d":
            cell = f"round(CAST({name} AS DOUBLE) + 1.3e-9, {digits}) + 0e0"
        elif kind == "i":
            cell = f"CAST({name} AS BIGINT)"
        elif kind == "t":
            cell = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "b":
            cell = f"CAST({name} AS BOOLEAN)"
        else:
            cell = f"CAST({name} AS VARCHAR)"
        cells.append(f"{cell} AS {name}")
    return f"SELECT {', '.join(cells)} FROM ({body}) AS result"
