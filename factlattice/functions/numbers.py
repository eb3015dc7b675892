"""Numbers, units, booleans and small statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlattice.functions.text import comparison_key

# Fixed values: (dimension, factor to base, offset) of each unit; temperature is affine.
UNITS = {
    "BTU/h": ("power", 0.29307107017222, 0.0), "kBTU/h": ("power", 293.07107017222, 0.0), "ton": ("power", 3516.85284206664, 0.0),
    "W": ("power", 1.0, 0.0), "kW": ("power", 1000.0, 0.0),
    "g": ("mass", 0.001, 0.0), "kg": ("mass", 1.0, 0.0), "oz": ("mass", 0.028349523125, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "mm": ("length", 0.001, 0.0), "cm": ("length", 0.01, 0.0), "m": ("length", 1.0, 0.0), "in": ("length", 0.0254, 0.0),
    "ft": ("length", 0.3048, 0.0),
    "CFM": ("flow", 0.00047194745, 0.0), "L/s": ("flow", 0.001, 0.0), "m3/h": ("flow", 1 / 3600, 0.0),
    "V": ("voltage", 1.0, 0.0), "kV": ("voltage", 1000.0, 0.0), "mV": ("voltage", 0.001, 0.0),
    "°C": ("temperature", 1.0, 273.15), "°F": ("temperature", 5 / 9, 255.3722222222222), "K": ("temperature", 1.0, 0.0),
}
TRUE_WORDS = ("true", "yes", "y", "1", "on", "included", "standard", "equipped", "available")  # fixed values
FALSE_WORDS = ("false", "no", "n", "0", "off", "excluded", "not included", "unavailable")  # fixed values


def js_round(c: Column, digits: int = 0) -> Column:
    """Half up towards plus infinity, as ECMAScript rounds: -2.5 gives -2."""
    f = 10.0**digits
    return F.floor(c * f + 0.5) / f


def parse_decimal(c: Column, group: str = ",", point: str = ".") -> Column:
    """A number written strictly with one group sign and one decimal sign; null for anything else."""
    g, p = "\\" + group, "\\" + point
    ok = c.rlike(rf"^[+-]?([0-9]+|[0-9]{{1,3}}({g}[0-9]{{3}})+)({p}[0-9]+)?$")
    return F.when(ok, F.replace(F.replace(c, F.lit(group), F.lit("")), F.lit(point), F.lit(".")).try_cast("double"))


def convert(value: Column, source: Column, target: str) -> Column:
    """``value`` of the unit named in ``source`` in ``target``; null for an unknown unit or another dimension."""
    dimension, factor, offset = UNITS[target]
    out = F.lit(None).cast("double")
    for unit, (d, f, o) in UNITS.items():
        if d == dimension:
            out = F.when(source == unit, (value * F.lit(f) + F.lit(o - offset)) / F.lit(factor)).otherwise(out)
    return out


def parse_boolean(c: Column) -> Column:
    key = comparison_key(c)
    return F.when(key.isin(*TRUE_WORDS), True).when(key.isin(*FALSE_WORDS), False)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; null for no trials."""
    n, p = total.cast("double"), successes / total
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(total > 0, (centre - spread) / scale), F.when(total > 0, (centre + spread) / scale)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where a denominator is 0."""
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r))
