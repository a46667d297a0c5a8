"""Column to Column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that results do not depend on summation order."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), digits)


def year(col: Column | str) -> Column:
    return F.year(col).cast("bigint")


def day_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def mask_tail(col: Column, n: int = 4, mask: str = "XXXX-XXXX-XXXX-") -> Column:
    """Mask followed by the last ``n`` characters."""
    return F.concat(F.lit(mask), F.right(col, F.lit(n)))


def format_thousands(col: Column, n: int = 1) -> Column:
    """Text with thousands separators, rounded half up."""
    return F.format_number(F.round(col, n), n)


def to_int_rounded(col: Column) -> Column:
    """Integer cast that rounds instead of truncating."""
    return F.round(col).cast("bigint")


def date_part_text(col: Column, pattern: str) -> Column:
    return F.date_format(col, pattern)


def round_to(col: Column, n: int, half_even: bool = False) -> Column:
    return F.bround(col, n) if half_even else F.round(col, n)


def minus_months(col: Column, n: int) -> Column:
    return F.add_months(col, -n)


def parse_mixed_date(col: Column, pivot: int = 50) -> Column:
    """``m/d/yy`` (years from ``pivot`` on are 19xx) or ``yyyy/m/d``; bad text is null."""
    parts = F.split(col, "/")
    a, b, c = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    short = F.make_date(F.when(c >= pivot, c + 1900).otherwise(c + 2000), a, b)
    is_year_first = F.length(F.try_element_at(parts, F.lit(1))) == 4
    return F.when(is_year_first, F.make_date(a, b, c)).otherwise(short)


def century_year(col: Column, pivot: int = 50) -> Column:
    """Year of ``dd-Mon-yy``; two digits above ``pivot`` belong to 19xx."""
    yy = F.right(col, F.lit(2)).try_cast("int")
    return F.when(yy > pivot, yy + 1900).otherwise(yy + 2000)


def year_from_text(col: Column) -> Column:
    """Year of ``mm/dd/yyyy``; null when it is no number."""
    return F.substring(col, 7, 4).try_cast("int")


def floor_year(col: Column) -> Column:
    return F.floor(col).cast("bigint")


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def month_end(col: Column) -> Column:
    return F.last_day(col)


def unpack_hour(col: Column, weekdays: Mapping[int, str] | None = None) -> dict[str, Column]:
    """Hour, day and (with a map) weekday of a packed ``yymmddhh`` integer."""
    out = {"hour_of_day": col % 100, "day": F.floor(col / 100) % 100}
    if weekdays:
        pairs = [F.lit(x) for kv in weekdays.items() for x in kv]
        out["weekday"] = F.try_element_at(F.create_map(*pairs), out["day"].cast("int"))
    return out


def log_shift(col: Column, c: float = 1.0) -> Column:
    return F.log(col + c)


def safe_ratio(a: Column, b: Column, eps: float | None = None) -> Column:
    """a / b; with ``eps`` the divisor is shifted, else a zero divisor gives null."""
    return a / (b + eps) if eps is not None else F.try_divide(a, b)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of a tie, smaller first."""
    return F.least(a, b), F.greatest(a, b)


def snap(col: Column, bounds: Sequence[float], values: Sequence[float]) -> Column:
    """Representative of the range: ``values[i]`` below ``bounds[i]``, the last one above."""
    if len(values) != len(bounds) + 1:
        raise ValueError("one value more than bounds")
    out = F.when(col < bounds[0], F.lit(values[0]))
    for b, v in zip(bounds[1:], values[1:]):
        out = out.when(col < b, F.lit(v))
    return F.when(col.isNotNull(), out.otherwise(F.lit(values[-1])))


def gamma_index(z: Column, mean: Column, sd: Column) -> Column:
    """Gamma quantile of a normal score, shape mean^2/sd^2 and scale sd^2/mean.

    Cube-root normal approximation of the gamma quantile; null when its base is
    negative.
    """
    shape, scale = F.pow(mean / sd, 2), sd * sd / mean
    base = 1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape))
    return F.when(base >= 0, shape * scale * F.pow(base, 3))


EARTH_RADIUS_M = 6_371_000.0


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def epoch_ns_to_ts(col: Column) -> Column:
    """Epoch nanoseconds to a timestamp, without going through double."""
    return F.timestamp_micros(F.call_function("div", col, F.lit(1000).cast("bigint")))


def match_pair(a: Column, b: Column) -> Column:
    """1 when two codes of +1/-1 agree, 0 when they differ."""
    return ((a * b + 1) / 2).cast("int")


def n_rows() -> Column:
    """Row count of a group."""
    return F.count(F.lit(1))


def complement(tech_a: Column, business_a: Column, tech_b: Column, business_b: Column) -> Column:
    """1 when two people (codes 1 = no, 2 = yes) complement each other in at least one skill."""
    return (tech_a * business_b + business_a * tech_b >= 4).cast("int")


# coefficients of the asymptotic series of the digamma function in 1 / z^2
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
DIGAMMA_SHIFT = 8


def digamma(x: Column) -> Column:
    """Derivative of log gamma for positive numbers: recurrence to z >= 8, then the series."""
    z = x + DIGAMMA_SHIFT
    series = sum((F.lit(c) * F.pow(z, -2 * (k + 1)) for k, c in enumerate(DIGAMMA_SERIES)), F.lit(0.0))
    return F.log(z) - 0.5 / z + series - sum((1 / (x + i) for i in range(DIGAMMA_SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    """Derivative of digamma, term by term."""
    z = x + DIGAMMA_SHIFT
    series = sum((F.lit(-2.0 * (k + 1) * c) * F.pow(z, -2 * (k + 1) - 1) for k, c in enumerate(DIGAMMA_SERIES)), F.lit(0.0))
    return 1 / z + 0.5 / (z * z) + series + sum((1 / ((x + i) * (x + i)) for i in range(DIGAMMA_SHIFT)), F.lit(0.0))


# coefficients of the asymptotic series of log gamma in 1 / z
LOG_GAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def falling_sums(a: str, d: str) -> tuple[Column, Column, Column]:
    """Sums of log(a - l), 1 / (a - l) and 1 / (a - l)^2 over l = 0 .. d - 1, for columns a >= d >= 1.

    Differences of log gamma, digamma and trigamma at a + 1 and a - d + 1, taken
    term by term so that nothing cancels where d is small beside a.
    """
    p, q = f"({a} + {1 + DIGAMMA_SHIFT})", f"({a} - {d} + {1 + DIGAMMA_SHIFT})"
    steps = [(f"({a} + {1 + i})", f"({a} - {d} + {1 + i})") for i in range(DIGAMMA_SHIFT)]

    def nested(coefficients, x):  # x * (c0 + x * x * (c1 + ...))
        out = "0d"
        for c in reversed(coefficients):
            out = f"({c!r}d + {x} * {x} * {out})"
        return out

    def gap(coefficients, power):  # of the series in 1 / p and in 1 / q
        return " - ".join(f"{nested(coefficients, f'(1 / {z})')} / {' / '.join([z] * power)}" for z in (p, q))

    ratio = f"(-log1p(-{d} / {p}))"  # log p - log q
    logs = f"{d} * ln({p}) + ({q} - 0.5d) * {ratio} - {d} - " + " - ".join(f"ln({u} / {v})" for u, v in steps)
    first = f"{ratio} + 0.5d * {d} / ({p} * {q}) + " + " + ".join(f"{d} / ({u} * {v})" for u, v in steps)
    second = f"{d} / ({p} * {q}) + 0.5d * {d} * ({p} + {q}) / ({p} * {p} * {q} * {q}) + " + " + ".join(
        f"{d} * ({u} + {v}) / ({u} * {u} * {v} * {v})" for u, v in steps)
    slopes = [2.0 * (k + 1) * c for k, c in enumerate(DIGAMMA_SERIES)]
    return (F.expr(f"{logs} + {gap(LOG_GAMMA_SERIES, 1)}"), F.expr(f"{first} + {gap(DIGAMMA_SERIES, 2)}"),
            F.expr(f"{second} + {gap(slopes, 3)}"))
