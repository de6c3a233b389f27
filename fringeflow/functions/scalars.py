"""Element-wise expressions on phases, angles, dates and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light over the C-band radar's frequency, metres.
SENTINEL_1_WAVELENGTH = 299792458.0 / 5.405e9
#: Ionospheric refraction constant, m^3 / s^2; TEC units are 1e16 electrons per square metre.
K_IONO, TEC_UNIT = 40.31, 1e16
EARTH_RADIUS, SHELL_HEIGHT = 6371e3, 450e3


def rewrap(phase: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(phase + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def ambiguity(unwrapped: Column, decimals: int = 4) -> Column:
    """Whole cycles between a phase and its wrapped value, rounded (half even) first to `decimals` places and then to three."""
    return F.bround(F.bround((unwrapped - rewrap(unwrapped)) / F.lit(2 * math.pi), decimals), 3)


def transfer_ambiguity(wrapped: Column, unwrapped: Column) -> Column:
    """wrapped plus the whole number of cycles that brings it nearest to unwrapped."""
    return wrapped + F.lit(2 * math.pi) * F.rint((unwrapped - wrapped) / F.lit(2 * math.pi))


def phase_variance(correlation: Column, looks: float) -> Column:
    square = correlation * correlation
    return (F.lit(1.0) - square) / (F.lit(2.0 * looks) * square + F.lit(1e-6))


def amplitude_variance(dispersion: Column, mean: Column) -> Column:
    return (dispersion * mean) * (dispersion * mean)


def displacement_factor(wavelength: float | None) -> float:
    """Metres per radian, positive toward the sensor; without a wavelength the unit stays radians and only the sign turns."""
    return -1.0 if wavelength is None else -wavelength / (4 * math.pi)


def shell_incidence(ground: Column, height: float = SHELL_HEIGHT) -> Column:
    """The incidence angle (degrees) at an ionosphere shell of a ray that meets the ground at `ground` degrees."""
    return F.degrees(F.asin(F.lit(EARTH_RADIUS / (EARTH_RADIUS + height)) * F.sin(F.radians(ground))))


def range_delay(tec: Column, incidence: Column, frequency: float) -> Column:
    """Slant range delay in metres of a vertical TEC; the ray is refracted into the shell. A zero incidence is nodata."""
    bend = F.lit(K_IONO * TEC_UNIT / frequency**2)
    inside = F.asin(F.sin(F.radians(F.nullif(incidence, F.lit(0.0)))) / (F.lit(1.0) + bend * tec))
    return tec / F.cos(inside) * bend


def incidence_of_los(east: Column, north: Column) -> Column:
    """Radians, of a line of sight's east and north parts."""
    return F.acos(F.sqrt(F.lit(1.0) - east * east - north * north))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / F.lit(86400.0)


def pair_name(reference: Column, secondary: Column, fmt: str = "yyyyMMdd") -> Column:
    return F.concat_ws("_", F.date_format(reference, fmt), F.date_format(secondary, fmt))


def full_suffix(name: Column) -> Column:
    """From the first dot of the last path element on."""
    return F.regexp_extract(F.substring_index(name, "/", -1), r"(\..*)$", 1)


def prefix_before_date(name: Column, date_pattern: str = r"[0-9]{8}") -> Column:
    return F.regexp_extract(name, rf"^(.*?){date_pattern}", 1)


def repaired_url(url: Column) -> Column:
    """A scheme whose double slash was joined by path handling gets it back."""
    return F.regexp_replace(url, r"^(s3|https?|gs):/+", "$1://")


def gaussian_sigma(cutoff: float, spacing: float, value: float = 0.5) -> float:
    """Standard deviation in pixels of the low-pass whose response falls to `value` at the cutoff wavelength."""
    return cutoff * math.sqrt(-math.log(value)) / (math.sqrt(2) * math.pi) / spacing


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)
