"""Complex algebra on pairs of columns. Nodata is null, and any null part makes the result null."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cx(NamedTuple):
    re: Column
    im: Column

    def aliased(self, re: str = "re", im: str = "im") -> list[Column]:
        return [self.re.alias(re), self.im.alias(im)]


def cx(prefix: str = "", suffix: str = "") -> Cx:
    """The columns {prefix}re{suffix} and {prefix}im{suffix}."""
    return Cx(F.col(f"{prefix}re{suffix}"), F.col(f"{prefix}im{suffix}"))


def conj(a: Cx) -> Cx:
    return Cx(a.re, -a.im)


def mul(a: Cx, b: Cx) -> Cx:
    return Cx(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def mul_conj(a: Cx, b: Cx) -> Cx:
    """a * conj(b): an interferogram of reference a and secondary b."""
    return Cx(a.re * b.re + a.im * b.im, a.im * b.re - a.re * b.im)


def magnitude(a: Cx) -> Column:
    return F.sqrt(a.re * a.re + a.im * a.im)


def angle(a: Cx) -> Column:
    return F.atan2(a.im, a.re)


def expj(phase: Column) -> Cx:
    return Cx(F.cos(phase), F.sin(phase))


def unit(a: Cx) -> Cx:
    return expj(angle(a))


def total(a: Cx) -> Cx:
    return Cx(F.sum(a.re), F.sum(a.im))
