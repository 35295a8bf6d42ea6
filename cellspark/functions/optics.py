"""Diffraction geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def q2_from_two_theta(two_theta: Column, wavelength: float) -> Column:
    """(2 sin(theta) / wavelength)**2 of an angle 2 theta in radians."""
    return F.pow(2 * F.sin(two_theta / 2) / wavelength, 2)


def lp_factor(two_theta: Column) -> Column:
    """Lorentz-polarisation factor by which intensities are multiplied."""
    return (1 + F.pow(F.cos(two_theta), 2)) / (2 * F.sin(two_theta))


def angle_from_q2(q0: Column, q1: Column, difference: Column) -> Column:
    """Angle between two scattering vectors, by the law of cosines; null where no triangle has these sides."""
    cosine = (q0 + q1 - difference) / (2 * F.sqrt(q0 * q1))
    return F.when(F.abs(cosine) <= 1, F.acos(cosine))


def fold_angle(angle: Column) -> Column:
    """The acute angle between lines at this angle."""
    size = F.abs(angle)
    return F.when(size > math.pi / 2, math.pi - size).otherwise(size)


def scattering_vector(s0: list[Column], s1: list[Column], wavelength: float) -> list[Column]:
    """s1 scaled to 1 / wavelength, less s0."""
    length = F.sqrt(s1[0] * s1[0] + s1[1] * s1[1] + s1[2] * s1[2])
    return [v / length / wavelength - w for v, w in zip(s1, s0, strict=True)]


def q2_of_beam(s0: list[Column], s1: list[Column], wavelength: float) -> Column:
    """q2 from the angle between both beams."""
    inner = sum((v * w for v, w in zip(s1, s0, strict=True)), F.lit(0.0))
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner / (size(s0) * size(s1))))
    return q2_from_two_theta(F.acos(cosine), wavelength)


def kernel(q2: Column, centre: Column, width: float) -> Column:
    """Gaussian of the distance from each of an array of positions, summed."""
    return F.aggregate(F.transform(q2, lambda q: F.exp(-0.5 * F.pow((centre - q) / width, 2))), F.lit(0.0), lambda s, v: s + v)


def inverse_distance(q2: Column, reference: Column, scale: float, epsilon: float) -> Column:
    return epsilon / (F.abs(reference - q2) / scale + epsilon)


def breadth(q2: Column, times: float = 1.0) -> Column:
    """Peak width at a position."""
    return times * (0.00007 + 0.002 * q2)
