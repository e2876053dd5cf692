"""Scalar formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_pdf(x, mean, variance) -> Column:
    return F.exp(-(x - mean) * (x - mean) / (2 * variance)) / F.sqrt(F.lit(2 * math.pi) * variance)


def diagonal_gaussian_pdf(x, mean, variance) -> Column:
    """Product of densities over the elements of arrays."""
    terms = F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), variance, lambda d, v: F.exp(-d * d / (2 * v)) / F.sqrt(2 * math.pi * v))
    return F.aggregate(terms, F.lit(1.0), lambda s, t: s * t)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_derivative(y) -> Column:
    """From the value of the sigmoid."""
    return y * (1 - y)


def round_half_up(x) -> Column:
    """Half up by truncation, as for positive numbers; for negative ones the mirror image."""
    whole = x.cast("long")
    return F.when(x >= 0, F.when(x - whole < 0.5, whole).otherwise(whole + 1)).otherwise(F.when(x - whole > -0.5, whole).otherwise(whole - 1)).cast("double")


def wrap32(x) -> Column:
    """A long as a two's-complement 32-bit number."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


#: Multiplier, increment and modulus of the linear congruential generator.
LCG = (1103515245, 12345, 2147483647)


def lcg_next(seed) -> Column:
    """The next state: 32-bit wrap-around, then the remainder with the sign of the dividend."""
    a, c, m = LCG
    return wrap32(seed.cast("long") * a + c) % F.lit(m)


def lcg_uniform(state) -> Column:
    return F.abs(state / float(LCG[2]))


def box_muller(u, v) -> Column:
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def givens(a, b) -> tuple[Column, Column]:
    r = F.hypot(a, b)
    return F.when(r == 0, 1.0).otherwise(a / r), F.when(r == 0, 0.0).otherwise(-b / r)


#: Fixed value: ratio of specific heats.
GAMMA = 1.4


def velocity(density, momentum) -> Column:
    return momentum / density


def speed_squared(*velocities) -> Column:
    total = velocities[0] * velocities[0]
    for v in velocities[1:]:
        total = total + v * v
    return total


def pressure(density, energy, speed2) -> Column:
    return (GAMMA - 1) * (energy - 0.5 * density * speed2)


def speed_of_sound(density, pressure_) -> Column:
    return F.sqrt(GAMMA * pressure_ / density)


def comma_and(items) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def hex_float(text) -> Column:
    """A C-style hexadecimal number such as -0x1.8p+3 as a double; null where the text is none."""
    pattern = r"^([+-]?)0[xX]([0-9a-fA-F]+)\.?([0-9a-fA-F]*)[pP]([+-]?[0-9]+)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    digits = F.conv(F.concat(part(2), part(3)), 16, 10).cast("double")
    value = digits * F.pow(F.lit(2.0), part(4).cast("double") - 4 * F.length(part(3)))
    return F.when(text.rlike(pattern), F.when(part(1) == "-", -value).otherwise(value))


def dump_line(text) -> Column:
    """(name, place, value) of a line `[...] name[place] = hexadecimal number`; place is null without brackets."""
    pattern = r"^\[[^\]]*\]\s*([A-Za-z_][A-Za-z0-9_]*)(?:\[([0-9]+)\])?\s*=\s*(\S+)\s*$"
    place = F.regexp_extract(text, pattern, 2)
    return F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("name"), F.nullif(place, F.lit("")).cast("long").alias("place"), hex_float(F.regexp_extract(text, pattern, 3)).alias("value"))


def options_map(text) -> Column:
    """k=v tokens as a map."""
    return F.str_to_map(text, F.lit(" "), F.lit("="))
