"""Low-precision floating-point formats as column expressions, and how many digits survive them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter of a format, its exponent and mantissa bits, and its display name.
FORMATS = {
    "c": (4, 3, "E4M3"), "w": (5, 2, "E5M2"), "b": (8, 7, "BF16"), "p": (5, 10, "FP16"), "h": (5, 10, "FP16"), "s": (8, 23, "FP32"), "d": (11, 52, "FP64"), "q": (15, 112, "FP128"), "o": (19, 236, "FP256"),
}


def by_precision(letters: str, formats: dict = FORMATS) -> list[str]:
    """Letters from the least to the most mantissa bits."""
    return sorted(letters, key=lambda x: (formats[x][1], formats[x][0]))


def wider(a: str, b: str, formats: dict = FORMATS) -> str:
    """The format that holds both: the one with more exponent bits, then with more mantissa bits."""
    return max(a, b, key=lambda x: formats[x][:2])


def quantize(x, exponent_bits, mantissa_bits) -> Column:
    """x rounded to nearest, ties to even, in the given format: gradual underflow, overflow to infinity; null, NaN and zero stay.

    The bits may be columns. A format at least as wide as a double changes nothing.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    if isinstance(exponent_bits, int) and isinstance(mantissa_bits, int) and (exponent_bits, mantissa_bits) == (8, 23):
        return x.cast("float").cast("double")  # what the cast does
    e, m = (b if isinstance(b, Column) else F.lit(b) for b in (exponent_bits, mantissa_bits))
    two = F.lit(2.0)
    top = F.pow(two, e - 1) - 1
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")
    exact = F.when(F.pow(two, guess) > size, guess - 1).when(F.pow(two, guess + 1) <= size, guess + 1).otherwise(guess)
    step = F.pow(two, m - F.greatest(exact, 1 - top))
    rounded = F.rint(x * step) / step
    limit = (two - F.pow(two, -m)) * F.pow(two, top)
    kept = x.isNull() | F.isnan(x) | (x == 0) | (size == float("inf")) | (m >= 52)
    return F.when(kept, x).when(F.abs(rounded) > limit, F.signum(x) * float("inf")).otherwise(rounded)


def quantize_columns(df, assigned: dict[str, str], formats: dict = FORMATS):
    """Each named column in the format of its letter."""
    return df.withColumns({c: quantize(c, *formats[f][:2]) for c, f in assigned.items()})


def within_digits(reference, value, digits: int) -> Column:
    """Whether value has so many correct digits: |reference - value| < |reference| * 10^-digits, or |value| <= 10^-digits where
    reference is 0; NaN and infinities fail."""
    r, v = (F.col(c) if isinstance(c, str) else c for c in (reference, value))
    tol = F.lit(10.0**-digits)
    odd = F.isnan(v) | (F.abs(v) == float("inf")) | F.isnan(r) | (F.abs(r) == float("inf"))
    return F.when(odd | v.isNull() | r.isNull(), False).when(r == 0, F.abs(v) <= tol).otherwise(F.abs(r - v) < F.abs(r) * tol)


def correct_digits(reference, value) -> Column:
    """Correct decimal digits of value, at most 16."""
    r, v = (F.col(c) if isinstance(c, str) else c for c in (reference, value))
    error = F.abs(r - v) / F.when(r == 0, 1.0).otherwise(F.abs(r))
    return F.when(error.isNull() | F.isnan(error) | (error == float("inf")), 0.0).when(error == 0, 16.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(16.0), -F.log10(error))))


def three_way_mean(a, b, c) -> Column:
    return F.col(a) / 3 + F.col(b) / 3 + F.col(c) / 3


def display_name(letter) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v[2])])
    return F.try_element_at(names, F.col(letter) if isinstance(letter, str) else letter)


def in_format(function, exponent_bits: int, mantissa_bits: int):
    """A function of columns that rounds its arguments and its result to a format, as an arithmetic in that format would."""

    def rounded(*args):
        return quantize(function(*[quantize(a, exponent_bits, mantissa_bits) for a in args]), exponent_bits, mantissa_bits)

    return rounded
