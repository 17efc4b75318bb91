"""Counter-based random numbers: a value depends on the row key, a label and a seed, never on the layout.

Generators use the 64-bit ``xxhash64`` counter. Repairs and samples use MD5, which other SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.functions.columns import computed_once

_BITS = 53
_ACKLAM_SPLIT = 0.02425


def uniform(key: Column, label: str, seed: int = 0) -> Column:
    """Uniform double strictly inside (0, 1)."""
    bits = F.xxhash64(key, F.lit(label), F.lit(int(seed))).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (bits.cast("double") + 0.5) / float(1 << _BITS)


def normal(key: Column, label: str, seed: int = 0) -> Column:
    """Standard normal draw."""
    return normal_quantile(uniform(key, label, seed))


def md5_text(key: Column, label: str | int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(label))))


def md5_index(key: Column, label: str | int, size: Column | int) -> Column:
    """0-based pick among ``size`` items from the first 60 bits of an MD5."""
    number = F.conv(F.substring(md5_text(key, label), 1, 15), 16, 10).cast("long")
    return F.pmod(number, size if isinstance(size, Column) else F.lit(int(size)).cast("long"))


def _poly(x: Column, coefficients: list[float]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


# Published coefficients of Acklam's rational approximation of the normal quantile.
_QA = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_QB = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_QC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_QD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
# Abramowitz and Stegun 26.2.17.
_PHI = [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]
_PHI_P = 0.2316419


def quantile_tail(u: Column) -> Column:
    """Part of the normal quantile that its formula uses many times."""
    return F.sqrt(-2.0 * F.log(F.least(u, 1.0 - u)))


def normal_quantile(u: Column, tail: Column | None = None) -> Column:
    """Inverse of the standard normal distribution function as one codegen-able expression.

    Pass ``quantile_tail(u)`` as a column of an earlier projection to keep the generated code short.
    """
    tail = quantile_tail(u) if tail is None else tail
    outer = _poly(tail, _QC) / _poly(tail, _QD)
    centre = u - 0.5
    square = centre * centre
    inner = centre * _poly(square, _QA) / _poly(square, _QB)
    return F.when(F.abs(centre) > 0.5 - _ACKLAM_SPLIT, outer * F.signum(-centre)).otherwise(inner)


def with_normals(rows: DataFrame, units: dict[str, str], once: bool = False) -> DataFrame:
    """Replace unit columns by normals under new names, ``{unit column: normal column}``."""
    others = [c for c in rows.columns if c not in units]
    staged = rows.select("*", *[quantile_tail(F.col(u)).alias(f"_tail{u}") for u in units])
    normals = {z: normal_quantile(F.col(u), F.col(f"_tail{u}")) for u, z in units.items()}
    if once:
        return computed_once(staged, others, normals)
    return staged.select(*[F.col(f"`{c}`") for c in others], *[v.alias(z) for z, v in normals.items()])


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    t = 1.0 / (1.0 + _PHI_P * F.abs(z))
    upper = F.exp(-0.5 * z * z) * 0.3989422804014327 * _poly(t, _PHI)
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)
