"""Check characters of Indian identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as V


def gstin_check_character(stem: Column | str) -> Column:
    """Base-36 check character over the first 14 characters, weights 1 and 2 in turn."""
    stem = F.col(stem) if isinstance(stem, str) else stem
    total = F.lit(0)
    for i in range(14):
        product = (F.instr(F.lit(V.BASE36), F.substring(stem, i + 1, 1)) - 1) * (i % 2 + 1)
        total = total + F.floor(product / 36).cast("int") + product % 36
    return F.substring(F.lit(V.BASE36), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def gstin_is_valid(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    shape = dict(V.CHECKED_SHAPES)["GSTIN"]
    return col.rlike(shape) & (gstin_check_character(col) == F.substring(col, 15, 1))


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    """Multiplication in the dihedral group of order ten and the iterated permutation, flattened."""
    def product(a: int, b: int) -> int:
        turn = (a % 5 - b % 5) % 5 if a >= 5 else (a % 5 + b % 5) % 5
        return turn + 5 * ((a >= 5) != (b >= 5))

    group = [product(a, b) for a in range(10) for b in range(10)]
    row, permutations = list(range(10)), []
    for _ in range(8):
        permutations += row
        row = [V.VERHOEFF_BASE[d] for d in row]
    return group, permutations


def verhoeff_is_valid(col: Column | str) -> Column:
    """Checksum of a digit string, rightmost digit first."""
    col = F.col(col) if isinstance(col, str) else col
    group, permutations = _verhoeff_tables()
    d, p = F.array(*[F.lit(v) for v in group]), F.array(*[F.lit(v) for v in permutations])
    digits = F.transform(F.split(F.reverse(col), ""), lambda c, i: F.element_at(p, (i % 8) * 10 + c.cast("int") + 1))
    return F.aggregate(digits, F.lit(0), lambda acc, v: F.element_at(d, acc * 10 + v + 1)) == 0


def aadhaar_is_valid(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    compact = F.regexp_replace(col, r"\s", "")
    return F.when(compact.rlike(dict(V.CHECKED_SHAPES)["Aadhaar"]), verhoeff_is_valid(compact)).otherwise(False)
