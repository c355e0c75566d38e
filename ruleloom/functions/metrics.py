"""Rule measures as closed-form column expressions over integer counts.

Counts: n_ant records contain the antecedent, n_hit of them have the consequent, n_class records have the
consequent, n_total records in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest count whose pairwise products of squares still fit a 38-digit decimal; beyond it fractions are compared digit
# by digit, which gives the same answer.
EXACT_LIMIT = 2_000_000_000
# Decimal digits of a fraction compared at once, and how often. All of them fit up to 10^13 records, and two different
# fractions of such counts differ within them.
DIGITS, STEPS = 12, 5


def big(col: Column) -> Column:
    return col.cast("decimal(19,0)")


def chi_square(n_ant: Column, n_hit: Column, n_class: Column, n_total: Column) -> Column:
    """Pearson's chi-square of the 2x2 table; NaN where antecedent or consequent holds for every record.

    The difference of the cross products is taken in exact decimals: both are near n_total squared and
    would cancel in floating point.
    """
    difference = (big(n_total) * big(n_hit) - big(n_ant) * big(n_class)).cast("double")
    a, c, n = (x.cast("double") for x in (n_ant, n_class, n_total))
    spread = a * c * (n - a) * (n - c)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(n * difference * difference / spread)


def with_metrics(counts: DataFrame) -> DataFrame:
    n_ant, n_hit, n_class, n_total = (F.col(x) for x in ("n_ant", "n_hit", "n_class", "n_total"))
    return (
        counts.withColumn("support", n_hit / n_total)
        .withColumn("confidence", n_hit / n_ant)
        .withColumn("chi2", chi_square(n_ant, n_hit, n_class, n_total))
    )


def passes(min_confidence: float, min_chi2: float) -> Column:
    chi2 = F.col("chi2")
    return (F.col("confidence") >= min_confidence) & ((chi2 >= min_chi2) | F.isnan(chi2))


def purity(n: Column, squares: Column) -> Column:
    """Sum of squared class shares, which is one minus the Gini impurity."""
    size = n.cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise(squares.cast("double") / (size * size))


def gini(n: Column, squares: Column) -> Column:
    return 1.0 - purity(n, squares)


def gain(n: Column, squares: Column, n_parent: Column, squares_parent: Column) -> Column:
    """Share of the parent's records times the drop in Gini impurity."""
    return (n / n_parent) * (purity(n, squares) - purity(n_parent, squares_parent))


def gain_exceeds(n: Column, squares: Column, n_parent: Column, squares_parent: Column, least: float) -> Column:
    """gain > least; for least = 0 an exact comparison of the two fractions squares / n^2, at any size."""
    if least != 0.0:
        return gain(n, squares, n_parent, squares_parent) > least
    ours = squares.cast("decimal(38,0)") * (big(n_parent) * big(n_parent)).cast("decimal(38,0)")
    theirs = squares_parent.cast("decimal(38,0)") * (big(n) * big(n)).cast("decimal(38,0)")
    by_digits = _digits(squares, n) > _digits(squares_parent, n_parent)
    return F.when(n_parent <= EXACT_LIMIT, ours > theirs).otherwise(by_digits)


def _digits(squares: Column, n: Column) -> Column:
    """squares / n^2 as its whole part and groups of decimals, by long division; structs of it compare like the fractions."""
    below = square(n)
    rest = squares.cast("decimal(38,0)")
    parts = [F.call_function("div", rest, below)]
    for _ in range(STEPS):
        rest = (F.pmod(rest, below) * F.lit(10**DIGITS).cast("decimal(13,0)")).cast("decimal(38,0)")
        parts.append(F.call_function("div", rest, below))
    return F.struct(*[p.alias(f"d{i}") for i, p in enumerate(parts)])


def square(n: Column) -> Column:
    return (big(n) * big(n)).cast("decimal(38,0)")


def rule_text(antecedent: Column, consequent: Column, support: Column, confidence: Column, chi2: Column) -> Column:
    """antecedent -> class (support, confidence, chi2), the measures with six decimals."""
    return F.format_string(
        "%s -> %s (%.6f, %.6f, %.6f)",
        F.array_join(antecedent.cast("array<string>"), " "),
        consequent.cast("string"),
        F.round(support, 6),
        F.round(confidence, 6),
        F.when(F.isnan(chi2), chi2).otherwise(F.round(chi2, 6)),
    )
