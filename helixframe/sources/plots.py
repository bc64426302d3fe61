"""The contour plot of log statistics as data and as a script."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .graphs import log_table


def contour_matrix(log_statistics: DataFrame, bins: int = 32) -> DataFrame:
    """(k, bin 0 to bins - 1): nodes by k and binary logarithm of the coverage."""
    return log_table(log_statistics, bins).drop("nodes", "sum", "average")


def contour_script(log_statistics: DataFrame, name: str, bins: int = 32) -> str:
    """An R script that draws the matrix; it has one row for each k, 254 at most."""
    rows = contour_matrix(log_statistics, bins).collect()
    ks = ", ".join(str(r.k) for r in rows)
    cells = ", ".join(str(r[str(b)]) for b in range(bins) for r in rows)
    return f'k <- c({ks})\nm <- matrix(c({cells}), nrow = {len(rows)})\nfilled.contour(k, 0:{bins - 1}, log2(m + 1), xlab = "k", ylab = "log2(coverage)", main = "{name}")\n'
