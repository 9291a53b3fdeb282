"""Column expressions over vectors stored as ``array<float|double>``.

All arithmetic is done in double.  These are built-in higher-order
functions, so they stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x



def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product summed in index order, in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def diff(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Element-wise a - b in double (H1)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))



def l2_norm(vec: ColumnOrName) -> Column:
    sq = F.aggregate(_c(vec), F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def l2_normalise(vec: ColumnOrName) -> Column:
    """Row L2 normalisation (H13); a zero vector stays zero.  The norm is
    the ``aggregate`` accumulator handed to its finish function, so it is
    computed once per row, not once per element."""
    v = _c(vec)

    def finish(acc: Column) -> Column:
        n = F.sqrt(acc)
        return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))

    return F.aggregate(v, F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"), finish)


def softplus(x: ColumnOrName) -> Column:
    """log(1 + exp(x)) in the overflow-safe form max(x,0) + log1p(exp(-|x|))."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))



def md5_uniform(*parts: ColumnOrName) -> Column:
    """Seeded uniform integer in [0, 2^32) from md5 of '|'-joined parts.

    Independent of partitioning and engine: DuckDB states the same value as
    ``CAST('0x' || substring(md5(...), 1, 8) AS BIGINT)``.
    """
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
