from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of short decimals often end exactly on a rounding tie, where the last bit of a
# double decides.  The compared values are therefore rounded at a point off that grid.
SHIFT = 0.0857864


def rd(c, digits: int = 6) -> Column:
    """Double at ``digits`` decimals without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.lit(float(10 ** digits))
    return F.rint(c.cast("double") * p + F.lit(SHIFT)) / p + F.lit(0.0)


def rounded(*names, digits: int = 6) -> list[Column]:
    return [rd(n, digits).alias(n) for n in names]
