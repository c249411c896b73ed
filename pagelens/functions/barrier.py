"""A barrier for the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(column: Column) -> Column:
    """The column, computed where it stands.

    A filter on a column is pushed below the projection that makes it, with the whole
    expression written out in its place; where that expression looks into an array from a
    lambda function, the array is then computed anew for every element. Exploding a column
    brings such a filter by itself. The row number, never negative, keeps filters above.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)
