"""Column helpers."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)
