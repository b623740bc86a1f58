"""Evidence of an edge: a list of occurrences, each kept once, the latest CAP of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 20


def fold(held: Column, new: Column, cap: int = CAP) -> Column:
    """held with the occurrences of new appended in order, one after the other: one that is there already changes
    nothing, and the oldest goes when there are more than cap. One that went may so come again."""

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat(acc, F.array(x))
        return F.when(F.array_contains(acc, x), acc).otherwise(F.slice(longer, F.greatest(F.size(longer) - (cap - 1), F.lit(1)), cap))

    return F.aggregate(new, held, step)


def in_order(order: Column, value: Column) -> Column:
    """The values of a group as an array in order, for `fold`."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def last(occurrences: Column) -> Column:
    return F.when(F.size(occurrences) > 0, F.element_at(occurrences, -1))
