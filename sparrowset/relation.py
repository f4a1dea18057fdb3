"""A thin immutable wrapper that chains the operators; every step is lazy and gives a new relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparrowset.operators import filters, groups, joins, order

_STEPS = {
    name: getattr(module, name)
    for module, names in (
        (filters, ("project", "rename", "filter_and", "between", "compact")),
        (joins, ("join", "left_outer", "semi_join", "anti_join", "in_flag", "to_buckets")),
        (groups, ("keys", "count", "minimum", "maximum", "min_and_max", "distinct", "total", "total_count", "having_repeats", "histogram", "first_per_key", "next_in_group")),
        (order, ("sort", "top_k", "slice_rows", "union_all")),
    )
    for name in names
}


@dataclass(frozen=True)
class Relation:
    df: DataFrame

    def __getattr__(self, name: str):
        if name not in _STEPS:
            raise AttributeError(name)

        def step(*args, **params) -> Relation:
            return Relation(_STEPS[name](self.df, *[a.df if isinstance(a, Relation) else a for a in args], **params))

        return step
