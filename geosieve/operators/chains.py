"""Filter chains: several spatial steps, applied to the targets or to the source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from geosieve.functions.expressions import as_column
from geosieve.layer import Layer
from geosieve.operators.spatial import JoinPlan, Radius, plan_filter, spatial_filter
from geosieve.sizing import settle


@dataclass(frozen=True)
class SpatialStep:
    source: Layer
    predicates: tuple[str, ...] = ("intersects",)
    radius: Radius = None
    plan: JoinPlan | None = None

    def measured(self, target: Layer) -> SpatialStep:
        """The step with its plan; what is left of ``target`` after a filter can use it too."""
        return self if self.plan else replace(self, plan=plan_filter(target, self.source, self.radius))

    def apply(self, target: Layer) -> Layer:
        return target.with_df(spatial_filter(target, self.source, self.predicates, self.radius, plan=self.plan))


def chain(target: Layer, steps: Sequence[SpatialStep], mode: str = "target",
          custom: Column | str | None = None) -> DataFrame:
    """Targets that pass a chain of spatial steps, the last of which relates them to the current source.

    ``mode="target"``: the target itself satisfies every step. ``mode="source"``: the last step's source is
    first reduced by the earlier steps, and the target is tested against what is left. The two differ.
    ``custom`` is an attribute filter of the last step's source.
    """
    if mode not in ("target", "source"):
        raise ValueError("mode is 'target' or 'source'")
    *earlier, last = steps
    source = last.source if custom is None else last.source.where(as_column(custom))
    if mode == "source":
        for step in earlier:
            source = step.apply(source)
        if earlier:
            # measured and then joined, so it is worth keeping
            source = source.with_df(settle(source.df))
        return replace(last, source=source).apply(target).df
    # all steps are measured against the unfiltered target, else each one would run all before it
    planned = [step.measured(target) for step in [*earlier, replace(last, source=source)]]
    for step in planned:
        target = step.apply(target)
    return target.df
