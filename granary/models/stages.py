"""Named stages: slices, parameters and replacement for sequences of Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame


class Stages:
    """An ordered sequence of (name, stage); nothing is changed in place.

    ``stages["name"]`` and ``stages[i]`` give a stage, ``stages[a:b]`` and
    ``stages["from":"to"]`` (names inclusive) a shorter sequence. Parameters
    are named ``name__param``.
    """

    def __init__(self, steps: Sequence[tuple[str, Estimator | Transformer]]):
        self.steps = list(steps)
        if not self.steps:
            raise ValueError("no stages")
        if len({n for n, _ in self.steps}) < len(self.steps):
            raise ValueError("stage names must be unique")
        for name, stage in self.steps:
            if "__" in name:
                raise ValueError(f"stage name {name} must not hold two underscores")
            if not isinstance(stage, (Estimator, Transformer)):
                raise TypeError(f"stage {name} can neither fit nor transform")

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def _index(self, name: str) -> int:
        if name not in self.names:
            raise KeyError(f"no stage {name}; there are {', '.join(self.names)}")
        return self.names.index(name)

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.steps[self._index(key)][1]
        if isinstance(key, int):
            return self.steps[key][1]
        if isinstance(key, slice):
            a = self._index(key.start) if isinstance(key.start, str) else key.start
            b = self._index(key.stop) + 1 if isinstance(key.stop, str) else key.stop
            return type(self)(self.steps[a:b])
        raise KeyError(f"not a stage: {key!r}")

    def get_params(self) -> dict[str, object]:
        """Every parameter that has a value."""
        return {
            f"{name}__{p.name}": v
            for name, stage in self.steps
            for p, v in sorted(stage.extractParamMap().items(), key=lambda e: e[0].name)
        }

    def set_params(self, **params) -> Stages:
        """The sequence with other parameter values."""
        changed: dict[str, dict] = {}
        for key, value in params.items():
            name, _, param = key.partition("__")
            stage = self[name]
            if not param or not stage.hasParam(param):
                raise ValueError(f"stage {name} has no parameter {param!r}")
            changed.setdefault(name, {})[stage.getParam(param)] = value
        return type(self)([(n, s.copy(changed[n]) if n in changed else s) for n, s in self.steps])

    def replace(self, name: str, stage: Estimator | Transformer) -> Stages:
        """The sequence with another stage of that name."""
        at = self._index(name)
        return type(self)([*self.steps[:at], (name, stage), *self.steps[at + 1 :]])

    def fit(self, df: DataFrame) -> FittedStages:
        """Fits the stages in order, each on what the stages before make of the rows."""
        model = Pipeline(stages=[s for _, s in self.steps]).fit(df)
        return FittedStages(list(zip(self.names, model.stages, strict=True)))


class FittedStages(Stages):
    """Fitted stages; slices are fitted too."""

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel([s for _, s in self.steps]).transform(df)
