"""The stages of a model that may be replaced: by any function, or by one of a registered type that is saved with it.

A stage is a callable that takes and returns a table, as the function that stands in its place does. A type registered
with `stage` is a dataclass whose fields are JSON values; its instances are saved as its name and fields, and loaded
wherever the module that registers it has been imported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import linear, mining
from .parsing import MOST_READINGS, parsed, parsed_alternatives

_KNOWN: dict[tuple[str, str], type] = {}


@dataclass(frozen=True)
class Stages:
    """What may be replaced in `GraphModel.process`.

    parse: rows to labels and bonds, with group_norm and weight_ug if a row may be several graphs. color: what colouring
    has made. partition: (graphs, fragments, most vertices) to partitions. in_span: (cells, columns, norms, basis) to
    row_id and in_span. predict: what prediction has made.
    """

    parse: Callable[[DataFrame], DataFrame] = parsed
    color: Callable[[DataFrame], DataFrame] | None = None
    partition: Callable[..., DataFrame] = mining.partitions
    in_span: Callable[..., DataFrame] = linear.in_span_of
    predict: Callable[[DataFrame], DataFrame] | None = None

    def to_json(self) -> dict[str, dict]:
        """The stages that were replaced; one that isn't of a registered type can't be saved."""
        out, plain = {}, Stages()
        for f in fields(self):
            s = getattr(self, f.name)
            if s is getattr(plain, f.name):
                continue
            name = next((n for (kind, n), cls in _KNOWN.items() if kind == f.name and type(s) is cls), None)
            if name is None:
                raise ValueError(f"the {f.name} stage is of no registered type, so it can't be saved: {s!r}")
            out[f.name] = {"type": name, "data": asdict(s)}
        return out

    @staticmethod
    def from_json(found: dict[str, dict]) -> Stages:
        made = {}
        for kind, s in found.items():
            if (kind, s["type"]) not in _KNOWN:
                raise ValueError(f"no {kind} stage of a known type: {s['type']!r}")
            made[kind] = _KNOWN[kind, s["type"]](**s["data"])
        return Stages(**made)


def stage(kind: str, name: str) -> Callable[[type], type]:
    """Registers a dataclass as the type `name` of a stage; a name stands for one type only."""
    if kind not in {f.name for f in fields(Stages)}:
        raise ValueError(f"no stage {kind!r}")

    def add(cls: type) -> type:
        if _KNOWN.setdefault((kind, name), cls) is not cls:
            raise ValueError(f"there is another {kind} stage {name!r}")
        return cls

    return add


@stage("parse", "alternatives")
@dataclass(frozen=True)
class Alternatives:
    """Labels may be lists of alternatives, so that a row is several weighted graphs."""

    most: int = MOST_READINGS

    def __call__(self, rows: DataFrame) -> DataFrame:
        return parsed_alternatives(rows, self.most)


@stage("partition", "best")
@dataclass(frozen=True)
class Best:
    """The first partitions of the search, within its limits."""

    limit: int | None = 64
    max_iter: int | None = 65536
    max_heap: int | None = 65536

    def __call__(self, graphs: DataFrame, fragments: dict[str, tuple[int, float]], most: int) -> DataFrame:
        return mining.partitions(graphs, fragments, most, self.limit, self.max_iter, self.max_heap)


@stage("partition", "share")
@dataclass(frozen=True)
class Share:
    """As many partitions as leave at most a share of the likelihood, by estimate."""

    share: float = 0.01
    max_iter: int | None = 65536
    max_heap: int | None = 65536

    def __call__(self, graphs: DataFrame, fragments: dict[str, tuple[int, float]], most: int) -> DataFrame:
        return mining.partitions(graphs, fragments, most, None, self.max_iter, self.max_heap, self.share)


@stage("partition", "structural")
@dataclass(frozen=True)
class Structural(Best):
    """The first partitions of a search that also weighs how pieces are composed and bonded."""

    def __call__(self, graphs: DataFrame, fragments: dict[str, tuple[int, float]], most: int) -> DataFrame:
        return mining.partitions(graphs, fragments, most, self.limit, self.max_iter, self.max_heap, structural=True)


@stage("partition", "every")
@dataclass(frozen=True)
class Every:
    """All partitions."""

    def __call__(self, graphs: DataFrame, fragments: dict[str, tuple[int, float]], most: int) -> DataFrame:
        return mining.partitions(graphs, fragments, most, every=True)


@stage("in_span", "within")
@dataclass(frozen=True)
class Within:
    """Rows in the span up to a relative residual."""

    tolerance: float = 1e-6

    def __call__(self, cells: DataFrame, columns, norms, basis) -> DataFrame:
        return linear.in_span_of(cells, columns, norms, basis, self.tolerance)


@stage("predict", "bounded")
@dataclass(frozen=True)
class Bounded:
    """Predictions no lower and no higher than bounds; None is no bound."""

    low: float | None = None
    high: float | None = None

    def __call__(self, rows: DataFrame) -> DataFrame:
        def within(c: str):
            x = F.col(c)
            x = x if self.low is None else F.when(x < self.low, self.low).otherwise(x)
            return x if self.high is None else F.when(x > self.high, self.high).otherwise(x)

        return rows.withColumns({c: within(c) for c in rows.columns if c.startswith("pred_")})
