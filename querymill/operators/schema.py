"""The finite domain of a table: one schema entry for each attribute."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CATEGORICAL, NUMERICAL = "categorical", "numerical_binned"
MISSING = "__MISSING__"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    cardinality: int
    categories: tuple[str, ...] | None = None
    bin_edges: tuple[float, ...] | None = None
    representatives: tuple[str, ...] | None = None
    missing_token: str = MISSING
    #: Code of missing values, where there are any.
    missing_code: int | None = None
    #: Values of a small numeric domain, by code; such an attribute has no edges.
    values: tuple[float, ...] | None = None


@dataclass(frozen=True)
class TableSchema:
    attributes: tuple[Attribute, ...] = field(default_factory=tuple)
    label_column: str | None = None

    @property
    def d(self) -> int:
        return len(self.attributes)

    @property
    def cardinalities(self) -> list[int]:
        return [a.cardinality for a in self.attributes]

    def indices(self, kind: str) -> list[int]:
        return [i for i, a in enumerate(self.attributes) if a.kind == kind]

    def column_index(self, name: str) -> int:
        for i, a in enumerate(self.attributes):
            if a.name == name:
                return i
        raise KeyError(name)

    def to_dict(self) -> dict[str, Any]:
        return {"columns": [asdict(a) for a in self.attributes], "label_column": self.label_column}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> TableSchema:
        listed = ("categories", "bin_edges", "representatives", "values")
        made = [Attribute(**{k: tuple(v) if k in listed and v is not None else v for k, v in c.items()}) for c in data["columns"]]
        return cls(tuple(made), data.get("label_column"))

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        return cls.from_dict(json.loads(text))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(attr, name, kind, cardinality), a row for each attribute."""
        rows = [(i, a.name, a.kind, a.cardinality) for i, a in enumerate(self.attributes)]
        return spark.createDataFrame(rows, "attr int, name string, kind string, cardinality int")
