"""Column roles and code domains: the only metadata kept on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CELLS = 1_000_000


@dataclass(frozen=True)
class Constraint:
    """Protected columns x independent of outcome columns y given admissible columns z."""

    x: tuple[str, ...]
    y: tuple[str, ...]
    z: tuple[str, ...] = ()

    @classmethod
    def of(cls, x, y, z=()) -> Constraint:
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
        return cls(as_tuple(x), as_tuple(y), as_tuple(z))

    @property
    def columns(self) -> tuple[str, ...]:
        return self.x + self.y + self.z


@dataclass(frozen=True)
class Domain:
    """Ordered attributes with their code counts; codes of an attribute run 0..size-1."""

    attrs: tuple[str, ...]
    sizes: tuple[int, ...]

    def __post_init__(self):
        if len(set(self.attrs)) != len(self.attrs):
            raise ValueError(f"attribute names repeat: {self.attrs}")
        if len(self.attrs) != len(self.sizes):
            raise ValueError("every attribute needs one size")

    @classmethod
    def of(cls, sizes: Mapping[str, int]) -> Domain:
        return cls(tuple(sizes), tuple(int(n) for n in sizes.values()))

    @classmethod
    def from_json(cls, path: str) -> Domain:
        with open(path) as handle:
            return cls.of(json.load(handle))

    def __getitem__(self, attr: str) -> int:
        return self.sizes[self.attrs.index(attr)]

    def project(self, attrs: Iterable[str]) -> Domain:
        attrs = tuple(attrs)
        return Domain(attrs, tuple(self[a] for a in attrs))

    def size(self, attrs: Iterable[str] | None = None) -> int:
        return prod(self.sizes if attrs is None else (self[a] for a in attrs))

    def strides(self, attrs: Iterable[str]) -> list[tuple[str, int]]:
        """Row-major stride of each attribute of a clique (last attribute varies fastest)."""
        attrs = tuple(attrs)
        return [(a, self.size(attrs[i + 1 :])) for i, a in enumerate(attrs)]

    def cell(self, attrs: Iterable[str]) -> Column:
        """Row-major cell number of a clique as a bigint expression over code columns."""
        total = F.lit(0).cast("bigint")
        for attr, stride in self.strides(attrs):
            total = total + F.col(attr).cast("bigint") * F.lit(stride).cast("bigint")
        return total

    def decode(self, attrs: Iterable[str], cell: str = "cell") -> list[Column]:
        """Code columns back from a cell number."""
        return [
            F.expr(f"cast((`{cell}` div {stride}L) % {self[attr]}L as int)").alias(attr)
            for attr, stride in self.strides(attrs)
        ]

    def in_range(self, attrs: Iterable[str] | None = None) -> Column:
        """True where every code lies in its domain; NULL codes are out of range."""
        keep = F.lit(True)
        for attr in attrs or self.attrs:
            keep = keep & F.coalesce(F.col(attr).between(0, self[attr] - 1), F.lit(False))
        return keep

    def schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(a, T.IntegerType(), True, {"size": n})
                for a, n in zip(self.attrs, self.sizes)
            ]
        )

    def annotate(self, df: DataFrame) -> DataFrame:
        """Attach the sizes as column metadata."""
        for attr in self.attrs:
            df = df.withMetadata(attr, {"size": self[attr]})
        return df

    @classmethod
    def from_metadata(cls, df: DataFrame) -> Domain:
        return cls.of({f.name: f.metadata["size"] for f in df.schema if "size" in f.metadata})

    def guard(self, attrs: Iterable[str] | None = None, max_cells: int = MAX_CELLS) -> int:
        """Cell count of a clique; refuses grids that are too large to lay out."""
        cells = self.size(attrs)
        if cells > max_cells:
            raise ValueError(f"{cells} cells exceed the limit of {max_cells}")
        return cells


def validate_domain(df: DataFrame, domain: Domain) -> DataFrame:
    """Rows per attribute whose code is NULL or outside 0..size-1 (one scan, no shuffle of rows)."""
    sums = [
        F.sum(F.when(domain.in_range([a]), 0).otherwise(1)).alias(a) for a in domain.attrs
    ]
    return (
        df.agg(*sums)
        .unpivot([], list(domain.attrs), "attr", "bad_rows")
        .select("attr", F.coalesce("bad_rows", F.lit(0)).cast("bigint").alias("bad_rows"))
    )
