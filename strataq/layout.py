"""Physical layout: row groups, sort key, indexes, forced encodings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from strataq.errors import Invalid
from strataq.functions.sizes import ENCODINGS, supports
from strataq.schema import Schema


@dataclass(frozen=True)
class Layout:
    group_rows: int = 65_536
    sample_rows: int = 1_024
    sort_key: tuple[int, ...] = ()
    statistics: tuple[int, ...] = ()
    bloom: tuple[int, ...] = ()
    forced: Mapping[int, str] = field(default_factory=dict)

    def validate(self, schema: Schema) -> "Layout":
        if self.group_rows <= 0 or self.sample_rows <= 0:
            raise Invalid("layout.rows", "group and sample sizes must be positive")
        for what in ("sort_key", "statistics", "bloom"):
            ids = getattr(self, what)
            if len(set(ids)) != len(ids):
                raise Invalid(f"layout.{what}", "a field id is listed twice")
            for i in ids:
                schema.by_id(i, f"layout.{what}")
        for i in self.sort_key:
            if schema.by_id(i).nullable:
                raise Invalid("layout.sort_key", f"field {i} of the sort key may be null")
        for i, encoding in self.forced.items():
            if encoding not in ENCODINGS:
                raise Invalid("layout.forced", f"unknown encoding {encoding!r}")
            if not supports(encoding, schema.by_id(i, "layout.forced").kind):
                raise Invalid("layout.forced", f"{encoding} can't hold {schema.by_id(i).kind}")
        return self

    def to_json(self) -> dict:
        return {
            "group_rows": self.group_rows,
            "sample_rows": self.sample_rows,
            "sort_key": list(self.sort_key),
            "statistics": list(self.statistics),
            "bloom": list(self.bloom),
            "forced": {str(k): v for k, v in self.forced.items()},
        }

    @staticmethod
    def from_json(x: dict) -> "Layout":
        return Layout(x["group_rows"], x["sample_rows"], tuple(x["sort_key"]), tuple(x["statistics"]), tuple(x["bloom"]), {int(k): v for k, v in x["forced"].items()})
