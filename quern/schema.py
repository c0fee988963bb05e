"""Index schemas: declared fields, stored as JSON beside the index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

TYPES = ("text", "keyword", "int64", "float32", "combined")
OPTIONS = ("none", "docs_only", "freqs_only", "freqs_positions")


@dataclass(frozen=True)
class Field:
    """One declared field. ``multi`` fields hold arrays of strings; a ``combined`` field reads the fields in ``sources``.

    A combined field is analysed unless ``verbatim`` says that the values of its sources are terms as they stand.
    """

    name: str
    type: str = "text"
    index: str = "none"
    stored: bool = False
    fast: bool = False
    multi: bool = False
    sources: tuple[str, ...] = ()
    verbatim: bool = False

    @property
    def inverted(self) -> bool:
        return self.index != "none" and self.type in ("text", "keyword", "combined")

    @property
    def analysed(self) -> bool:
        return self.type == "text" or self.type == "combined" and not self.verbatim

    @staticmethod
    def from_dict(raw: dict) -> Field:
        """Unknown types read as text, unknown index options as none."""
        kind, option = raw.get("type", "text"), raw.get("index", "none")
        return Field(raw["name"], kind if kind in TYPES else "text", option if option in OPTIONS else "none", bool(raw.get("stored")), bool(raw.get("fast")), bool(raw.get("multi")), tuple(raw.get("sources") or ()), bool(raw.get("verbatim")))


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def indexed(self) -> list[Field]:
        return [f for f in self.fields if f.inverted]

    def stored(self) -> list[Field]:
        return [f for f in self.fields if f.stored]

    def fast(self) -> list[Field]:
        return [f for f in self.fields if f.fast]

    def to_json(self) -> str:
        return json.dumps({"fields": [asdict(f) for f in self.fields]}, indent=2)

    @staticmethod
    def from_json(text: str) -> Schema:
        return Schema(tuple(Field.from_dict(f) for f in json.loads(text)["fields"]))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.to_json())

    @staticmethod
    def load(path: str | Path) -> Schema:
        """The default schema where the file is missing."""
        return Schema.from_json(Path(path).read_text()) if Path(path).exists() else default_schema()


def default_schema() -> Schema:
    return Schema(
        (
            Field("title", "text", "freqs_positions", stored=True),
            Field("body", "text", "freqs_positions"),
            Field("category", "keyword", stored=True),
            Field("source", "keyword", stored=True),
            Field("pubtime", "int64", fast=True),
            Field("uid", "int64", fast=True),
            Field("page_rank", "float32", fast=True),
        )
    )
