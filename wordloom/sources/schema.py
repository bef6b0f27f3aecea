"""Which fields of a row are indexed, shown and linked."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Schema:
    indexed_fields: tuple[str, ...] = ("title", "body")
    metadata_fields: tuple[str, ...] = ()
    url_field: str = "url"

    def __post_init__(self) -> None:
        if not self.indexed_fields:
            raise SchemaError("indexed_fields is empty")
        if not self.url_field:
            raise SchemaError("url_field is empty")
        every = [*self.indexed_fields, *self.metadata_fields, self.url_field]
        if twice := sorted({f for f in every if every.count(f) > 1}):
            raise SchemaError(f"named twice: {', '.join(twice)}")

    @property
    def all_fields(self) -> tuple[str, ...]:
        return (*self.indexed_fields, *self.metadata_fields, self.url_field)


def load_schema(folder: str, name: str = "wordloom.toml") -> Schema:
    """The [schema] of a TOML file beside the input; the default schema where there is no file."""
    path = Path(folder) / name
    if not path.exists():
        return Schema()
    try:
        found = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise SchemaError(f"Failed to parse {path}: {e}") from e
    try:
        s = found["schema"]
        return Schema(tuple(s["indexed_fields"]), tuple(s["metadata_fields"]), s["url_field"])
    except KeyError as e:
        raise SchemaError(f"{path} lacks {e}") from e
