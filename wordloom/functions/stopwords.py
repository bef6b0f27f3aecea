"""Words that are left out of an index (never of a query or a title)."""

from __future__ import annotations

from pathlib import Path


def load(path: str | Path) -> tuple[str, ...]:
    """White-space separated words of a file."""
    return tuple(sorted(set(Path(path).read_text(encoding="utf-8").split())))


#: The English words of the list beside this file, by length and then in order.
ENGLISH = load(Path(__file__).with_name("stopwords_en.txt"))
