"""Row types and the scenario that maps a source table onto points."""

from __future__ import annotations

import re
from dataclasses import dataclass

SPARSE_TYPE = "struct<indices: array<int>, values: array<float>>"
POINT_SCHEMA = (
    "id bigint, dense array<float>, sparse " + SPARSE_TYPE + ", "
    "text string, label string, payload map<string,string>"
)

# Result limits and defaults of the search API.
DEFAULT_LIMIT = 10
MAX_LIMIT = 1000
OVER_FETCH = 2
LABEL_EXAMPLES = 5
SCROLL_PAGE = 100
DEFAULT_SHARDS = 4
UNKNOWN_LABEL = "unknown"

_NAME = re.compile(r"[\w-]*[^\W_][\w-]*")


def check_collection_name(name: str) -> str:
    """Letters, digits, ``_`` and ``-``, with at least one letter or digit."""
    if not name or not _NAME.fullmatch(name):
        raise ValueError(
            f"collection name {name!r}: use letters, digits, underscores and hyphens"
        )
    return name


@dataclass(frozen=True)
class Scenario:
    """Which columns of a source become text, label and payload fields."""

    name: str
    text_column: str
    collection_name: str
    label_column: str | None = None
    metadata_columns: tuple[str, ...] = ()
    enable_sparse: bool = False
    recreate: bool = False

    def __post_init__(self) -> None:
        if not self.text_column or not self.text_column.strip():
            raise ValueError("text_column must not be blank")
        check_collection_name(self.collection_name)

    @property
    def columns(self) -> list[str]:
        """Every source column the scenario reads, text first."""
        label = [self.label_column] if self.label_column else []
        return [self.text_column, *label, *self.metadata_columns]
