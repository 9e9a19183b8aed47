"""Row filters over knowledge-base tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import access, text


@dataclass(frozen=True)
class Filter:
    """Who asks, and for what. The caller's identity always overrides what a request says about it (see bound())."""

    workspace_id: str = ""
    subject: str = ""
    roles: Sequence[str] = ()
    tags: Sequence[str] = ()
    sources: Sequence[str] = ()
    updated_after: str | None = None
    ids: Sequence[str] = field(default=())

    def bound(self, workspace_id: str, subject: str, roles: Sequence[str]) -> Filter:
        """This filter with the authenticated identity, blanks dropped."""
        clean = lambda xs: tuple(x.strip() for x in xs if x.strip())
        return Filter(workspace_id, subject, clean(roles), clean(self.tags), clean(self.sources), self.updated_after, tuple(self.ids))

    #: Columns that the conditions read, beside that of ids.
    COLUMNS: ClassVar[tuple[str, ...]] = ("workspace_id", "acl_allow", "tags", "source", "updated_at")

    def apply(self, df: DataFrame, id_column: str = "uri") -> DataFrame:
        """Rows that the caller may see and asks for; all conditions reach the scan where it can use them. No subject: nothing is visible."""
        return df.where(self.condition(id_column))

    def condition(self, id_column: str = "uri") -> Column:
        who = access.principals(F.lit(self.subject), F.array(*map(F.lit, self.roles)).cast("array<string>"))
        keep = access.readable(F.col("acl_allow"), who) & access.any_tag(F.col("tags"), list(self.tags)) & access.any_source(F.col("source"), list(self.sources))
        if self.workspace_id:
            keep = (F.col("workspace_id") == self.workspace_id) & keep
        if self.updated_after is not None:
            keep = keep & access.fresh(F.col("updated_at"), text.utc(F.lit(self.updated_after)))
        if self.ids:
            keep = keep & F.col(id_column).isin(list(self.ids))
        return keep
