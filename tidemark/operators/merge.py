"""Loads: keyed upsert, snapshot replacement, incremental models; versioned tables are in ``versions``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import ts
from tidemark.operators.dedupe import keep_first
from tidemark.operators.versions import CommitConflict, VersionedTable  # noqa: F401
from tidemark.sources.workdir import staged


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the rows whose key is in ``source``, and all of ``source``.

    Keys compare with =, so null keys never delete. Columns go by name; absent ones are null.
    Only the target's rows are held against the distinct keys: no row is multiplied.
    """
    kept = target.join(source.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def upsert_files(target: DataFrame, source: DataFrame, keys: list[str], path: str = "_source_file", newest: list[Column] | None = None) -> DataFrame:
    """Files loaded one after the other, as one upsert.

    A key's rows come from the last file that has it (in order of ``path``), or from the
    newest row by ``newest`` where given. Rows with a null key are all added.
    """
    named = source.dropna(subset=keys)
    rows = keep_first(named, keys, newest) if newest else _of_last_file(named, keys, path)
    nulls = source.where(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    return upsert(target, rows.unionByName(nulls), keys)


def _of_last_file(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    last = df.groupBy(*keys).agg(F.max(path).alias(path))
    return df.join(last, [*keys, path], "left_semi")


def replace_snapshot(target: DataFrame | None, source: DataFrame, capture_status: str = "completed") -> DataFrame:
    """A full snapshot replaces the target, an empty one clears it; only a completed capture may."""
    if capture_status != "completed":
        return source.limit(0) if target is None else target
    return source


def multi_target(source: DataFrame, targets: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """One processed set into several targets, each with its own key."""
    return {name: upsert(target, source, keys) for name, (target, keys) in targets.items()}


def high_watermark(df: DataFrame, cursor: Column):
    """The largest cursor value, read once and then used as a literal that reaches the scan; None if there is none."""
    return df.agg(F.max(cursor)).first()[0]


def incremental_merge(target: DataFrame, source: DataFrame, keys: list[str], transform: Callable[[DataFrame], DataFrame], *, cursor: Column | None = None, target_cursor: Column | None = None, inclusive: bool = True, floor=None) -> DataFrame:
    """An incremental model: source rows from the target's high-water mark on, transformed, replace rows of their keys.

    Without ``cursor`` the whole source is taken. ``inclusive`` takes the rows at the mark
    again (ties are redone); exclusive leaves them. ``floor`` is the mark of an empty target.
    The transformed rows are staged, as their keys and they themselves are both read. So the
    mark is read and the delta is computed when this is called, not when the result is read.
    """
    delta = source
    if cursor is not None:
        mark = high_watermark(target, target_cursor)
        mark = floor if mark is None else mark
        at = F.lit(mark) if not hasattr(mark, "isoformat") else ts(str(mark))
        delta = source.where(cursor >= at if inclusive else cursor > at)
    return upsert(target, staged(transform(delta), "delta"), keys)
