"""Ordered computations over keys of any size.

A plain window over a key puts all its rows in one task. Here the rows of a key
are cut in order-preserving chunks (a page, a month, a block of numbers): windows
run inside a chunk, one summary row per chunk carries the state over, and a join
on (key, chunk) adds it. Keys and chunks are given names without nulls first, so
that windows and join need the same partitioning and the full rows move once.
Numbered chunks are grouped in blocks in the same way, so even the summaries of a
key that holds most of the data are short.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from ..session import stored

# chunks per block of the second level
BLOCK = 4096

_SUM, _LAST, _FIRST = "sum", "last", "first"
_PLACE = "_place"


def _without_nulls(df: DataFrame, columns: Sequence[str], prefix: str, ordered: bool = False) -> tuple[DataFrame, list[str]]:
    """Adds columns that are equal exactly where the given ones are both null or equal, and never null.

    `ordered`: sorted by them, nulls come first; otherwise values come first, since a sort tells most rows apart by
    its first column. A null-safe comparison would hash other expressions than a window does, and so
    move all rows once more.
    """
    defaults = ((T.NumericType, 0), (T.StringType, ""), (T.BooleanType, False), (T.DateType, "1970-01-01"), (T.TimestampType, "1970-01-01"))
    added, names, schema = {}, [], df.schema
    for i, c in enumerate(columns):
        kind = schema[c].dataType
        default = next((v for k, v in defaults if isinstance(kind, k)), None)
        if default is None:
            added[f"{prefix}{i}"] = F.struct(F.col(c))  # a struct compares its fields with null as a value
            names.append(f"{prefix}{i}")
        else:
            added[f"{prefix}{i}_is"] = F.col(c).isNotNull()
            added[f"{prefix}{i}"] = F.coalesce(F.col(c), F.lit(default).cast(kind))
            names += [f"{prefix}{i}_is", f"{prefix}{i}"] if ordered else [f"{prefix}{i}", f"{prefix}{i}_is"]
    return df.withColumns(added), names


def _exclusive(
    df: DataFrame, keys: list[str], order: list[str], items: list[tuple[str, str, str]], levels: list[list[str]],
    facts: DataFrame | None = None,
) -> DataFrame:
    """Adds, per item (kind, column, new), the sum or last value of earlier rows or the first value of later rows.

    Each of `levels` are columns, of growing coarseness, that do not decrease along the order; each level is
    determined by the one before it. Neither they nor the keys are null. `facts` per key meet the coarsest level and
    come down with what is carried.
    """
    chunk = levels[0] if levels else []
    part = [*keys, *chunk]
    ahead = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = (
        Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def local(kind: str, column: str) -> Column:
        if kind == _SUM:
            return F.coalesce(F.sum(column).over(ahead), F.lit(0))
        return F.last(column, ignorenulls=True).over(ahead if kind == _LAST else behind)

    if not levels:
        scanned = df.withColumns({new: local(kind, column) for kind, column, new in items})
        return scanned if facts is None else scanned.join(facts, keys, "left")

    # a plain column keeps the aggregation hash-based
    slots = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    aggregates = []
    for kind, column, new in items:
        at = F.when(F.col(column).isNotNull(), slots)
        value = {_SUM: F.sum(column), _LAST: F.max_by(column, at), _FIRST: F.min_by(column, at)}[kind]
        aggregates.append(value.alias(f"_v_{new}"))
    summary = df.groupBy(*keys, *(c for level in levels for c in level)).agg(*aggregates)
    carried = _exclusive(
        summary, keys, chunk, [(kind, f"_v_{new}", f"_c_{new}") for kind, _, new in items], levels[1:], facts)
    named = {c: f"_of_{c}" for c in part}
    told = [] if facts is None else [c for c in facts.columns if c not in keys]
    carried = carried.select(*[F.col(c).alias(k) for c, k in named.items()], *[f"_c_{new}" for _, _, new in items], *told)

    same = [F.col(c) == F.col(k) for c, k in named.items()]
    joined = df.withColumns({f"_l_{new}": local(kind, column) for kind, column, new in items}).join(carried, same).drop(*named.values())
    final = {
        new: F.col(f"_l_{new}") + F.col(f"_c_{new}") if kind == _SUM else F.coalesce(f"_l_{new}", f"_c_{new}")
        for kind, _, new in items
    }
    return joined.withColumns(final).drop(*[f"{p}_{new}" for _, _, new in items for p in ("_l", "_c")])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str | Column,
    order: Sequence[str],
    number: str | None = None,
    running: Mapping[str, str] | None = None,
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
    block: Column | None = None,
    facts: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Positions, running sums and nearest earlier / later values per key.

    `chunk` must not decrease along the order and `order` must be unique inside a
    chunk. `number`: 1-based position. `running`: {new: column}, sum up to and
    including the row, nulls as 0. `before` / `after`: {new: column}, the last
    non-null value on an earlier row / the first one on a later row. `block`: what groups
    the chunks of a key at the second level, a number that a chunk determines; chunks that are
    numbers are grouped by `BLOCK` without it. `facts`: columns per key, one row each, added to every row of the key; they travel
    with the summaries, so the rows do not move for them. `placed`: keeps the columns the rows are partitioned by (`places_of`).
    """
    columns = list(df.columns)
    prepared = {"_chunk": F.col(chunk) if isinstance(chunk, str) else chunk}
    items: list[tuple[str, str, str]] = []
    final: dict[str, Column] = {}
    if number:
        prepared["_one"] = F.lit(1).cast("long")
        items.append((_SUM, "_one", "_number"))
        final[number] = F.col("_number") + 1
    for i, (new, column) in enumerate((running or {}).items()):
        prepared[f"_add{i}"] = F.coalesce(F.col(column), F.lit(0))
        items.append((_SUM, f"_add{i}", f"_sum{i}"))
        final[new] = F.col(f"_sum{i}") + F.col(f"_add{i}")
    for i, (new, column) in enumerate((before or {}).items()):
        items.append((_LAST, column, f"_last{i}"))
        final[new] = F.col(f"_last{i}")
    for i, (new, column) in enumerate((after or {}).items()):
        items.append((_FIRST, column, f"_first{i}"))
        final[new] = F.col(f"_first{i}")
    if block is not None:
        prepared["_block"] = block
    df, places = _without_nulls(df.withColumns(prepared), keys, "_k")
    df, chunks = _without_nulls(df, ["_chunk"], "_chunk", ordered=True)
    levels = [chunks]
    if block is None and isinstance(df.schema["_chunk"].dataType, T.IntegralType):
        # a null chunk comes before all others
        df = df.withColumn("_block", F.coalesce(F.floor(F.col("_chunk") / BLOCK), F.lit(-(2**63)).cast("long")))
    if "_block" in df.columns:
        levels.append(["_block"])
    told = [] if facts is None else [c for c in facts.columns if c not in keys]
    if facts is not None:
        facts = _without_nulls(facts, keys, "_k")[0].drop(*keys)
    scanned = _exclusive(df.drop("_chunk"), places, list(order), items, levels, facts)
    kept = [c for c in columns if c not in final and not (placed and c.startswith(_PLACE))]
    where = [F.col(c).alias(f"{_PLACE}{i}") for i, c in enumerate([*places, *chunks])] if placed else []
    return scanned.select(*kept, *told, *[col.alias(new) for new, col in final.items()], *where)


def places_of(df: DataFrame) -> list[str]:
    """The columns that `ordered_scan` has partitioned the rows by, if it was told to keep them.

    They follow from key and chunk; a grouping that names them too finds its rows together.
    """
    return [c for c in df.columns if c.startswith(_PLACE)]


def range_chunks(df: DataFrame, order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The rows, stored in order, with `_range`: the number of the part of the order a row lies in.

    Parts are about equal in rows, whatever the values. A stored number stays the same if rows are read again.
    """
    tasks = tasks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def stored_and_measured(df: DataFrame, label: str = "facts") -> tuple[DataFrame, int]:
    """The rows, stored, and the bytes they take uncompressed, measured by the same job."""
    seen = Observation()
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    kept = stored(df.observe(seen, F.coalesce(F.sum(width), F.lit(0)).alias("bytes")), label)
    return kept, seen.get["bytes"]


def spread_by_page(
    df: DataFrame, per_document: DataFrame, how: str = "inner", document: str = "doc_id", page: str = "page",
    pages: DataFrame | None = None,
) -> DataFrame:
    """Join per-document facts to page-level rows without meeting on the document.

    The facts are stored and measured. What is within the session's broadcast threshold is broadcast. Beyond it they are first
    given to each (document, page), a table far smaller than `df`; the large side then joins on both columns, so the
    rows of one huge document stay spread over its pages. A task hashes the facts of its pages and passes the rows by, so
    the large side is not sorted and cannot spill. `pages` has the same pages as `df`, if they are cheaper to list there.
    """
    facts, size = stored_and_measured(per_document)
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if size <= limit:
        return df.join(F.broadcast(facts), document, how)
    # told what to do, since the planner would judge the facts by their compressed files
    pages = (df if pages is None else pages).select(document, page).distinct().join(facts.hint("merge"), document).hint("shuffle_hash")
    return df.join(pages, [document, page], how)
