"""Moving the old store into the new one, table by table in foreign-key order."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.operators import ledger as G
from modspark.operators import timeline as T
from modspark.sources.tables import align

# Order, key, conflict policy (columns updated, or None to keep the known row) and
# defaults of columns that old files lack.
STEPS = (
    ("students", ["anonymous_id"], ["enc_full_name", "enc_username", "is_banned", "total_posts", "total_replies"],
     {"is_banned": False, "total_posts": 0, "total_replies": 0}),
    ("banned_fingerprints", ["id_hash"], None, {}),
    ("admin_credentials", ["telegram_id"], ["password_hash"], {"role": "moderator"}),
    ("posts", ["channel_message_id"], None, {"is_deleted": False, "status": "published"}),
    ("replies", ["reply_channel_msg_id"], None, {"is_deleted": False, "status": "published"}),
    ("audit_logs", ["id"], None, {}),
    ("system_settings", ["key"], ["value"], {}),
)


def moved(known: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None) -> DataFrame:
    """``rows`` entered into ``known`` one by one, by id (or by all columns where there is none).

    A new key enters with its first row; further rows of a key, and rows of known keys, change the
    ``update`` columns only, the last one winning. Null keys never conflict: all their rows enter.
    """
    order = [F.col(c) for c in (["id"] if "id" in rows.columns else []) + rows.columns]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed = rows.where(whole)
    first = T.earliest(keyed, keys, *order)
    if update:
        last = T.latest(keyed, keys, *order).select(*keys, *update)
        out = G.upsert(known.where(whole), first.drop(*update).join(last, keys).select(*rows.columns), keys, update)
    else:
        out = G.insert_if_absent(known.where(whole), first, keys)
    return out.unionByName(known.where(~whole)).unionByName(rows.where(~whole))


def plan(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New snapshot per table.  Tables the source lacks stay as they are."""
    return {
        name: moved(target[name], align(source[name], name, defaults), keys, update) if name in source else target[name]
        for name, keys, update, defaults in STEPS}


def _noted(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Table names and folders noted at ``path``; None if nothing is there. As many rows as a migration has tables."""
    try:
        return {r.name: r.path for r in spark.read.schema("name string, path string").parquet(path).collect()}
    except AnalysisException:
        return None


def _note(spark: SparkSession, path: str, rows: list[tuple[str, str]], mode: str) -> None:
    spark.createDataFrame(rows, "name string, path string").coalesce(1).write.mode(mode).parquet(path)


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished migration; none before its manifest is there."""
    return {name: spark.read.parquet(path) for name, path in (_noted(spark, f"{folder}/manifest") or {}).items()}


def migrate(spark: SparkSession, source: dict[str, DataFrame], target: dict[str, DataFrame], folder: str,
            dry_run: bool = False) -> DataFrame:
    """Stage all snapshots below a new ``folder``, publish them by one manifest, and reconcile the counts.

    A table is noted once it is staged whole, so a run that broke goes on at its table when it is
    started again; what it left half-written is passed by. A folder that holds other tables, or a
    published migration, is refused. A dry run plans and counts, and writes nothing.
    """
    snapshots = plan(source, target)
    if not dry_run:
        if _noted(spark, f"{folder}/manifest") is not None:
            raise ValueError("this migration is published already")
        staged = _noted(spark, f"{folder}/staged")
        resumed, staged = staged is not None, staged or {}
        for name, df in snapshots.items():
            if name in staged:
                continue
            path = f"{folder}/{name}" + (f"-{uuid.uuid4().hex}" if resumed else "")
            if not staged:
                _note(spark, f"{folder}/staged", [], "append")
            df.write.mode("errorifexists").parquet(path)
            _note(spark, f"{folder}/staged", [(name, path)], "append")
            staged[name] = path
        _note(spark, f"{folder}/manifest", list(staged.items()), "errorifexists")
        snapshots = published(spark, folder)
    names = [name for name, *_ in STEPS if name in source]
    return G.reconcile(
        G.table_counts(spark, {n: source[n] for n in names}),
        G.table_counts(spark, {n: snapshots[n] for n in names}))


def high_water_marks(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """A5: name, largest value of a column, or its default for an empty table."""
    parts = [df.agg(F.lit(name).alias("name"), F.coalesce(F.max(column), F.lit(default)).cast("bigint").alias("mark"))
             for name, (df, column, default) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
