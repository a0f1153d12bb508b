"""Tables that refer to each other: what a deleted row takes with it, and what it leaves without a reference."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` hold a key of ``parent`` in ``column``; when the parent's row goes they go with it, or (``keep``) lose the reference."""

    child: str
    column: str
    parent: str
    keep: bool = False


#: Relations of the stored tables (fixed values).
RELATIONS = (
    Relation("Account", "userId", "User"),
    Relation("Session", "userId", "User"),
    Relation("Search", "userId", "User", keep=True),
    Relation("Search", "researchId", "ResearchSession", keep=True),
    Relation("ResearchSession", "userId", "User", keep=True),
    Relation("ResearchSource", "researchId", "ResearchSession"),
    Relation("ResearchClaim", "researchId", "ResearchSession"),
    Relation("SavedSearch", "userId", "User"),
    Relation("Feedback", "userId", "User", keep=True),
    Relation("Feedback", "researchId", "ResearchSession"),
    Relation("UsageRecord", "userId", "User", keep=True),
    Relation("PartIdentification", "userId", "User", keep=True),
)


def delete_rows(tables: dict[str, DataFrame], keys: dict[str, str], gone: dict[str, DataFrame], relations=RELATIONS) -> dict[str, DataFrame]:
    """``tables`` after the rows whose keys are in ``gone`` (a table of the key for each) are deleted with all that hangs on them.

    ``keys`` names each table's key. Tables are taken parents first, so each is read once: its own deleted keys, and those of rows whose
    parents go, leave by one anti-join; references that are kept become null by one left join for each. Rows without a reference stay. Relations of
    tables that are not given have no effect; tables must not refer to each other in a circle. Joins hold the deleted keys of a part of the table, each once, and
    pass its rows by: sorted, the rows of a whole part would be held.
    """
    own = [r for r in relations if r.child in tables and r.parent in tables]
    graph = {name: {r.parent for r in own if r.child == name} for name in tables}
    dead: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name in TopologicalSorter(graph).static_order():
        df, key = tables[name], keys[name]
        going = [gone[name].select(F.col(key).alias("_key"))] if name in gone else []
        for r in own:
            if r.child == name and not r.keep and r.parent in dead:
                hit = dead[r.parent].select(F.col("_key").alias(r.column)).hint("shuffle_hash")
                going.append(df.select(F.col(key).alias("_key"), r.column).join(hit, r.column, "left_semi").select("_key"))
        if going:
            all_going = going[0]
            for more in going[1:]:
                all_going = all_going.unionByName(more)
            dead[name] = all_going.where("_key is not null").distinct()
            df = df.join(dead[name].select(F.col("_key").alias(key)).hint("shuffle_hash"), key, "left_anti")
        for r in own:
            if r.child == name and r.keep and r.parent in dead:
                lost = dead[r.parent].select(F.col("_key").alias(r.column), F.lit(True).alias("_lost"))
                df = df.join(lost, r.column, "left").withColumn(r.column, F.when(F.col("_lost").isNull(), F.col(r.column))).drop("_lost")
        out[name] = df.select(*tables[name].columns)
    return out


def follow(df: DataFrame, relation: Relation, parents: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """``df`` with the columns ``wanted`` of the parent that each row refers to; null without one."""
    return df.join(parents.select(F.col(key).alias(relation.column), *wanted), relation.column, "left").select(*df.columns, *wanted)
