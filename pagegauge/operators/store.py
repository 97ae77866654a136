"""Stored documents: promoted columns plus a JSON remainder, lookups, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as ST

from pagegauge.functions.joins import first_by
from pagegauge.functions.text import fingerprint


def pack_props(df: DataFrame, columns: list[str], props: str = "props") -> DataFrame:
    """Keep the declared columns; everything else goes into one JSON column."""
    rest = [c for c in df.columns if c not in columns]
    packed = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return df.select(*[c for c in columns if c in df.columns], packed.alias(props))


def unpack_props(df: DataFrame, schema: ST.StructType | str, props: str = "props") -> DataFrame:
    """Lift JSON fields to columns. A promoted column wins over a field of its name."""
    if isinstance(schema, str):
        schema = ST.StructType.fromDDL(schema)
    parsed = df.withColumn("_p", F.from_json(props, schema))
    own = [c for c in df.columns if c != props]
    lifted = [
        F.col(f"_p.{f}").alias(f) for f in schema.fieldNames() if f not in own and f != "id"
    ]
    kept = [F.coalesce(F.col(c), F.col(f"_p.{c}")).alias(c) if c in schema.fieldNames() and c != "id" else F.col(c)
            for c in own]
    return parsed.select(*kept, *lifted)


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Fingerprint of url + title for items that have none."""
    have = "fingerprint" in df.columns
    made = fingerprint(F.col("url"), F.col("title"))
    return df.withColumn("fingerprint", F.coalesce(F.when(F.col("fingerprint") != "", F.col("fingerprint")), made) if have else made)


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Items whose id is in `ids`."""
    return df.join(ids.select(key), key, "left_semi")


def lookup_fingerprint(df: DataFrame, fingerprints: DataFrame, order: str = "id") -> DataFrame:
    """First item of each wanted fingerprint."""
    wanted = df.join(fingerprints.select("fingerprint"), "fingerprint", "left_semi")
    return first_by(wanted, ["fingerprint"], [order])


def apply_changes(
    base: DataFrame, changes: DataFrame, key: list[str], seq: str = "ts", op: str = "op"
) -> DataFrame:
    """Table after a log of insert, update and delete rows.

    insert sets the item, update overwrites the fields it carries (null = not
    carried), delete removes it. An update of a missing or deleted item has no
    effect.  One aggregation by key, with partial results before the shuffle, so
    a key with very many changes does not fill a task. `updated` is the time of
    the last change, null for untouched base rows.
    """
    fields = item_fields(base, key)
    return current_items(merge_states(base_states(base, key, changes.schema[seq].dataType).unionByName(
        log_states(changes, base.schema, key, seq, op)), key, fields), key, fields)


def item_fields(base: DataFrame, key: list[str]) -> list[str]:
    """Fields of an item that changes can carry."""
    return [c for c in base.columns if c not in key and c != "updated"]


def _states(rows: DataFrame, key: list[str], fields: list[str], at: Column, op: Column) -> DataFrame:
    resets = op.isin("insert", "delete")
    carried = lambda f: F.col(f).isNotNull() & (op != "delete")
    return rows.select(
        *key, F.when(resets, at).alias("_reset"), F.when(resets, op).alias("_last"), at.alias("_end"),
        *[F.when(carried(f), F.col(f)).alias(f) for f in fields], *[F.when(carried(f), at).alias(f"_at_{f}") for f in fields])


def base_states(base: DataFrame, key: list[str], seq_type: ST.DataType) -> DataFrame:
    """What the rows of a table say about their items: inserted before every change."""
    at = F.struct(F.lit(0).alias("r"), F.lit(None).cast(seq_type).alias("t"))
    return _states(base, key, item_fields(base, key), at, F.lit("insert"))


def log_states(changes: DataFrame, base: ST.StructType, key: list[str], seq: str = "ts", op: str = "op") -> DataFrame:
    """What the rows of a change log say about their items; `base` is the schema of the table."""
    fields = [c for c in base.names if c not in key and c != "updated"]
    rows = changes.select(
        *key, *[F.col(f) if f in changes.columns else F.lit(None).cast(base[f].dataType).alias(f) for f in fields],
        F.col(op).alias("_op"), F.struct(F.lit(1).alias("r"), F.col(seq).alias("t")).alias("_at"))
    return _states(rows, key, fields, F.col("_at"), F.col("_op"))


def merge_states(states: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One state per item. States of parts of a log merge to the state of the whole log, in any order and grouping."""
    aggs = [F.max("_reset").alias("_reset"), F.max_by("_last", "_reset").alias("_last"), F.max("_end").alias("_end")]
    aggs += [F.max_by(f, f"_at_{f}").alias(f) for f in fields]
    return states.groupBy(*key).agg(*aggs, *[F.max(f"_at_{f}").alias(f"_at_{f}") for f in fields])


def current_items(states: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The items that exist, with the fields set since their last insert, and the time of their last change."""
    return states.where("_last = 'insert'").select(
        *key, *[F.when(F.col(f"_at_{f}") >= F.col("_reset"), F.col(f)).alias(f) for f in fields],
        F.col("_end.t").alias("updated"))


def merge_props(base: DataFrame, changes: DataFrame, key: list[str], seq: str = "ts") -> DataFrame:
    """Shallow merge of JSON documents: per field the newest value wins.

    base and changes: key, props (JSON object), and seq for changes. Fields are
    merged as rows, first per key and field, so many changes to one item stay cheap.
    """
    entries = "map<string,string>"
    rows = base.select(*key, F.lit(None).cast(changes.schema[seq].dataType).alias("_at"), "props").unionByName(
        changes.select(*key, F.col(seq).alias("_at"), "props")
    ).select(*key, "_at", F.explode_outer(F.from_json("props", entries)).alias("field", "value"))
    # Base rows sort before every change.
    newest = rows.groupBy(*key, "field").agg(
        F.max_by("value", F.struct(F.col("_at").isNotNull(), "_at")).alias("value")
    )
    pairs = F.sort_array(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))))
    return newest.groupBy(*key).agg(F.map_from_entries(pairs).alias("props"))


def touch(df: DataFrame) -> DataFrame:
    """Set `updated` to now."""
    return df.withColumn("updated", F.current_timestamp())
