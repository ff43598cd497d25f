"""References to records that do not exist, kept as signed counts per key.

Every change to the store is a delta on one key: a stored record adds existence, a
takedown takes all existence away, a header that names the key adds a reference (a removed
row would subtract it). Keys with positive references and no existence are the current
orphans; the state is a plain sum, so batches of deltas may be folded in as they arrive.

Scale: keys are 16-byte UUIDs; existence is summed to one row per key before the join, and
contents are never read. References to one hot key (the warcinfo record of a huge file) all
meet a single state row; that side of the sort-merge join is the one adaptive execution
splits, and no group is ever collected.

Defined cases: null headers, names or values and values without a UUID are no references;
null record ids are no existence; repeated headers of a row count once in ``dangling`` and
once in the sums; a null batch is treated as the last one; empty tables give empty results;
only the columns named here are read, so further columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.functions.headers import uuid_bytes, uuid_text

REF_FIELDS = ("WARC-Concurrent-To", "WARC-Refers-To", "WARC-Warcinfo-ID")
LAST_BATCH = 2**31 - 1


def references(records: DataFrame, *keep: str) -> DataFrame:
    """One row per record row, header and target: row_id, batch_id, field (index), key, and ``keep``."""
    wanted = {name.lower(): i for i, name in enumerate(REF_FIELDS)}

    def field(h: Column) -> Column:
        lower = F.lower(h["name"])
        return reduce(lambda acc, x: F.when(lower == x[0], F.lit(x[1]).cast("tinyint")).otherwise(acc), wanted.items(), F.lit(None).cast("tinyint"))

    pairs = F.filter(
        F.transform("headers", lambda h: F.struct(field(h).alias("field"), uuid_bytes(h["value"]).alias("key"))),
        lambda p: p["field"].isNotNull() & p["key"].isNotNull(),
    )
    rows = records.select("row_id", F.coalesce("batch_id", F.lit(LAST_BATCH)).alias("batch_id"), *keep, F.explode(F.array_distinct(pairs)).alias("_p"))
    return rows.select("row_id", "batch_id", *keep, F.col("_p.field").alias("field"), F.col("_p.key").alias("key"))


def existence_deltas(stores: list[DataFrame], withdrawn: DataFrame) -> DataFrame:
    """Change deltas of existence: key, born (+1 per stored row), gone (rows of takedowns), batch."""
    born = [
        s.select(uuid_bytes(F.col("record_id")).alias("key"), F.lit(1).alias("born"), F.lit(0).alias("gone"), F.coalesce("batch_id", F.lit(LAST_BATCH)).alias("batch_id"))
        for s in stores
    ]
    gone = withdrawn.select(uuid_bytes(F.col("record_id")).alias("key"), F.lit(0).alias("born"), F.lit(1).alias("gone"), F.lit(None).cast("int").alias("batch_id"))
    return reduce(DataFrame.unionByName, [*born, gone]).where(F.col("key").isNotNull())


def existence_state(deltas: DataFrame) -> DataFrame:
    """One row per key: ``existing`` (0 once withdrawn), ``withdrawn``, ``first_batch``."""
    summed = deltas.groupBy("key").agg(F.sum("born").alias("born"), F.max("gone").alias("gone"), F.min("batch_id").alias("first_batch"))
    return summed.select("key", F.when(F.col("gone") > 0, F.lit(0)).otherwise(F.col("born")).alias("existing"), (F.col("gone") > 0).alias("withdrawn"), "first_batch")


def dangling(refs: DataFrame, state: DataFrame) -> DataFrame:
    """References whose target is absent, withdrawn or later, with the reason; other columns of refs are kept."""
    joined = refs.join(state, "key", "left")
    reason = (
        F.when(F.coalesce("withdrawn", F.lit(False)), F.lit("withdrawn"))
        .when(F.coalesce("existing", F.lit(0)) <= 0, F.lit("absent"))
        .when(F.col("first_batch") > F.col("batch_id"), F.lit("later"))
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("existing", "withdrawn", "first_batch")


def field_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in REF_FIELDS]), index.cast("int") + 1)


def dangling_references(records: DataFrame, stores: list[DataFrame], withdrawn: DataFrame, *keep: str) -> DataFrame:
    """row_id, ref_field, ref_id, reason (and ``keep``) of every dangling reference of ``records``."""
    found = dangling(references(records, *keep), existence_state(existence_deltas(stores, withdrawn)))
    return found.select("row_id", field_name(F.col("field")).alias("ref_field"), uuid_text(F.col("key")).alias("ref_id"), "reason", *keep)


def orphan_report(records: DataFrame, stores: list[DataFrame], withdrawn: DataFrame, period: Column) -> DataFrame:
    """Dangling references counted per header, period and reason; partial sums go first, so any skew is harmless."""
    found = dangling_references(records.withColumn("period", period), stores, withdrawn, "period")
    return found.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("refs"))


def orphan_state(records: DataFrame, stores: list[DataFrame], withdrawn: DataFrame) -> DataFrame:
    """The running table: per key, signed sums of references and existence; orphans have refs > 0 and existing = 0."""
    refs = references(records).groupBy("key").agg(F.count("*").alias("refs"))
    state = existence_state(existence_deltas(stores, withdrawn)).select("key", "existing")
    both = refs.join(state, "key", "full")
    return both.select(uuid_text(F.col("key")).alias("record_uuid"), F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("existing", F.lit(0)).alias("existing"))


def fold_state(state: DataFrame, change: DataFrame) -> DataFrame:
    """State after a change: both have record_uuid, refs, existing with signed numbers; keys that sum to nothing vanish."""
    total = state.unionByName(change).groupBy("record_uuid").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
    return total.where((F.col("refs") != 0) | (F.col("existing") != 0))
