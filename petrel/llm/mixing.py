"""Sources mixed to target shares of all tokens, as a curriculum over training positions.

Each source's weight over training time t in [0, 1] is ``share * (1 + tilt * (1 - 2 t))``;
tilts are chosen so that the weights of all sources sum to 1 at every t. Its integral is the
source's cumulative token demand. The total is the largest one at which no source must
repeat a document more than ``max_repeats`` times; a source's demand is met by whole
passes over its documents and a part of one more. Documents of a source follow each other
in hash order; a copy's place is found by inverting the source's demand at the tokens that
come before it, and documents are range-sorted by place.

Scale: tokens are counted once and written to the shared folder. Prefix sums are two-level:
sums per (source, bucket) with map-side combining, whose table is bounded by
sources x BUCKETS, then running sums inside one bucket, so a source that holds most rows is
spread over BUCKETS groups. Copies are made from a range expression, not by joins.

Defined cases: source names match without letter case, outer blanks and hyphen or underscore
differences; null or unlisted sources and documents without tokens are not used; a listed
source without documents has share 0 and the others keep their proportions; a repeated
(doc_id, text) row is a document of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrel.storage import written

BUCKETS = 256


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, source, tokens; the whole text is encoded. tokenizer: a file of ranks that every executor can read; pattern: how it splits text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer, pattern)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def source_key(source: Column) -> Column:
    return F.translate(F.lower(F.trim(source)), "-", "_")


def plan_shares(available: dict[str, int], targets: list[tuple[str, float, int]], tilt: float) -> list[dict]:
    """One row per target source: demand in tokens, normalised share and tilt."""
    live = {s: share for s, share, _ in targets if available.get(s, 0) > 0 and share > 0}
    whole = sum(live.values())
    total = min((available[s] * repeats * whole / share for s, share, repeats in targets if s in live), default=0.0)
    # early: sources with the larger half of the shares; their tilt is set off by the others'
    early, sum_early = set(), 0.0
    for s in sorted(live, key=lambda s: (-live[s], s)):
        if sum_early + live[s] <= whole / 2:
            early.add(s)
            sum_early += live[s]
    late = whole - sum_early
    rows = []
    for s, share, repeats in targets:
        own = live.get(s, 0.0) / whole if whole else 0.0
        slope = 0.0 if s not in live or not early else tilt if s in early else -tilt * sum_early / late
        rows.append({"key": s, "target_share": share, "max_repeats": repeats, "available": available.get(s, 0), "demand": own * total, "mix_share": own, "tilt": slope})
    return rows


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, pattern: str, tilt: float = 0.5) -> DataFrame:
    """doc_id, source, copy, tokens, position (tokens of the mixture before it), range-sorted by position.

    targets: source, target_share, max_repeats (one row per source: a table of the mixture's size).
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1], r[2]) for r in targets.select(source_key(F.col("source")), "target_share", "max_repeats").collect()]
    keys = [w[0] for w in wanted]
    counted = token_counts(documents.where(source_key(F.col("source")).isin(keys)).withColumn("source", source_key(F.col("source"))), tokenizer, pattern)
    order = F.xxhash64("doc_id")
    counted = written(counted.where("tokens > 0").withColumn("h", order).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int")), "mix-tokens")
    sums = counted.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens")).collect()  # at most sources x BUCKETS rows
    before: dict[tuple[str, int], int] = {}
    available: dict[str, int] = {}
    for s, b, n in sorted(sums):
        before[(s, b)] = available.get(s, 0)
        available[s] = available.get(s, 0) + n
    offsets = spark.createDataFrame([(s, b, n) for (s, b), n in before.items()] or [("", 0, 0)], "source string, bucket int, bucket_before bigint")
    plan = plan_shares(available, wanted, tilt)
    shares = spark.createDataFrame([(p["key"], float(p["available"]), float(p["demand"]), float(p["mix_share"]), float(p["tilt"])) for p in plan], "source string, available double, demand double, mix_share double, tilt double")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), ["source", "bucket"]).join(F.broadcast(shares), "source").withColumn("before", F.col("bucket_before") + F.col("inside"))
    # copy c is used if fewer than ``demand`` tokens of its source come before it
    copies = F.greatest(F.lit(0), F.ceil((F.col("demand") - F.col("before")) / F.col("available"))).cast("int")
    placed = placed.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    ahead = F.col("before") + (F.col("copy") - 1) * F.col("available")
    u = F.least(F.lit(1.0), ahead / F.col("demand"))  # of the source's demand, the part that comes before
    # u = t + tilt * (t - t^2), solved for t
    a = F.col("tilt")
    t = F.when(F.abs(a) < 1e-9, u).otherwise(((1 + a) - F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * u))) / (2 * a))
    total = sum(p["demand"] for p in plan)
    return placed.select("doc_id", "source", "copy", "tokens", (t * total).alias("position")).sort("position", "doc_id", "copy")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and actual share of all tokens, documents, copies and most copies of one document."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("copies"))
    used = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_repeats"))
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("actual_share"),
    )
