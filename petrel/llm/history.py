"""New batches against all history by content-defined chunks.

A payload's words are cut where a rolling hash of the last words hits a mask, so an edit
moves only the boundaries next to it. Keys are hashes of a chunk with its next or next but
one neighbour (some 16 words, rare among unrelated texts); of short texts, hashes of every window of eight words. The chunk table
(key, text, bytes) is kept; a new text's keys are joined with it, shared bytes are summed
per pair, and pairs that cover at least ``COVERAGE`` of a text go on to the exact check: word
edit distance at most one in twenty of the longer text. New chunks are then appended.

Scale: exact copies, of which a group may hold a third of all rows, are folded into one text
(digest, first batch) by partial aggregation before anything is chunked. A key held by more
than HOT texts is not joined as a group: its texts first meet only the HOT earliest ones, which
settles families of near-copies; the texts still open then meet the rest of the group, so
nothing is lost. Only texts of candidate pairs are fetched again for the check. Every join is a
merge join: Spark judges a stored table by its compressed file and counts an array as one number,
so word hashes or pairs of any size would pass as small and be sent through the driver.

Defined cases: null contents are no payload; payloads without words equal only each other;
letter case, punctuation and spacing do not count; a null batch is the last one; repeated
rows of one batch do not find each other; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.llm.pages import text_of
from petrel.llm.words import hash64, mixed, window_hashes, words
from petrel.storage import written

#: Chunks end where the hash of two words has its low bits at 0; lengths in words.
MASK, MIN_CHUNK, MAX_CHUNK = 3, 5, 16
COVERAGE, EDITS_PER_WORD, HOT = 0.1, 1 / 20, 32
#: Below SHORT words chunks are too few: there every window of WINDOW words is a key. Of n such words with n // 20 edits
#: at least one window is left whole. The two ranges overlap, so that texts near the limit still meet.
SHORT, OVERLAP, WINDOW = 120, 8, 8
LAST_BATCH = 2**31 - 1


def chunk_ends(tokens: np.ndarray) -> list[int]:
    """Where content-defined chunks end (exclusive)."""
    n = len(tokens)
    if not n:
        return []
    with np.errstate(over="ignore"):
        rolling = mixed(tokens[1:] + tokens[:-1] * np.uint64(31)) if n > 1 else np.empty(0, np.uint64)
    ends, begin = [], 0
    for e in (np.flatnonzero((rolling & np.uint64(MASK)) == 0) + 2).tolist():
        while e - begin > MAX_CHUNK:
            begin += MAX_CHUNK
            ends.append(begin)
        if e - begin >= MIN_CHUNK:
            ends.append(e)
            begin = e
    while n - begin > MAX_CHUNK:
        begin += MAX_CHUNK
        ends.append(begin)
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def chunk_keys(token_hashes: np.ndarray) -> list[tuple[int, int]]:
    """(key, words of its chunks) of every chunk with each of its next two neighbours; of short texts every window of words."""
    n, out = len(token_hashes), {}
    if n < SHORT + OVERLAP:
        out = {int(h) - (1 << 63): min(n, WINDOW) for h in window_hashes(token_hashes, min(n, WINDOW))}
    if n < SHORT:
        return list(out.items())
    ends = chunk_ends(token_hashes)
    begins = [0, *ends[:-1]]
    own = [xxhash.xxh64_intdigest(token_hashes[a:b].tobytes()) for a, b in zip(begins, ends)]
    for i in range(len(own) - 1):
        for gap in (1, 2):
            if i + gap < len(own):
                key = xxhash.xxh64_intdigest(np.array([own[i], own[i + gap], gap], np.uint64).tobytes()) - (1 << 63)
                out.setdefault(key, ends[i] - begins[i] + ends[i + gap] - begins[i + gap])
    return list(out.items())


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edit distance if it is at most ``limit``: furthest-reaching points per diagonal and cost."""
    if abs(len(a) - len(b)) > limit:
        return None
    x, y = a.tolist(), b.tolist()
    n, m = len(x), len(y)

    def slide(i: int, k: int) -> int:
        while i < n and i + k < m and x[i] == y[i + k]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    for cost in range(limit + 1):
        if reach.get(m - n, -1) >= n:
            return cost
        nxt = {}
        for k in range(-cost - 1, cost + 2):
            best = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if best < 0:
                continue
            best = min(best, n, m - k)
            if best >= 0 and best + k >= 0:
                nxt[k] = slide(best, k)
        reach = nxt
    return None


def payload_texts(records: DataFrame) -> DataFrame:
    """row_id, batch_id, digest (16 bytes of the normalised text's hash), tokens (word hashes) of each payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, tokens = [], []
            for content in b["content"]:
                w = words(text_of(content))
                digests.append(xxhash.xxh3_128_digest(" ".join(w).encode()))
                tokens.append(np.fromiter((hash64(x) & 0x7FFFFFFF for x in w), np.int32, len(w)))
            yield pd.DataFrame({"row_id": b["row_id"], "batch_id": b["batch_id"], "digest": digests, "tokens": tokens})

    rows = records.where(F.col("content").isNotNull()).select("row_id", F.coalesce("batch_id", F.lit(LAST_BATCH)).alias("batch_id"), "content")
    return rows.mapInPandas(run, "row_id bigint, batch_id int, digest binary, tokens array<int>")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per normalised text: digest, id, first_batch, last_batch, tokens."""
    one = texts.groupBy("digest").agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.first("tokens").alias("tokens"))
    return one.select("digest", F.xxhash64("digest").alias("id"), "first_batch", "last_batch", "tokens")


def chunk_table(texts: DataFrame) -> DataFrame:
    """The persistent table: key, id, first_batch, share (of the text's words in the key's chunks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, firsts, keys, shares = [], [], [], []
            for text_id, first, tokens in zip(b["id"], b["first_batch"], b["tokens"]):
                t = np.asarray(tokens, np.int64).astype(np.uint64)
                if not len(t):
                    continue
                for key, n in chunk_keys(t):
                    ids.append(text_id)
                    firsts.append(first)
                    keys.append(key)
                    shares.append(n / len(t))
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "id": pd.Series(ids, dtype="int64"), "first_batch": pd.Series(firsts, dtype="int32"), "share": pd.Series(shares, dtype="float32")})

    return texts.select("id", "first_batch", "tokens").mapInPandas(run, "key bigint, id bigint, first_batch int, share float")


def _matched(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that no estimate turns into a broadcast."""
    return left.join(right.hint("merge"), on, how)


def _covered(pairs: DataFrame) -> DataFrame:
    """Pairs (id, other) whose shared chunks cover enough of the text."""
    return pairs.groupBy("id", "other").agg(F.sum("share").alias("coverage")).where(F.col("coverage") >= COVERAGE).select("id", "other")


def verified(pairs: DataFrame, texts: DataFrame, others: DataFrame) -> DataFrame:
    """id of the texts within the allowed edits of one of their candidates; only texts of candidate pairs are fetched."""
    pairs = written(pairs, "candidate-pairs")
    mine = texts.select("id", F.col("tokens").alias("a"))
    theirs = others.select(F.col("id").alias("other"), F.col("tokens").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [
                i for i, a, b in zip(batch["id"], batch["a"], batch["b"])
                if edit_distance_within(np.asarray(a), np.asarray(b), int(max(len(a), len(b)) * EDITS_PER_WORD + 1e-9)) is not None
            ]
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64")})

    return _matched(_matched(pairs, mine, "id"), theirs, "other").select("id", "a", "b").mapInPandas(run, "id bigint").distinct()


def near_earlier(texts: DataFrame, chunks: DataFrame, held_texts: DataFrame | None = None, held_chunks: DataFrame | None = None) -> DataFrame:
    """id of each text that a text first seen in an earlier batch comes near: one of ``texts``, or of those held in history."""
    chunks, everyone = chunks.withColumn("new", F.lit(True)), texts
    if held_chunks is not None:
        # of history only what shares a key with the new texts takes part
        asked = chunks.select("key").distinct()
        chunks = chunks.unionByName(_matched(held_chunks, asked, "key", "left_semi").withColumn("new", F.lit(False)))
        everyone = texts.select("id", "tokens").unionByName(held_texts.select("id", "tokens"))
    held = chunks.groupBy("key").agg(F.count("*").alias("n"), F.min("first_batch").alias("since")).where("n > 1")
    # a key matters to texts that came after its first holder; keys of one text are dropped by the join
    shared = written(_matched(chunks, held, "key"), "shared-chunks")
    first = Window.partitionBy("key").orderBy("first_batch", "id")
    # the HOT earliest texts of each key; for all but hot keys these are all texts
    heads = shared.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HOT).select("key", F.col("id").alias("other"), F.col("first_batch").alias("other_batch"))
    later = shared.where(F.col("new") & (F.col("first_batch") > F.col("since"))).select("key", "id", "first_batch", "share", "n")
    met = _matched(later, heads, "key").where("other_batch < first_batch").select("id", "other", "share")
    near = written(verified(_covered(met), texts, everyone), "near-texts")
    # exact rest: texts that are still open meet the later texts of their hot keys; what such a pair shares in heads counts too
    hot = shared.where(F.col("n") > HOT)
    tails = _matched(hot.select("key", F.col("id").alias("other"), F.col("first_batch").alias("other_batch")), heads.select("key", "other"), ["key", "other"], "left_anti")
    still = _matched(later.where(F.col("n") > HOT), near, "id", "left_anti")
    rest = written(_matched(still, tails, "key").where("other_batch < first_batch").groupBy("id", "other").agg(F.sum("share").alias("share")), "tail-pairs")
    rest = rest.unionByName(_matched(met, rest.select("id", "other"), ["id", "other"], "left_semi"))
    return near.unionByName(verified(_covered(rest), texts, everyone)).distinct()


def repeated_payloads(records: DataFrame) -> DataFrame:
    """row_id and how (exact, near) of every row whose payload an earlier batch holds."""
    rows = payload_texts(records)
    rows = written(rows, "payloads")
    texts = written(distinct_texts(rows), "payload-texts")
    near = near_earlier(texts, chunk_table(texts)).withColumn("near", F.lit(True))
    state = _matched(texts.select("digest", "id", "first_batch"), near, "id", "left").select("digest", "first_batch", "near")
    both = _matched(rows.select("row_id", "batch_id", "digest"), state, "digest")
    how = F.when(F.col("batch_id") > F.col("first_batch"), F.lit("exact")).when(F.col("near"), F.lit("near"))
    return both.select("row_id", how.alias("how")).where(F.col("how").isNotNull())


# --- batch by batch, with tables that stay -----------------------------------------------

_TEXTS = "digest binary, id bigint, first_batch int, last_batch int, tokens array<int>"
_CHUNKS = "key bigint, id bigint, first_batch int, share float"


def history(spark: SparkSession, store: str, before: int) -> tuple[DataFrame, DataFrame]:
    """(texts, chunks) of all deliveries with a smaller number; empty ones if there are none."""

    def read(name: str, schema: str) -> DataFrame:
        try:
            held = spark.read.schema(f"{schema}, delivery int").parquet(f"{store}/{name}")
            return held.where(F.col("delivery") < before).drop("delivery")
        except AnalysisException as error:  # nothing was stored so far
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schema)

    return read("texts", _TEXTS), read("chunks", _CHUNKS)


def check_batch(batch: DataFrame, store: str, number: int) -> DataFrame:
    """row_id and how of the rows of a delivery that repeat what earlier batches hold; keeps the delivery's new texts.

    ``store`` is a shared folder with two Parquet tables, texts and chunks, one folder per delivery
    ``number``. A delivery holds one batch or several and is compared with deliveries of smaller numbers and
    with earlier batches of its own. Running a number again, after a failure or by mistake, gives the same rows and
    overwrites its own folders; history is neither chunked nor hashed again.
    """
    spark = batch.sparkSession
    held_texts, held_chunks = history(spark, store, number)
    rows = written(payload_texts(batch), "batch")
    texts = written(distinct_texts(rows), "batch-texts")
    known = held_texts.select("digest", F.col("first_batch").alias("held_batch"))
    fresh = written(_matched(texts, known, "digest", "left_anti"), "batch-fresh")
    chunks = written(chunk_table(fresh), "batch-chunks")
    near = near_earlier(fresh, chunks, held_texts, held_chunks).withColumn("near", F.lit(True))
    state = _matched(_matched(texts.select("digest", "id", "first_batch"), near, "id", "left"), known, "digest", "left")
    state = state.select("digest", F.least("first_batch", "held_batch").alias("first_batch"), "near")
    how = F.when(F.col("batch_id") > F.col("first_batch"), F.lit("exact")).when(F.col("near"), F.lit("near"))
    found = _matched(rows.select("row_id", "batch_id", "digest"), state, "digest").select("row_id", how.alias("how")).where(F.col("how").isNotNull())
    found = written(found, "batch-found")
    fresh.write.mode("overwrite").parquet(f"{store}/texts/delivery={number}")
    chunks.write.mode("overwrite").parquet(f"{store}/chunks/delivery={number}")
    return found
