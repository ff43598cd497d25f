"""Records whose stored content ends before its real end.

Three kinds of evidence, in this order:

1. Bytes and markup: the record or its HTTP head declares more than is there, a chunked body has
   no last chunk, a compressed body does not reach its end, the page stops inside a tag. A page
   that holds all bytes its head declares and stops inside a *closing* tag merely lacks closing
   tags: nothing of it is missing.
2. Alignment: near-copies are found by min-hash banding over five-word shingles (the words up to
   fixed lengths are banded too, so that a copy cut early still meets the beginning of the
   whole one), verified (0.8 or more of the shingles of the shorter text) and laid side by side
   line by line. The copy that stops inside a line which goes on in the other was cut; a copy
   whose last line stands complete in the other was not. This decides both ways.
3. Closing-word terminality for records without such a copy: how often the last one, two and
   three words end a line or sentence among all records, and how often they do not.

Scale: one pass computes verdicts, band keys, word hashes and texts, written once. Records of
equal text are folded into one by a partial aggregation before keys are joined, so a hot group of
copies is one row per task. A key held by more than HOT texts is joined together with a line that the
alignment cannot do without (the last line itself, or the beginning of a line that may carry it on), so texts that
merely share furniture never meet and no pair that could decide is left out. Where such a group is still large, its
longest texts are met first; what they leave open meets all the others. Keys are shuffled once, and only those
under which a text and a longer one meet are kept. Texts are fetched for candidate pairs and for holders of hot keys
only: a bitmap of bounded size sifts out the others where they are read, so they never enter a shuffle. Word counts
cover all records and are summed only for the endings that are asked for.

Defined cases: null and empty contents are not cut unless bytes are declared; more bytes than
declared, missing closing tags after whole text and a missing final full stop are no cut;
repeated records are judged alike; other types are ignored; a marker of omission at the end counts
as a cut unless the same line stands so in a near-copy that goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrel.codec import http
from petrel.llm.pages import bare, html_lines, response_page, text_of
from petrel.llm.residue import line_kind
from petrel.llm.words import mixed, window_hashes
from petrel.storage import written

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 16, 4, 0.8
MARK = re.compile(r"(?i)\s*(?:…|\.{3,}|\[(?:…|\.{3}|truncated|cut|more|snip)\]|\((?:…|\.{3}|truncated|cut|more)\))\s*$")
STOP = re.compile(r"[.!?…:;»\"”)\]}%>*@$]$")
TERMINAL = re.compile(r"[.!?][\"”»')\]]*$")
URL_END = re.compile(r"\w+://\S+$")
TOKEN = re.compile(r"[^\W_]+|[.!?](?=\s)|\n")
#: Prefixes of SHINGLE * 2**k words have PREFIX_BANDS bands of PREFIX_ROWS.
PREFIX_BANDS, PREFIX_ROWS = 6, 3
SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
FACTORS = mixed(SEEDS) | np.uint64(1)
#: Records worked on at a time, to bound memory.
SLICE = 1024
#: A key held by more texts is joined together with lines; so many of the longest are met first.
HOT = 32
#: Characters of a line's beginning that are keys: of any line, and of a line after a given one.
HEADS, HEADS_AFTER = (0, 7, 16, 32, 64), (0, 4, 12, 32)
#: 64-bit words of a sieve: at most, and as many as shall be there for each value.
SIEVE_WORDS, WORDS_EACH = 1 << 20, 8
#: Log odds of an ending below which a last line counts as cut: of a line of its own, of running text, inside an unclosed element.
CUT_SCORE, CUT_SCORE_RUNNING, CUT_SCORE_OPEN = -2.0, 0.0, 3.0
SCHEMA = (
    "row_id bigint, harvester_id int, reason string, ending string, cut_score double, last array<bigint>, chars int, digest bigint, "
    "bands array<bigint>, seeks boolean, tokens array<int>, text string"
)


class Vocabulary(dict):
    """Number of each token, with its hash as a word (case folded) and its hash for counting endings (31 bits, digits as zeros); 0 ends a line or sentence."""

    LIMIT = 1 << 20

    def __init__(self) -> None:
        self.word, self.gram = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)

    def __missing__(self, token: str) -> int:
        if token == "\n" or token in ".!?":
            self[token] = 0
            return 0
        n = max(len(self), 3) + 1
        if n >= len(self.word):
            self.word, self.gram = (np.concatenate((x, np.zeros_like(x))) for x in (self.word, self.gram))
        w = token.lower()
        self.word[n] = xxhash.xxh64_intdigest(w)
        self.gram[n] = (xxhash.xxh64_intdigest("0" * len(w) if any(map(str.isdigit, w)) else w) & 0x7FFFFFFF) or 1
        self[token] = n
        return n


_VOCABULARY = Vocabulary()


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, hashes for counting endings with 0 where a sentence or line begins)."""
    global _VOCABULARY
    if len(_VOCABULARY) > Vocabulary.LIMIT:  # start anew; numbers are not kept beyond this call
        _VOCABULARY = Vocabulary()
    tokens = TOKEN.findall(text)
    numbers = np.fromiter(map(_VOCABULARY.__getitem__, tokens), np.int64, len(tokens))
    units = np.concatenate(([0], _VOCABULARY.gram[numbers])).astype(np.int32, copy=False)
    keep = np.append(True, (units[1:] != 0) | (units[:-1] != 0))
    return _VOCABULARY.word[numbers[numbers > 0]], units[keep]


def gram_keys(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the last one, two and three words up to each place ``at``: 3 x places."""
    one = units.astype(np.uint64)
    two, three = one[np.maximum(at - 1, 0)], one[np.maximum(at - 2, 0)]
    three = np.where(two == 0, np.uint64(0), three)
    with np.errstate(over="ignore"):
        a = mixed(one[at])
        b = mixed(a + two + np.uint64(1))
        c = mixed(b + three + np.uint64(2))
    return np.stack((a, b, c)).view(np.int64)


def closed_grams(units: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys 3 x words, whether a line or sentence ends there) of texts laid end to end; the last unit of each, which may be cut, is left out."""
    at = np.flatnonzero(units)
    marks = np.append(np.flatnonzero(units == 0), len(units))
    following = marks[np.searchsorted(marks, at)]
    own_end = text_ends[np.searchsorted(text_ends, at, "right")]
    inside = following < own_end
    return gram_keys(units, at[inside]), following[inside] == at[inside] + 1


def byte_verdict(kind: str, content: bytes, declared: float | None) -> tuple[str | None, http.Message | None, str]:
    """(why its bytes fall short or None, message, decoded text)."""
    short = declared is not None and declared == declared and len(content) < declared
    if kind != "response":
        return ("record length" if short else None), None, text_of(content)
    m, page, whole = response_page(content)
    if short:
        why = "record length"
    elif m.parse_mode == "incomplete" and m.error is None:
        why = "chunks" if m.body_mode == "chunked" else "message length" if m.body_mode == "length" else "head"
    elif m.declared_length is not None and m.body_mode == "close" and m.encoding and len(content) - content.find(b"\r\n\r\n") - 4 < m.declared_length and content[:4] == b"HTTP":
        why = "message length"
    elif not whole:
        why = "compressed data"
    else:
        why = None
    return why, m, page


def _row_keys(low: np.ndarray, width: int, salt: int) -> np.ndarray:
    """One key per ``width`` neighbouring min-hashes."""
    keys = np.full(low.shape[:-1] + (low.shape[-1] // width,), salt, np.uint64)
    with np.errstate(over="ignore"):
        keys += np.arange(keys.shape[-1], dtype=np.uint64)
        for k in range(width):
            keys = mixed(keys) + low[..., k::width]
    return mixed(keys)


def signatures(texts: list[np.ndarray], block: int = 1 << 14) -> list[np.ndarray]:
    """Per text (word hashes) the band keys of the min-hashes of its shingles, then those of its prefixes of 5, 10, 20, ... words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= block):
            size += len(texts[end])
            end += 1
        out += _signatures(texts[at:end])
        at = end
    return out


def _signatures(texts: list[np.ndarray]) -> list[np.ndarray]:
    shingled = [k for k, t in enumerate(texts) if len(t) >= SHINGLE]
    out = [np.empty(0, np.int64)] * len(texts)
    if not shingled:
        return out
    parts = [window_hashes(texts[k], SHINGLE) for k in shingled]
    starts, levels, base = [], [], 0
    for p in parts:
        ends, size = [], SHINGLE
        while size <= len(p) + SHINGLE - 1:
            ends.append(size - SHINGLE + 1)
            size *= 2
        starts += [base, *(base + e for e in ends if e < len(p))]
        levels.append((len(ends), 1 + sum(e < len(p) for e in ends)))
        base += len(p)
    shingles = np.concatenate(parts)
    with np.errstate(over="ignore"):
        low = np.stack([np.minimum.reduceat(shingles * f + o, starts) for f, o in zip(FACTORS, SEEDS)], axis=1)
    whole, prefix, numbers, at = [], [], [], 0
    for n_prefixes, n_parts in levels:
        up_to = np.minimum.accumulate(low[at : at + n_parts], axis=0)
        whole.append(up_to[-1])
        prefix.append(up_to[:n_prefixes, : PREFIX_BANDS * PREFIX_ROWS])
        numbers.append(np.arange(n_prefixes, dtype=np.uint64))
        at += n_parts
    own = _row_keys(np.stack(whole), ROWS, 0)
    of_prefix = _row_keys(np.concatenate(prefix), PREFIX_ROWS, 1 << 32) ^ mixed(np.concatenate(numbers))[:, None]
    at = 0
    for k, row, (n_prefixes, _) in zip(shingled, own, levels):
        out[k] = np.concatenate((row, of_prefix[at : at + n_prefixes].ravel())).view(np.int64)
        at += n_prefixes
    return out


def page_text(kind: str, page: str) -> tuple[list[str], str]:
    """(own lines, markup after the last complete tag)."""
    if kind != "response":
        return [x for x in map(bare, page.split("\n")) if x], ""
    lines, tail = html_lines(page)
    return [x.text for x in lines if x.tag not in ("title", "noscript")], tail


def ending_of(line: str, open_element: bool) -> tuple[str, float]:
    """(what is known of a last line: whole, cut, marked, ask; the score below which it counts as cut if its words are asked)."""
    if MARK.search(line):
        return "marked", 0.0
    text = line.rstrip()
    if not text or STOP.search(text) or TERMINAL.search(text) or line_kind(text) or URL_END.search(text):
        return "whole", 0.0
    if text[-1] in ",-–(/'’&":
        return "cut", 0.0
    running = re.search(r"[.!?]\s", text) is not None
    return "ask", CUT_SCORE_OPEN if open_element else CUT_SCORE_RUNNING if running else CUT_SCORE


def markup_verdict(page: str, tail: str, message: http.Message) -> tuple[str | None, bool]:
    """(markup if the page stops inside a tag that more must follow, whether its markup proves it whole)."""
    if not tail.strip():
        return None, page.rstrip().lower().endswith("</html>")
    broken = re.search(r"<[^<>]*$", tail)
    if broken is None:
        return None, False
    if message.body_mode in ("length", "chunked") and re.match(r"<(?:/[a-zA-Z0-9]*)?$", broken[0]):
        return None, True
    return "markup", False


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def judge(records: DataFrame) -> DataFrame:
    """One row per page record: what bytes and markup say, its text, its keys (see SCHEMA)."""

    def row(kind: str, declared: int | None, content: bytes | None) -> tuple:
        if content is None:
            return None, "whole", 0.0, 0, 0, np.empty(0, np.uint64), False, np.zeros(1, np.int32), ""
        why, m, page = byte_verdict(kind, content, declared)
        lines, tail = page_text(kind, page)
        proven, in_element = False, False
        if why is None and lines and kind == "response" and "<" in page:
            why, proven = markup_verdict(page, tail, m)
            in_element = bool(tail.strip())
        ending, score = ending_of(lines[-1], in_element) if lines and not proven else ("whole", 0.0)
        text = "\n".join(lines)
        own, units = tokens_of(text)
        seeks = why is None and not proven and bool(lines)
        mark = MARK.search(lines[-1]) if lines else None
        return why, ending, score, len(text) - (len(lines[-1]) - mark.start() if mark else 0), xxhash.xxh64_intdigest(text) - (1 << 63), own, seeks, units, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            c = {n: batch.column(n) for n in batch.schema.names}
            why, ending, score, chars, digest, own, seeks, units, text = zip(*map(row, *(c[n].to_pylist() for n in ("type", "content_length", "content"))))
            ends = np.cumsum([len(u) for u in units])
            joined = np.concatenate(units)
            worded = np.array([len(o) > 0 for o in own])
            last = np.zeros((3, len(units)), np.int64)
            at = ends[worded] - 1
            last[:, worded] = gram_keys(joined, np.where(joined[at] == 0, at - 1, at))
            yield pa.RecordBatch.from_arrays(
                [
                    c["row_id"], c["harvester_id"], pa.array(why, pa.string()), pa.array(ending, pa.string()), pa.array(score, pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(last.T.ravel()), 3).cast(pa.list_(pa.int64())), pa.array(chars, pa.int32()),
                    pa.array(digest, pa.int64()), _lists(signatures(list(own)), pa.int64()), pa.array(seeks, pa.bool_()), _lists(units, pa.int32()), pa.array(text, pa.string()),
                ],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    pages = records.where(F.col("type").isin("response", "conversion"))
    return pages.select("row_id", "harvester_id", "type", "content_length", "content").mapInArrow(run, SCHEMA)


def stop(lines: list[str]) -> tuple[str, str, str | None, bool]:
    """(last line, what of it may go on elsewhere, line before it, whether that is long enough to be sought after any line)."""
    last = bare(lines[-1])
    marked = MARK.search(last)
    cut = (last[: marked.start()] if marked else last).rstrip("\ufffd").rstrip()
    return last, cut, bare(lines[-2]) if len(lines) > 1 else None, len(cut.split()) >= SHINGLE


def aligned(short: list[str], long: list[str]) -> bool | None:
    """Whether ``short`` stops inside a line that goes on in ``long``; False: its last line is complete there; None: no near-copies or no such line."""
    a, b = (tokens_of("\n".join(x))[0] for x in (short, long))
    sa, sb = (np.unique(window_hashes(w, SHINGLE)) for w in (a, b))
    if not len(sa) or np.isin(sa, sb, assume_unique=True).sum() < SIMILARITY * len(sa):
        return None
    last, cut, before, long_enough = stop(short)
    whole = None
    for k, line in enumerate(long):
        if before is None or (k and long[k - 1] == before) or long_enough:
            if len(line) > len(cut) and line.startswith(cut) and line != last:
                return True
        if line == last:
            whole = False
    return whole


def sifted(rows: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Rows whose column ``name`` may be among ``values`` (one column). None of those is missing, but some others stay: an exact join must follow.

    The values are sent as one bit each, in a bitmap of at most SIEVE_WORDS, so the rows are not shuffled. More values fill it and leave more rows.
    """
    (column,) = values.columns
    places = values.select(F.expr(f"cast(shiftrightunsigned(xxhash64({column}), 44) as int)").alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))").alias("bit"))
    got = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    size = 1
    while size < min(SIEVE_WORDS, len(got) * WORDS_EACH):
        size *= 2
    bits = np.zeros(size, np.int64)
    np.bitwise_or.at(bits, got["word"].to_numpy() & (size - 1), got["bits"].to_numpy())
    sieve = rows.sparkSession.createDataFrame(pa.table({"sieve": pa.array([bits], pa.list_(pa.int64()))}))
    known = F.expr(f"shiftright(get(sieve, cast(shiftrightunsigned(xxhash64({name}), 44) & {size - 1} as int)), cast(xxhash64({name}) & 63 as int)) & 1 = 1")
    return rows.join(F.broadcast(sieve), known, "left_semi")


def align(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """digest, cut_here (bool) for pairs (row_id, other) of a text and a longer near-copy."""
    left = sifted(judged.select("row_id", "digest", F.col("text").alias("a")), "row_id", pairs.select("row_id"))
    right = sifted(judged.select(F.col("row_id").alias("other"), F.col("text").alias("b")), "other", pairs.select("other"))
    both = pairs.select("row_id", "other").join(left, "row_id").join(right, "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(d, aligned(a.split("\n"), b.split("\n"))) for d, a, b in zip(batch["digest"], batch["a"], batch["b"])]
            got = [x for x in got if x[1] is not None]
            yield pd.DataFrame({"digest": pd.Series([x[0] for x in got], dtype="int64"), "cut_here": pd.Series([x[1] for x in got], dtype="bool")})

    return both.select("digest", "a", "b").mapInPandas(run, "digest bigint, cut_here boolean")


def stop_keys(texts: DataFrame) -> DataFrame:
    """id, line_key, last, equal: the line keys of which a longer text must hold one for ``aligned`` to decide (``equal``: it can only clear)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                last, cut, before, long_enough = stop(text.split("\n"))
                after = not (before is None or long_enough)
                size = max(n for n in (HEADS_AFTER if after else HEADS) if n <= len(cut))
                rows += [(i, 0, 0, last, last), (i, 2 if after else 1, size, (before + "\n" if after else "") + cut[:size], last)]
            yield pd.DataFrame(rows, columns=["id", "kind", "size", "head", "last"])

    keys = texts.select("id", "text").mapInPandas(run, "id bigint, kind int, size int, head string, last string")
    return keys.select("id", F.xxhash64("kind", "size", "head").alias("line_key"), F.xxhash64("last").alias("last"), (F.col("kind") == 0).alias("equal"))


def line_keys(texts: DataFrame) -> DataFrame:
    """id, line_key, line: every key that a line of the text answers to, see ``stop_keys``."""
    lines = texts.select("id", F.split("text", "\n").alias("lines")).select("id", "lines", F.posexplode("lines").alias("at", "own"))
    own, long = F.col("own"), F.length("own")
    head = lambda kind, size, text: F.xxhash64(F.lit(kind), F.lit(size), text)
    before = F.when(F.col("at") > 0, F.get("lines", F.col("at") - 1))
    keys = [head(0, 0, own), *(F.when(long >= n, head(1, n, F.substring(own, 1, n))) for n in HEADS)]
    keys += [F.when(before.isNotNull() & (long >= n), head(2, n, F.concat(before, F.lit("\n"), F.substring(own, 1, n)))) for n in HEADS_AFTER]
    return lines.select("id", F.xxhash64("own").alias("line"), F.explode(F.array_compact(F.array(*keys))).alias("line_key"))


def near_pairs(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each text in doubt and longer texts under its keys, each text by its smallest row.

    First (row_id, other) to lay side by side, then (row_id, other, equal) for texts that those leave open: not
    cut there, and with ``equal`` not cleared there either. Together these are all pairs that share a key and can decide.
    """
    unsure = F.max(F.col("seeks") & (F.col("ending") != "whole")).alias("unsure")  # of others there is nothing to clear
    texts = judged.where(F.size("bands") > 0).groupBy("digest").agg(F.min("row_id").alias("id"), F.max("seeks").alias("seeks"), unsure, F.first("chars").alias("chars"), F.first("bands").alias("bands"))
    texts = written(texts, "text-keys")
    own = F.col("seeks") & ((F.col("pos") < BANDS) | (F.col("pos") >= F.col("n") - PREFIX_BANDS))
    keys = texts.select("id", "chars", "seeks", "unsure", F.size("bands").alias("n"), F.posexplode("bands").alias("pos", "key"))
    keys = keys.select("key", "id", "chars", F.when(own, F.col("unsure").cast("int") + 1).otherwise(0).alias("asks"))  # 2: with doubts
    of_key = Window.partitionBy("key")
    keys = keys.withColumns({"n": F.count("*").over(of_key), "least": F.min(F.when(F.col("asks") > 0, F.col("chars"))).over(of_key), "most": F.max("chars").over(of_key)})
    # holders longer than some text that asks, and texts that ask shorter than some holder
    keys = keys.where((F.col("chars") > F.col("least")) | ((F.col("asks") > 0) & (F.col("chars") < F.col("most"))))
    keys = written(keys.select("key", "id", "chars", "asks", (F.col("n") > HOT).alias("hot")), "shared-keys")
    holders = keys.select("key", F.col("id").alias("other"), F.col("chars").alias("other_chars"), "hot")
    seekers = keys.where("asks > 0").select("key", "id", "chars", (F.col("asks") > 1).alias("unsure"), "hot")
    cold = holders.where("not hot").drop("hot")
    met = seekers.where("not hot").join(cold, "key").where("other_chars > chars").select(F.col("id").alias("row_id"), "other")
    # hot keys: both sides with their lines
    asking, asked = seekers.where("hot").drop("hot"), keys.where("hot").select("key", "id", "chars")
    text = judged.select(F.col("row_id").alias("id"), "text")
    stops = written(stop_keys(sifted(text, "id", asking.select("id"))).join(asking.select("id").distinct(), "id", "left_semi"), "hot-stops")
    lines = sifted(line_keys(sifted(text, "id", asked.select("id"))), "line_key", stops.select("line_key")).distinct()
    longest = Window.partitionBy("key", "line_key").orderBy(F.desc("other_chars"), "other")
    asked = asked.join(lines, "id").select("key", "line_key", "line", F.col("id").alias("other"), F.col("chars").alias("other_chars"))
    place, sought = F.xxhash64("key", "line_key").alias("place"), asking.join(stops, "id")
    asked = sifted(asked.select("*", place), "place", sought.select(place)).drop("place")  # lines that are sought under this key
    asked = asked.withColumn("rank", F.row_number().over(longest))
    both = sought.join(asked, ["key", "line_key"]).where((F.col("other_chars") > F.col("chars")) & ((F.col("equal") & F.col("unsure")) | (~F.col("equal") & (F.col("line") != F.col("last")))))
    both = written(both.groupBy(F.col("id").alias("row_id"), "other").agg(F.min("rank").alias("rank"), F.min("equal").alias("equal")), "hot-pairs")
    first = met.unionByName(both.where(F.col("rank") <= HOT).select("row_id", "other")).distinct()
    return first, both.where(F.col("rank") > HOT).select("row_id", "other", "equal")


def ending_counts(judged: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, seen, ends: how often the wanted words occur in all records, and how often a line or sentence ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            offsets = np.asarray(tokens.offsets)
            keys, ends = closed_grams(np.asarray(tokens.values)[offsets[0] : offsets[-1]], offsets[1:][np.diff(offsets) > 0] - offsets[0])
            own, where = np.unique(keys, return_inverse=True)
            where = where.reshape(keys.shape)
            seen = np.bincount(where.ravel(), minlength=len(own))
            closing = np.bincount(where[:, ends].ravel(), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(seen, pa.int64()), pa.array(closing, pa.int64())], ["key", "seen", "ends"])

    counts = judged.where(F.size("tokens") > 1).select("tokens").mapInArrow(run, "key bigint, seen bigint, ends bigint")
    return counts.join(wanted, "key", "left_semi").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def terminality(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, score: log odds that a text may end with its last words; -4 for a word nobody else uses."""
    words = asked.select("digest", F.posexplode("last").alias("n", "key")).join(counts, "key", "left")
    seen, ends = (F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)) for n, c in ((0, "seen"), (0, "ends")))
    pair = [F.coalesce(F.max(F.when(F.col("n") == 1, F.col(c))), F.lit(0)).alias(f"{c}2") for c in ("seen", "ends")]
    triple = [F.coalesce(F.max(F.when(F.col("n") == 2, F.col(c))), F.lit(0)).alias(f"{c}3") for c in ("seen", "ends")]
    rows = words.groupBy("digest").agg(seen.alias("seen1"), ends.alias("ends1"), *pair, *triple)
    p1 = (F.col("ends1") + 0.05) / (F.col("seen1") + 1)
    p2 = (F.col("ends2") + 4 * p1) / (F.col("seen2") + 4)
    p3 = (F.col("ends3") + 4 * p2) / (F.col("seen3") + 4)
    p = F.greatest(F.least(p3, F.lit(0.9999)), F.lit(0.0001))
    return rows.select("digest", F.when(F.col("seen1") == 0, F.lit(-4.0)).otherwise(F.log(p / (1 - p))).alias("score"))


def truncated(records: DataFrame) -> DataFrame:
    """row_id, harvester_id, reason of every record, reason null where nothing is missing."""
    judged = written(judge(records), "judged-ends")
    pairs, rest = near_pairs(judged)
    beside = written(align(written(pairs, "near-copies"), judged).groupBy("digest").agg(F.max("cut_here").alias("cut_here")), "aligned")
    # texts that are not cut beside the longest ones of their hot keys meet the others
    settled = judged.select("row_id", "digest").join(rest.select("row_id").distinct(), "row_id", "left_semi").join(beside, "digest").select("row_id", F.col("cut_here").alias("settled"))
    rest = written(rest.join(settled, "row_id", "left").where("settled is null or not settled and not equal").select("row_id", "other"), "near-copies-rest")
    beside = written(beside.unionByName(align(rest, judged)).groupBy("digest").agg(F.max("cut_here").alias("cut_here")), "aligned-all")
    open_rows = judged.where("seeks").select("row_id", "digest", "ending", "cut_score", "last").join(beside, "digest", "left")
    asked = written(open_rows.where("cut_here is null and ending = 'ask'").groupBy("digest").agg(F.first("last").alias("last")), "asked-endings")
    counts = ending_counts(judged, asked.select(F.explode("last").alias("key")).distinct())
    scores = terminality(asked, counts)
    verdict = (
        F.when(F.col("cut_here"), F.lit("alignment")).when(~F.col("cut_here"), F.lit(None))
        .when(F.col("ending").isin("cut", "marked") | ((F.col("ending") == "ask") & (F.col("score") < F.col("cut_score"))), F.lit("closing words"))
    )
    found = open_rows.join(scores, "digest", "left").select("row_id", verdict.alias("verdict")).where(F.col("verdict").isNotNull())
    both = judged.select("row_id", "harvester_id", "reason").join(found, "row_id", "left")
    return both.select("row_id", "harvester_id", F.coalesce("reason", "verdict").alias("reason"))
