"""Index lines into typed rows, and the lines that do not parse with the reason.

Batches of lines go through Arrow to pyarrow's CSV reader with every field read as a
string. Lines with a wrong number of fields come back through its invalid-row callback;
pyarrow tolerates stray quotes, so the quoting rule is checked by one vectorised regular
expression first. Fields are then cast as whole vectors and failing cells are labelled.

Defined cases: a null or blank line and a comment (starting with ``#``) are neither valid
nor rejected and are left out; line breaks inside a line are ordinary characters; of several
faults the first in the order quoting, fields, offset, warc_type, record_id, content_length
is named; ``-`` is null in subject_uri, content_type and content_length; numbers with
leading zeros are valid; repeated lines each give a row. Only line_id, file_name, line_no
and line are read. There is no shuffle: it is one pass over the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

FIELDS = ("filename", "offset", "warc_type", "subject_uri", "record_id", "content_type", "content_length")
WARC_TYPES = ("warcinfo", "response", "request", "revisit", "metadata", "conversion", "resource")
QUOTING = r'(?s)^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
RECORD_ID = r"^<[uU][rR][nN]:[uU][uU][iI][dD]:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}>$"
BIGINT_MAX = "9223372036854775807"

SCHEMA = (
    "line_id bigint, file_name string, line_no bigint, line string, filename string, offset bigint, warc_type string, "
    "subject_uri string, record_id string, content_type string, content_length bigint, reason string"
)
_OUT = pa.schema(
    [("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("filename", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string())]
    + [("subject_uri", pa.string()), ("record_id", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("reason", pa.string())]
)


def _bigint(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(values, valid): decimal digits that fit a BIGINT."""
    digits = pc.match_substring_regex(text, r"^[0-9]+$")
    bare = pc.replace_substring_regex(text, r"^0+([0-9])", r"\1")
    n = pc.utf8_length(bare)
    fits = pc.or_(pc.less(n, 19), pc.and_(pc.equal(n, 19), pc.less_equal(bare, BIGINT_MAX)))
    ok = pc.fill_null(pc.and_(digits, fits), False)
    return pc.cast(pc.if_else(ok, bare, None), pa.int64()), ok


def parse_batch(batch: pa.RecordBatch) -> pa.Table:
    """line_id, file_name, line_no, line of one batch into rows of the output schema."""
    lines = pa.Table.from_batches([batch])
    text = pc.fill_null(pc.cast(lines["line"], pa.string()), "")
    skip = pc.or_(pc.equal(pc.utf8_trim_whitespace(text), ""), pc.starts_with(text, "#"))
    lines = lines.filter(pc.invert(skip)).combine_chunks()
    n = lines.num_rows
    if not n:
        return _OUT.empty_table()
    text = pc.cast(lines["line"], pa.string()).combine_chunks()
    reason: list[str | None] = [None] * n
    for i in pc.indices_nonzero(pc.invert(pc.match_substring_regex(text, QUOTING))).to_pylist():
        reason[i] = "quoting"
    # line breaks inside a line pass the CSV reader as signs that occur nowhere in the batch
    breaks, plain = [], text
    for a in ("\n", "\r"):
        if pc.any(pc.match_substring(plain, a)).as_py():
            b = next(c for c in map(chr, range(0xE000, 0x110000)) if not pc.any(pc.match_substring(plain, c)).as_py())
            breaks.append((a, b))
            plain = pc.replace_substring(plain, a, b)
    numbered = [f"{i},{s}" for i, s in enumerate(plain.to_pylist()) if reason[i] is None]
    fields = {name: pa.nulls(n, pa.string()) for name in FIELDS}
    if numbered:
        def reject(row: pacsv.InvalidRow) -> str:
            reason[int(row.text.split(",", 1)[0])] = f"fields: {row.actual_columns - 1}"
            return "skip"

        data = ("\n".join(numbered) + "\n").encode()
        parsed = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=["_at", *FIELDS], use_threads=False, block_size=max(1 << 20, len(data) + 1)),
            parse_options=pacsv.ParseOptions(invalid_row_handler=reject, newlines_in_values=False, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types={"_at": pa.int64(), **{f: pa.string() for f in FIELDS}}, strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
        ).combine_chunks()
        at = pc.index_in(pa.array(range(n), pa.int64()), parsed["_at"].combine_chunks() if parsed.num_rows else pa.array([], pa.int64()))
        for name in FIELDS:
            column = pc.take(parsed[name].combine_chunks(), at) if parsed.num_rows else pa.nulls(n, pa.string())
            for a, b in breaks:
                column = pc.replace_substring(column, b, a)
            fields[name] = column
    dash = {name: pc.fill_null(pc.equal(fields[name], "-"), False) for name in ("subject_uri", "content_type", "content_length")}
    offset, offset_ok = _bigint(fields["offset"])
    length, length_ok = _bigint(fields["content_length"])
    checks = (
        ("offset", offset_ok),
        ("warc_type", pc.is_in(fields["warc_type"], pa.array(WARC_TYPES))),
        ("record_id", pc.fill_null(pc.match_substring_regex(fields["record_id"], RECORD_ID), False)),
        ("content_length", pc.or_(length_ok, dash["content_length"])),
    )
    why = pa.array(reason, pa.string())
    for name, ok in checks:
        why = pc.coalesce(why, pc.if_else(ok, None, name))
    good = pc.is_null(why)
    keep = lambda column, null=None: pc.if_else(pc.and_(good, pc.invert(null)) if null is not None else good, column, None)
    return pa.table(
        [
            pc.cast(lines["line_id"], pa.int64()), pc.cast(lines["file_name"], pa.string()), pc.cast(lines["line_no"], pa.int64()), text,
            keep(fields["filename"]), keep(offset), keep(fields["warc_type"]), keep(fields["subject_uri"], dash["subject_uri"]),
            keep(fields["record_id"]), keep(fields["content_type"], dash["content_type"]), keep(length), why,
        ],
        schema=_OUT,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from parse_batch(batch).to_batches()


def parse_index_lines(lines: DataFrame) -> DataFrame:
    """Every data line with its typed fields, or with ``reason`` and null fields."""
    return lines.select("line_id", "file_name", "line_no", "line").mapInArrow(_parse, SCHEMA)
