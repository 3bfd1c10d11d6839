"""Rows that fail to parse (problem 4): reasons for the broken rows, typed values for the rest.

Structural rejects come from pyarrow's CSV reader through its invalid-row callback; fields are read as bytes,
then whole columns are cast and every failing cell is labelled.  One pass over the lines, no shuffle of the lines
themselves: the file inventory (a row a file) is joined for the expected columns.

Defined results: a null line is an empty line; a line of a file that the inventory lacks, or whose columns are null,
gets the reason 'columns' unless an earlier reason holds; an empty label, date or articleID is an invalid value,
any other empty field is valid; repeated lines keep their own line_id; extra columns of the input are dropped.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A record whose quotes are sound: every field is either wholly quoted (inner quotes doubled) or has no quote.
_SOUND = re.compile(rb'(?:"(?:[^"]|"")*+"|[^",]*+)(?:,(?:"(?:[^"]|"")*+"|[^",]*+))*+\r?')
# Valid labels by the name of their column, the names of text columns
LABELS = {"Label": ("0", "1", "2"), "hate speech": ("0", "1", "0.0", "1.0"), "label": ("0", "1", "0.0", "1.0")}
TEXTS = ("Data", "sentence", "content")
# Noncharacters that can stand for line ends inside a record; those that the records hold are not taken.
_STAND_INS = [chr(c).encode() for c in range(0xFDD0, 0xFDF0)]

SCHEMA = (
    "line_id bigint, file_name string, line_no int, reason string, bad_cells array<string>, text string, "
    "label int, article_id string, published date, fields map<string,string>"
)
_ARROW = pa.schema(
    [
        ("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("reason", pa.string()),
        ("bad_cells", pa.list_(pa.string())), ("text", pa.string()), ("label", pa.int32()),
        ("article_id", pa.string()), ("published", pa.date32()), ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def _utf8(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


_MONTHS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def days(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which strings are real days as YYYY-MM-DD, and the days."""
    ok = pc.match_substring_regex(col, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    text = pc.if_else(ok, col, "1970-01-01")
    y, m, d = (pc.utf8_slice_codeunits(text, i, j).cast(pa.int64()).to_numpy(zero_copy_only=False) for i, j in ((0, 4), (5, 7), (8, 10)))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    real = (y > 0) & (m >= 1) & (m <= 12)
    real &= (d >= 1) & (d <= _MONTHS[np.clip(m, 1, 12) - 1] + (leap & (m == 2)))
    real &= ok.to_numpy(zero_copy_only=False)
    month = ((y - 1970) * 12 + m - 1).astype("datetime64[M]")
    return real, month.astype("datetime64[D]") + (d - 1)


def read_records(records: list[bytes], n_columns: int) -> tuple[pa.Table, set[int]]:
    """The soundly quoted records of that many fields as a table of strings, and the positions of the others."""
    bad: set[int] = set()

    def invalid(row: csv.InvalidRow) -> str:
        bad.add(row.number - 2)  # numbers begin at 1, with the row put in front
        return "skip"

    names = [f"f{i}" for i in range(n_columns)]
    head = b",".join([b"x"] * n_columns)  # keeps a byte order mark of the first record in its field
    joined = b"\0".join(records)
    # longer ones where the records hold all short ones; of different characters, so that none can arise by accident
    free = (b"".join(x) for k in range(1, len(_STAND_INS)) for x in itertools.permutations(_STAND_INS, k))
    cr, lf = itertools.islice((b for b in free if b not in joined), 2)
    wrong = b",".join([b"x"] * (n_columns + 1))  # an empty record has one field, which the reader would pad
    body = [wrong if n_columns > 1 and r in (b"", b"\r") else r.removesuffix(b"\r").replace(b"\r", cr).replace(b"\n", lf) for r in records]
    data = b"\n".join([head, *body]) + b"\n"
    table = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(data) + 1, 1024)),
        parse_options=csv.ParseOptions(ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.binary()), null_values=[], strings_can_be_null=False),
    )
    back = {}
    for name in names:
        col = table[name].combine_chunks().slice(1)
        col = col.cast(pa.binary())
        values = [v.replace(cr, b"\r").replace(lf, b"\n") for v in col.to_pylist()]
        back[name] = pa.array(values, pa.binary()).cast(pa.string())
    return pa.table(back), bad


def label_cells(table: pa.Table, columns: list[str]) -> dict:
    """Casts by column name: label, article_id, published, and a list of failing column names a row."""
    n = table.num_rows
    bad: list[list[str]] = [[] for _ in range(n)]
    out: dict = {"label": [None] * n, "article_id": [None] * n, "published": [None] * n, "text": [None] * n}
    for name, col in zip(columns, table.columns, strict=True):
        if name in LABELS:
            trimmed = pc.utf8_trim_whitespace(col)
            ok = pc.is_in(trimmed, pa.array(LABELS[name])).to_pylist()
            out["label"] = [int(v[0]) if k else None for v, k in zip(trimmed.to_pylist(), ok, strict=True)]
        elif name == "articleID":
            ok = pc.match_substring_regex(col, r"^[0-9]+$").to_pylist()
            ok = [k and "\n" not in v for k, v in zip(ok, col.to_pylist(), strict=True)]
            out["article_id"] = [v if k else None for v, k in zip(col.to_pylist(), ok, strict=True)]
        elif name == "date":
            real, day = days(col)
            ok = real.tolist()
            out["published"] = [v if k else None for v, k in zip(day.tolist(), ok, strict=True)]
        else:
            if name in TEXTS:
                out["text"] = col.to_pylist()
            continue
        for i, k in enumerate(ok):
            if not k:
                bad[i].append(name)
    return out | {"bad": bad}


def _batches(batches):
    for batch in batches:
        rows = batch.to_pydict()
        raws = [r or b"" for r in rows["raw"]]
        n = len(raws)
        out: list = [None] * n
        groups: dict[str | None, list[int]] = {}
        for i, r in enumerate(raws):
            if not _utf8(r):
                out[i] = ("encoding",)
            elif not _SOUND.fullmatch(r):
                out[i] = ("quoting",)
            else:
                groups.setdefault(rows["columns"][i], []).append(i)
        for columns, at in groups.items():
            if columns is None:
                for i in at:
                    out[i] = ("columns",)
                continue
            names = columns.split("|")
            table, wrong = read_records([raws[i] for i in at], len(names))
            for k in wrong:
                out[at[k]] = ("columns",)
            good = [i for k, i in enumerate(at) if k not in wrong]
            cells = label_cells(table, names)
            lists = [c.to_pylist() for c in table.columns]
            for k, i in enumerate(good):
                bad = cells["bad"][k]
                fields = [(a, c[k]) for a, c in zip(names, lists, strict=True)]
                out[i] = (
                    "value" if bad else None, bad, cells["text"][k], cells["label"][k],
                    cells["article_id"][k], cells["published"][k], list(dict(fields).items()),
                )
        full = [o if len(o) > 1 else (o[0], None, None, None, None, None, None) for o in out]
        cols = list(zip(*full, strict=True)) if full else [[]] * 7
        arrays = [pa.array(c, f.type) for c, f in zip(cols, list(_ARROW)[3:], strict=True)]
        keys = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in list(_ARROW)[:3]]
        yield pa.RecordBatch.from_arrays(keys + arrays, schema=_ARROW)


def _reasons(batches):
    """line_id and reason of the rows that fail, without their values."""
    for batch in _batches(batches):
        failed = batch.filter(batch.column(3).is_valid())
        yield failed.select(["line_id", "reason"])


def failures(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """line_id, reason of the lines that fail."""
    return _with_columns(lines, inventory).mapInArrow(_reasons, "line_id bigint, reason string")


def _with_columns(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    # one row a file even if the inventory repeats a name
    files = inventory.groupBy("file_name").agg(F.min("columns").alias("columns"))
    src = lines.select("line_id", "file_name", F.col("line_no").cast("int").alias("line_no"), "raw")
    return src.join(files, "file_name", "left").select("line_id", "file_name", "line_no", "raw", "columns")


def parse_lines(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every line with its reason (null: valid) and, where it parsed, its fields and typed values."""
    return _with_columns(lines, inventory).mapInArrow(_batches, SCHEMA)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())


def typed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "bad_cells")


def failures_by_file(parsed: DataFrame) -> DataFrame:
    """Rows and rejects by file and reason, pre-aggregated before the shuffle."""
    return parsed.groupBy("file_name", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_rows"))
