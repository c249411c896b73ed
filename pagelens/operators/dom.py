"""Pages to parsed pages: the one Python stage every page feature starts from.

A parsed page stays one row, with its elements as an array of structs. Everything
per page is then an expression over that array, so no feature needs a shuffle, and
a parsed table written as Parquet is pruned to the element fields a query reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.operators.markup import PageReader

ELEMENT_FIELDS = {
    "pos": (T.IntegerType(), pa.int32()),
    "tag": (T.StringType(), pa.string()),
    "depth": (T.IntegerType(), pa.int32()),
    "parent_pos": (T.IntegerType(), pa.int32()),
    "attrs": (T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())),
    "classes": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "own_string": (T.StringType(), pa.string()),
    "text": (T.StringType(), pa.string()),
}
ALL_FIELDS = tuple(ELEMENT_FIELDS)

# Output rows are handed back once this many elements or characters have gathered: a
# worker holds what Spark hands it at once (at most 64 MB), and little besides.
_FLUSH_ELEMENTS = 10_000
_FLUSH_CHARS = 1_000_000


def parse_pages(
    pages: DataFrame,
    fields: tuple[str, ...] = ALL_FIELDS,
    markup: str = "html",
    keep: tuple[str, ...] = ("page_id",),
    max_elements: int | None = None,
    refused_text: bool = False,
    texts: bool = True,
) -> DataFrame:
    """`keep` columns + `elements`, `page_text`, `rejected` for each page.

    `fields` names the element fields the consumer reads; the others are not built.
    `max_elements` bounds the elements handed back, for consumers of the first N only.
    `markup` may be a string or a binary column; bad UTF-8 bytes are dropped.
    `rejected` marks markup the reader refused: no elements and no text, or with
    `refused_text` the markup itself as its text. Without `texts`, for consumers of
    elements only, `page_text` is not built and null.
    """
    unknown = set(fields) - set(ELEMENT_FIELDS)
    if unknown:
        raise ValueError(f"unknown element fields: {sorted(unknown)}")
    source = pages.select(*keep, F.col(markup).alias("__markup"))
    element = T.StructType([T.StructField(f, ELEMENT_FIELDS[f][0]) for f in fields])
    schema = T.StructType(
        [pages.schema[name] for name in keep]
        + [
            T.StructField("elements", T.ArrayType(element)),
            T.StructField("page_text", T.StringType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parse_batch(batch)

    def parse_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = batch.column(len(keep))
        start = 0
        builder = _PageBuilder(fields, max_elements, refused_text, texts)
        for i in range(batch.num_rows):
            builder.add(_as_text(marks[i].as_py()))
            if builder.is_full() or i == batch.num_rows - 1:
                kept = batch.slice(start, i + 1 - start)
                columns = [kept.column(c) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    columns + builder.arrays(),
                    names=[*keep, "elements", "page_text", "rejected"],
                )
                start = i + 1
                builder = _PageBuilder(fields, max_elements, refused_text, texts)

    return source.mapInArrow(parse, schema)


def elements(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per element, in the long form: `keep` columns (page_id) + element fields."""
    return parsed.select(*(keep or ("page_id",)), F.inline("elements"))


def _as_text(value: str | bytes | None) -> str:
    if isinstance(value, bytes):
        text = value.decode("utf-8", "ignore")
        return text.replace("\r\n", "\n").replace("\r", "\n")
    return value or ""


class _PageBuilder:
    """Gathers parsed pages column by column and turns them into Arrow arrays."""

    def __init__(
        self,
        fields: tuple[str, ...],
        max_elements: int | None,
        refused_text: bool = False,
        with_texts: bool = True,
    ) -> None:
        self.fields = fields
        self.refused_text = refused_text
        self.with_texts = with_texts
        self.max_elements = max_elements
        self.offsets = [0]
        self.texts: list[str | None] = []
        self.rejected: list[bool] = []
        self.chars = 0
        self.values: dict[str, list] = {f: [] for f in fields}

    def is_full(self) -> bool:
        return self.offsets[-1] >= _FLUSH_ELEMENTS or self.chars >= _FLUSH_CHARS

    def add(self, markup: str) -> None:
        reader = PageReader()
        self.chars += len(markup)
        try:
            reader.read(markup)
        except AssertionError:  # malformed declaration, e.g. "<![foo"
            refused = markup if self.refused_text else ""
            self.texts.append(refused if self.with_texts else None)
            self.rejected.append(True)
            self.offsets.append(self.offsets[-1])
            return
        found = reader.elements[: self.max_elements]
        for field in self.fields:
            self.values[field].extend(_field(reader, found, field))
        self.texts.append(reader.page_text() if self.with_texts else None)
        self.rejected.append(False)
        self.offsets.append(self.offsets[-1] + len(found))

    def arrays(self) -> list[pa.Array]:
        columns = [pa.array(self.values[f], ELEMENT_FIELDS[f][1]) for f in self.fields]
        element = pa.StructArray.from_arrays(columns, names=list(self.fields))
        return [
            pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), element),
            pa.array(self.texts, pa.string()),
            pa.array(self.rejected, pa.bool_()),
        ]


def _field(reader: PageReader, found: list[dict], field: str) -> list:
    if field == "pos":
        return list(range(len(found)))
    if field == "parent_pos":
        return [e["parent"] for e in found]
    if field == "attrs":
        return [list(e["attrs"].items()) for e in found]
    if field == "classes":
        return [e["attrs"].get("class", "").split() for e in found]
    if field == "own_string":
        return [reader.own_string(e) for e in found]
    if field == "text":
        return [reader.element_text(e) for e in found]
    return [e[field] for e in found]
