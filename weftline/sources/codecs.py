"""Sinks: entities (_ord, doc) and typed tables in the formats that datasets are served in.

Formats of one row a line or a record are written by Spark, partition by partition, and so are JSON and XML documents as files that follow one another
(write_document()). What is served as one stream (pretty JSON, XML, a workbook, an archive) goes over rows in order, without holding them.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions.scalars import canonical, cell_str, cell_text, value_text
from weftline.functions.text import file_slug
from weftline.sources.scratch import numbered

HEADER_FILL, WIDEST = "FF1E3A5F", 60


def ordered(df: DataFrame, sort: bool = True) -> Iterator[dict]:
    """Entities in order, a partition at a time; sort: by their places, else as df has them."""
    rows = df.select("_ord", "doc")
    for row in (rows.orderBy("_ord") if sort else rows).toLocalIterator():
        yield jsonops.decode(row["doc"])


def columns_of(df: DataFrame, skip: str | None = "_source") -> list[str]:
    """The sorted names of all flattened entities: a distinct over the cluster, as many rows as there are names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({k for t in b.column(0).to_pylist() for k in jsonops.flatten(jsonops.decode(t) or {}, skip)}), pa.string())], names=["k"])

    return sorted(r["k"] for r in df.select("doc").mapInArrow(run, "k string").distinct().collect())


def table(df: DataFrame, form: str = "cell", skip: str | None = "_source") -> DataFrame:
    """Entities as a flat table of texts, all names as columns, in order. form: `cell` or `value`."""
    names = columns_of(df, skip)
    text = cell_text if form == "cell" else (lambda v: "" if v is None else value_text(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [jsonops.flatten(jsonops.decode(t) or {}, skip) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([text(r.get(n)) for r in rows], pa.string()) for n in names)], names=["_ord", *names])

    schema = ", ".join(["_ord bigint", *(f"`{n}` string" for n in names)])
    return df.select(F.col("_ord").cast("bigint"), "doc").mapInArrow(run, schema).orderBy("_ord").drop("_ord")


# --- by Spark's writers ----------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str) -> None:
    """One entity a line, never flattened."""
    df.orderBy("_ord").select("doc").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    table(df).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").option("quoteAll", False).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, form: str = "cell") -> None:
    """All columns as texts; an error if there is no row."""
    flat = table(df, form)
    if flat.isEmpty():
        raise ValueError("no entities to write")
    flat.write.mode("overwrite").parquet(path)


def write_xml_rows(df: DataFrame, path: str) -> None:
    """Flat entities under dataset/entities by Spark's own XML writer, for results of any size."""
    table(df).write.mode("overwrite").format("xml").option("rootTag", "entities").option("rowTag", "entity").save(path)


def typed_cells(df: DataFrame) -> list[Column]:
    """The cells of a typed table's columns, sorted by name."""
    return [cell_str(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]


# --- single documents ------------------------------------------------------------------------------------------


def json_document(entities: Iterable[dict], pretty: bool = True) -> Iterator[str]:
    """A JSON list, a piece at a time."""
    yield "["
    first = True
    for e in entities:
        text = json.dumps(json.loads(canonical(e)), indent=2, ensure_ascii=False, sort_keys=True) if pretty else canonical(e)
        yield ("" if first else ",") + ("\n  " + text.replace("\n", "\n  ") if pretty else text)
        first = False
    yield "\n]" if pretty and not first else "]"


def _tag(name: str) -> str:
    tag = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name)
    return f"_{tag}" if tag[:1].isdigit() else tag


def _quoted(s: str) -> str:
    return escape(s, {'"': "&quot;", "'": "&apos;"})


def xml_document(entities: Iterable[dict], name: str) -> Iterator[str]:
    """Nested XML: keys in order, members of a list under its name without the last s, or item."""
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<dataset name="{_quoted(name)}">\n'

    def element(key: str, v, depth: int) -> Iterator[str]:
        tag, pad = _tag(key), "  " * depth
        if isinstance(v, (dict, list)):
            one = tag.removesuffix("s") if tag.endswith("s") else "item"
            yield f"{pad}<{tag}>\n"
            for k, x in ((k, v[k]) for k in sorted(v)) if isinstance(v, dict) else ((one, x) for x in v):
                yield from element(k, x, depth + 1)
            yield f"{pad}</{tag}>\n"
        elif v is None:
            yield f"{pad}<{tag}/>\n"
        else:
            yield f"{pad}<{tag}>{_quoted(value_text(v))}</{tag}>\n"

    for e in entities:
        yield "  <entity>\n"
        for k in sorted(e):
            yield from element(k, e[k], 2)
        yield "  </entity>\n"
    yield "</dataset>\n"


def flat_xml_document(entities: Iterable[dict], columns: list[str], name: str) -> Iterator[str]:
    """Flat XML of the export: every column of every entity."""
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<dataset name={quoteattr(name)}>\n  <entities>\n'
    for e in entities:
        flat = jsonops.flatten(e, "_source")
        yield "    <entity>\n" + "".join(f"      <{_tag(c)}>{escape(cell_text(flat.get(c)))}</{_tag(c)}>\n" for c in columns) + "    </entity>\n"
    yield "  </entities>\n</dataset>"


def _made(kind: str, entities: list[dict], name: str, columns: list[str]) -> str:
    pieces = json_document(entities) if kind == "json" else xml_document(entities, name) if kind == "xml" else flat_xml_document(entities, columns, name)
    return "".join(pieces).rstrip("\n")


def write_document(df: DataFrame, path: str, kind: str = "json", name: str = "", columns: list[str] | None = None) -> None:
    """Entities (_ord, doc) as one document of kind json, xml or flat: text files under path whose contents in the order of their names are the document.

    Places come from counts of sorted files; each task writes its entities' texts, and the head before the first of all and the tail after the last.
    No rows pass through the driver, so a document may have any size. It ends with a line break.
    """
    columns, none = columns or [], _made(kind, [], name, columns or [])
    mark = {"json": "[", "xml": "</dataset>", "flat": "  </entities>"}[kind]
    head, tail = ("[\n", "\n]") if kind == "json" else (none[: none.rindex(mark)], "\n" + none[none.rindex(mark) :])
    placed = numbered(df.select("_ord", "doc"), [F.col("_ord")], "_at")
    if placed.isEmpty():
        df.sparkSession.createDataFrame([(none,)], "value string").write.text(path)
        return
    last = placed.agg(F.max("_at")).scalar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, at, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = _made(kind, [jsonops.decode(doc) or {}], name, columns)
                text = text[len(head) : len(text) - len(tail)]
                out.append((head if at == 0 else "") + text + (tail if ends else "," if kind == "json" else ""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], names=["value", "_at"])

    texts = placed.select("doc", "_at", (F.col("_at") == last).alias("_ends")).mapInArrow(run, "value string, _at bigint")
    texts.orderBy("_at").select("value").write.text(path)


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out = chr(65 + i % 26) + out
        i = i // 26 - 1
    return out


def workbook(entities: Iterable[dict], columns: list[str]) -> bytes:
    """A workbook with the sheet Data: bold white header on blue, first row frozen, numbers and booleans as such."""
    widths = {c: len(c) for c in columns}

    def cell(ref: str, v, style: str = "") -> str:
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, float):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"{style}><is><t xml:space="preserve">{escape("".join(ch for ch in cell_text(v) if ch >= " " or ch in chr(10) + chr(9)))}</t></is></c>'

    body = io.StringIO()
    body.write('<row r="1">' + "".join(cell(f"{_letters(i)}1", c, ' s="1"') for i, c in enumerate(columns)) + "</row>")
    for n, e in enumerate(entities, 2):
        flat = jsonops.flatten(e, "_source")
        for c in columns:
            widths[c] = max(widths[c], len(cell_text(flat.get(c))))
        body.write(f'<row r="{n}">' + "".join(cell(f"{_letters(i)}{n}", flat.get(c)) for i, c in enumerate(columns)) + "</row>")
    cols = "".join(f'<col min="{i}" max="{i}" width="{min(widths[c] + 4, WIDEST)}" customWidth="1"/>' for i, c in enumerate(columns, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rels}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{HEADER_FILL}"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body.getvalue()}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    return out.getvalue()


def archive(files: dict[str, bytes]) -> bytes:
    """Original and alternative exports in one ZIP."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    return out.getvalue()


def file_name(name: Column, dataset_id: Column, version: Column, extension: str, alt: bool = False) -> Column:
    return F.concat(file_slug(name, dataset_id), F.lit("-v"), version.cast("string"), F.lit("-alt." if alt else "."), F.lit(extension))
