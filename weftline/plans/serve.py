"""Serving a version: from a request's parameters to a document in the format asked for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from weftline.functions import jsonops
from weftline.functions.scalars import canonical
from weftline.operators.query import QuerySpec, compile_json
from weftline.sources import codecs

#: Formats whose rows are flat.
FLAT = frozenset({"csv", "tsv", "parquet", "xlsx"})


def answer(entities: DataFrame, params: dict, name: str = "dataset") -> Iterator[str | bytes]:
    """The document for params over (_ord, doc), a piece at a time: json (pretty unless pretty=false), jsonl, csv, tsv, xml, xlsx, or a count."""
    spec = QuerySpec.parse(params)
    fmt = str(params.get("format", "json"))
    out = compile_json(spec, entities)
    if spec.count:
        yield canonical({"count": float(out.first()["count"])})
    elif fmt == "jsonl":
        yield from (canonical(e) + "\n" for e in codecs.ordered(out, sort=False))
    elif fmt in ("csv", "tsv"):
        yield from _rows(out, "," if fmt == "csv" else "\t")
    elif fmt == "xml":
        yield from codecs.xml_document(codecs.ordered(out, sort=False), name)
    elif fmt == "xlsx":
        yield codecs.workbook(codecs.ordered(out, sort=False), codecs.columns_of(out))
    else:
        yield from codecs.json_document(codecs.ordered(out, sort=False), str(params.get("pretty")) != "false")


def _rows(out: DataFrame, sep: str) -> Iterator[str]:
    """Lines of cells with a header; nothing at all without entities."""
    import csv
    import io

    names = codecs.columns_of(out, skip=None)
    first = True
    for e in codecs.ordered(out, sort=False):
        flat = jsonops.flatten(e)
        held = io.StringIO()
        w = csv.writer(held, delimiter=sep, lineterminator="\n")
        if first:
            w.writerow(names)
            first = False
        w.writerow([codecs.cell_text(flat.get(n)) for n in names])
        yield held.getvalue()
