"""The entity query: an option record compiled to a DataFrame plan.

The order of stages is fixed and shows in results: strip source, drop nulls, keep, drop, exact filters, contained
filters, keywords, sort, dedup, sample, offset and limit, then count or flatten. Rows have an order of their own, the column
_ord, which every stage keeps.

Two plans do the same work. compile_typed() takes typed columns and stays in Spark's own expressions, so
filters and columns reach the scan. compile_json() takes entities of any shape as JSON text, and does
all stages that look inside an entity in one pass of Arrow batches; sorting, dedup and paging are Spark's again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import jsonops
from weftline.functions.scalars import go_str, value_text
from weftline.sources.scratch import numbered

ORD, DOC = "_ord", "doc"


@dataclass(frozen=True)
class QuerySpec:
    include_source: bool = True
    denull: bool = False
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    keywords: tuple[str, ...] = ()
    keywords_mode: str = "or"
    sort: str | None = None
    descending: bool = False
    dedup: bool = False
    dedup_key: tuple[str, ...] = ()
    sample: int = 0
    seed: int = 0
    offset: int = 0
    limit: int = 0
    count: bool = False
    flatten: bool = False
    flatten_first: bool = False
    #: Fields of typed rows that stand in no entity (keys of the table itself).
    hidden: tuple[str, ...] = field(default=())

    @staticmethod
    def parse(params: dict[str, str | list[str]]) -> QuerySpec:
        """From a request's parameters; bad numbers count as absent, as do blank names."""
        one = lambda k: (v[-1] if isinstance(v := params.get(k, ""), list) else v).strip()
        many = lambda k: [v] if isinstance(v := params.get(k, []), str) else v
        names = lambda k: tuple(x.strip() for x in one(k).split(",") if x.strip())
        pairs = lambda k: tuple((a.strip(), b.strip().lower()) for a, s, b in (x.partition(":") for x in many(k)) if s and a.strip())
        number = lambda k: int(one(k)) if one(k).isdecimal() else 0
        by, _, way = one("sort").partition(":")
        return QuerySpec(
            include_source=one("include_source") != "false", denull=one("denull") == "true", keep=names("keep_field"), drop=names("drop_field"),
            filters=pairs("filter"), contains=pairs("filter_contains"), keywords=tuple(w.lower() for w in names("keywords")),
            keywords_mode="and" if one("keywords_mode") == "and" else "or", sort=by.strip() or None, descending=way.strip() == "desc",
            dedup=one("dedup") == "true" or bool(names("dedup_key")), dedup_key=names("dedup_key"), sample=number("sample"),
            offset=number("offset"), limit=number("limit"), count=one("count") == "true", flatten=one("flatten") == "true",
        )


# --- shared stages ---------------------------------------------------------------------------------------------


def sort_parts(text: Column) -> list[Column]:
    """Numbers by value before other texts."""
    number = text.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return [number.isNull(), number, F.when(number.isNull(), text)]


def number_parts(c: Column) -> list[Column]:
    """sort_parts() of a numeric column, without its text."""
    number = c.cast("double")
    number = F.when(~F.isnan(number), number)
    return [number.isNull(), number, F.when(c.isNull(), "<nil>").when(number.isNull(), "NaN")]


def sort_keys(parts: list[Column], descending: bool) -> list[Column]:
    """The order of rows by a field; ties keep their own."""
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in parts] + [F.col(ORD).asc()]


def first_of(df: DataFrame, keys: list[Column], parts: list[Column] | None = None, descending: bool = False) -> DataFrame:
    """The first row of each key, in the rows' own order or by the parts of a sort.

    An aggregation that combines before it shuffles: a key that many rows share costs one row a task.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*df.columns)
    if parts is None:
        first = F.min_by(row, ORD)
    elif descending:
        first = F.max_by(row, F.struct(*parts, -F.col(ORD)))
    else:
        first = F.min_by(row, F.struct(*parts, F.col(ORD)))
    return df.groupBy(*named).agg(first.alias("_row")).select("_row.*")


def paged(df: DataFrame, spec: QuerySpec, order: list[Column]) -> DataFrame:
    """Sample, offset and limit over ordered rows. A sample is of the rows whose places have the least hashes with the seed, so it is the same on every run
    and however rows are dealt out. A limit becomes a top-k, not a sort of everything; an offset without one goes by the rows' places."""
    if spec.sample > 0:
        df = df.orderBy(F.md5(F.concat_ws(":", F.lit(spec.seed), F.col(ORD)).cast("binary")), ORD).limit(spec.sample)
    if spec.offset > 0 and spec.limit <= 0:
        return numbered(df, order, "_at").where(F.col("_at") >= spec.offset).orderBy("_at").drop("_at")
    df = df.orderBy(*order)
    if spec.offset > 0:
        df = df.offset(spec.offset)
    return df.limit(spec.limit) if spec.limit > 0 else df


def counted(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """(count): how many rows paged() leaves, without bringing them in order."""
    n = F.count("*")
    if spec.sample > 0:
        n = F.least(n, F.lit(spec.sample))
    n = F.greatest(n - max(spec.offset, 0), F.lit(0))
    return df.agg((F.least(n, F.lit(spec.limit)) if spec.limit > 0 else n).cast("bigint").alias("count"))


# --- typed -----------------------------------------------------------------------------------------------------


def path_texts(schema: T.StructType, path: str) -> Column | None:
    """array of the display forms of what a path leads to; None if the schema has no such path."""
    head, _, rest = path.partition(".")
    if head not in schema.fieldNames():
        return None
    return _texts(F.col(f"`{head}`"), schema[head].dataType, rest)


def _texts(c: Column, kind: T.DataType, rest: str) -> Column | None:
    if isinstance(kind, T.ArrayType) and rest:
        probe = _texts(F.lit(None).cast(kind.elementType), kind.elementType, rest)
        return None if probe is None else F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: _texts(x, kind.elementType, rest)))
    if rest:
        head, _, more = rest.partition(".")
        if not isinstance(kind, T.StructType) or head not in kind.fieldNames():
            return None
        return _texts(c.getField(head), kind[head].dataType, more)
    return F.when(c.isNotNull(), F.array(_text(c, kind))).otherwise(F.array().cast("array<string>"))


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, kind.elementType)), " "), F.lit("]"))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{n}:"), _text(c.getField(n), kind[n].dataType)) for n in sorted(kind.fieldNames())]
        return F.concat(F.lit("map["), F.concat_ws(" ", *parts), F.lit("]"))
    return go_str(c, kind.simpleString())


def leaf_texts(c: Column, kind: T.DataType) -> Column:
    """array of the display forms of all leaves that are not null."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaf_texts(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        return F.concat(*(leaf_texts(c.getField(n), kind[n].dataType) for n in sorted(kind.fieldNames())))
    return F.when(c.isNotNull(), F.array(go_str(c, kind.simpleString()))).otherwise(F.array().cast("array<string>"))


def kept_column(c: Column, kind: T.DataType, tree: dict | None) -> Column | None:
    """c with only what the tree leads to; None if that is nothing."""
    if tree is None or not isinstance(kind, (T.StructType, T.ArrayType)):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: kept_column(x, kind.elementType, tree))
    parts = [(n, kept_column(c.getField(n), kind[n].dataType, tree[n])) for n in kind.fieldNames() if n in tree]
    return F.struct(*(x.alias(n) for n, x in parts if x is not None)) if parts else None


def dropped_column(c: Column, kind: T.DataType, tree: dict | None) -> Column | None:
    """c without what the tree leads to; None if all of it goes."""
    if tree is None:
        return None
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: dropped_column(x, kind.elementType, tree))
    if isinstance(kind, T.StructType):
        parts = [(n, dropped_column(c.getField(n), kind[n].dataType, tree[n]) if n in tree else c.getField(n)) for n in kind.fieldNames()]
        return F.when(c.isNotNull(), F.struct(*(x.alias(n) for n, x in parts if x is not None)))
    return c


def denull_column(c: Column, kind: T.DataType) -> Column:
    """c with blank strings as null, and arrays without their nulls, as null if that leaves them empty."""
    if isinstance(kind, T.StringType):
        return F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", c)
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(c, lambda x: denull_column(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(denull_column(c.getField(n), kind[n].dataType).alias(n) for n in kind.fieldNames())))
    return c


def flat_columns(df: DataFrame) -> list[Column]:
    """Structs by joined names; arrays as JSON text (arrays of structs have no bound, so no columns of their own here)."""
    out: list[Column] = []

    def add(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for n in kind.fieldNames():
                add(c.getField(n), kind[n].dataType, f"{name}_{n}")
        else:
            out.append((F.to_json(c) if isinstance(kind, T.ArrayType) else c).alias(name))

    for f in df.schema.fields:
        add(F.col(f"`{f.name}`"), f.dataType, f.name)
    return out


def compile_typed(spec: QuerySpec, df: DataFrame) -> DataFrame:
    """The plan over typed rows with _ord; nulls count as missing."""
    inner = lambda d: [c for c in d.columns if c != ORD and c not in spec.hidden]
    if not spec.include_source and "_source" in df.columns:
        df = df.drop("_source")
    if spec.flatten_first:
        df = df.select(*flat_columns(df))
    if spec.denull:
        df = df.select(*(c if c == ORD else denull_column(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns))
    if spec.keep:
        tree = jsonops.trie(spec.keep)
        made = [(c, kept_column(F.col(c), df.schema[c].dataType, tree[c])) for c in inner(df) if c in tree]
        df = df.select(ORD, *(c for c in df.columns if c in spec.hidden), *(x.alias(c) for c, x in made if x is not None))
    if spec.drop:
        tree = jsonops.trie(spec.drop)
        made = [(c, dropped_column(F.col(c), df.schema[c].dataType, tree[c]) if c in tree and c != ORD else F.col(c)) for c in df.columns]
        df = df.select(*(x.alias(c) for c, x in made if x is not None))
    for part, pairs in ((False, spec.filters), (True, spec.contains)):
        for path, wanted in pairs:
            texts = path_texts(df.schema, path)
            if texts is None:
                df = df.where(F.lit(False))
            elif "." not in path and isinstance(df.schema[path].dataType, T.StringType):
                # A plain comparison is what a scan can skip by.
                df = df.where(F.lower(path).contains(wanted) if part else F.lower(path) == wanted)
            else:
                df = df.where(F.exists(texts, (lambda x: F.lower(x).contains(wanted)) if part else (lambda x: F.lower(x) == wanted)))  # noqa: B023
    if spec.keywords:
        words = F.lower(F.array_join(F.concat(*(leaf_texts(F.col(c), df.schema[c].dataType) for c in sorted(inner(df)))), " "))
        hits = [words.contains(w) for w in spec.keywords]
        test = hits[0]
        for h in hits[1:]:
            test = (test & h) if spec.keywords_mode == "and" else (test | h)
        df = df.where(test)
    parts = None
    if spec.sort:
        kind = df.schema[spec.sort].dataType if spec.sort in df.columns else None
        if isinstance(kind, T.NumericType):
            parts = number_parts(F.col(spec.sort))
        else:
            parts = sort_parts(go_str(F.col(spec.sort), kind.simpleString()) if kind else F.lit("<nil>"))
    order = [F.col(ORD).asc()] if parts is None else sort_keys(parts, spec.descending)
    if spec.dedup or spec.dedup_key:
        keys = list(spec.dedup_key) or sorted(c for c in inner(df) if c != "_source")
        df = first_of(df, [F.col(k) if k in df.columns else F.lit(None) for k in keys], parts, spec.descending)
    if spec.count:
        return counted(df, spec)
    df = paged(df, spec, order)
    return df.select(*flat_columns(df)) if spec.flatten and not spec.flatten_first else df


# --- JSON ------------------------------------------------------------------------------------------------------


def shaped(spec: QuerySpec, entity) -> dict | None:
    """The stages that look inside one entity; None where a filter turns it away."""
    if not isinstance(entity, dict):
        return None
    if spec.flatten_first:
        entity = jsonops.flatten(entity)
    if not spec.include_source:
        entity = {k: v for k, v in entity.items() if k != "_source"}
    if spec.denull:
        entity = jsonops.denull(entity)
    if spec.keep:
        entity = jsonops.keep(entity, jsonops.trie(spec.keep))
    if spec.drop:
        entity = jsonops.drop(entity, jsonops.trie(spec.drop))
    if not all(jsonops.matches(entity, p, w, False) for p, w in spec.filters) or not all(jsonops.matches(entity, p, w, True) for p, w in spec.contains):
        return None
    if spec.keywords and not jsonops.has_keywords(entity, list(spec.keywords), spec.keywords_mode == "and"):
        return None
    return entity


def compile_json(spec: QuerySpec, df: DataFrame) -> DataFrame:
    """The plan over (_ord, doc): doc an entity's JSON text. Result: (_ord, doc) or (count)."""
    spec = replace(spec, keywords=tuple(w.lower() for w in spec.keywords))
    schema = f"{ORD} bigint, {DOC} string, _sort string, _hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for o, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entity = shaped(spec, jsonops.decode(text))
                if entity is None:
                    continue
                by = value_text(entity.get(spec.sort)) if spec.sort else None
                key = jsonops.entity_hash(entity, spec.dedup_key or None) if spec.dedup or spec.dedup_key else None
                if spec.flatten and not spec.flatten_first and not spec.count:
                    entity = jsonops.flatten(entity)
                rows.append((o, jsonops.canonical(entity), by, key))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=[ORD, DOC, "_sort", "_hash"])

    out = df.select(F.col(ORD).cast("bigint"), DOC).mapInArrow(run, schema)
    parts = sort_parts(F.col("_sort")) if spec.sort else None
    order = [F.col(ORD).asc()] if parts is None else sort_keys(parts, spec.descending)
    if spec.dedup or spec.dedup_key:
        out = first_of(out, [F.col("_hash")], parts, spec.descending)
    return counted(out, spec) if spec.count else paged(out, spec, order).select(ORD, DOC)


def page(df: DataFrame, number: int, limit: int = 100, most: int = 500) -> DataFrame:
    """Rows (number - 1) * limit and on of df by _ord (dense from 0), with total and total_pages of all."""
    limit = min(limit if limit > 0 else 100, most)
    start = (max(number, 1) - 1) * limit
    total = df.agg(F.count("*")).scalar()
    rows = df.where(F.col(ORD).between(start, start + limit - 1)).withColumn("total", total)
    return rows.withColumn("total_pages", F.ceil(F.col("total") / limit)).orderBy(ORD)
