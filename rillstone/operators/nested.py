"""Nested change documents as flat, related tables.

One Higher-order SQL projection per target table: the text is parsed once into a
variant, nested ``transform`` calls attach the keys and positions of all
ancestors, ``flatten`` joins the arrays and a single ``inline`` emits the rows.
There is no shuffle and no Python; hot keys cannot hurt because rows never meet.

Defined results
    * null, empty or blank text, or text that isn't exactly one JSON document
      (RFC 8259: no trailing data, no NaN, no single quotes): no rows.
    * repeated names in an object: the last value holds.
    * a document that is one element instead of a list is element 0; an element
      without ``ops`` and ``positions`` is a bare cube diff, its own only op.
    * absent or null optional fields: null columns, or no child rows.
    * an entry that isn't an object with an integer ``id`` gives no row, but
      keeps its position.
    * repeated rows and ties: each input row gives its own rows; use ``distinct``.
    * empty tables: no rows, same schema. Input columns other than the keys and
      the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a chunk as they are cast; ``id`` first.
CHUNK_FIELDS = {
    "id": "bigint", "min": "array<string>", "max": "array<string>", "count": "bigint",
    "measures": "array<string>", "meta": "struct<node:string,tags:array<struct<k:string,v:string>>>",
}
TABLES = ("log_diffs", "positions", "ops", "chunks", "measures", "tags")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_document(text: Column) -> Column:
    """The variant of a text that is exactly one JSON document, else null.

    The text becomes the first of two elements of an array whose second is a
    hash of the text. A text that ends early, or goes on after its document,
    can't put its own hash there. Jackson then checks every token.
    """
    mark = F.xxhash64(text)
    wrapped = F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))
    return _let(
        F.try_parse_json(wrapped),
        lambda v: F.when(F.try_variant_get(v, "$[1]", "bigint") == mark, F.try_variant_get(v, "$[0]", "variant")),
    )


def _ops_type(fields: tuple[str, ...]) -> str:
    chunk = "struct<" + ",".join(f"`{f}`:{CHUNK_FIELDS[f]}" for f in fields) + ">"
    return f"map<string,struct<added:array<{chunk}>,removed:array<{chunk}>>>"


def log_diffs(text: Column, fields: tuple[str, ...] = ("id",)) -> Column:
    """array<struct<is_object, bare, positions, ops>> of a document text: its log diffs in order."""
    ops = _ops_type(fields)
    positions = "array<struct<log:string,`from`:array<string>,`to`:array<string>>>"

    def one(e: Column) -> Column:
        return _let(
            F.struct(e.alias("e"), F.map_keys(F.try_variant_get(e, "$", "map<string,variant>")).alias("names")),
            lambda x: _let(
                F.struct(x["e"].alias("e"), x["names"].isNotNull().alias("is_object"), (~F.arrays_overlap(x["names"], F.array(F.lit("ops"), F.lit("positions")))).alias("bare")),
                lambda y: F.struct(
                    y["is_object"].alias("is_object"),
                    y["bare"].alias("bare"),
                    F.when(~y["bare"], F.try_variant_get(y["e"], "$.positions", positions)).alias("positions"),
                    F.when(y["bare"], F.array(F.try_variant_get(y["e"], "$", ops)))
                    .when(y["is_object"], F.try_variant_get(y["e"], "$.ops", f"array<{ops}>"))
                    .alias("ops"),
                ),
            ),
        )

    return _let(
        json_document(text),
        lambda v: F.transform(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), one),
    )


def _each(items: Column, body) -> Column:
    """flatten(transform(items, body)) where ``body`` gives an array; null or absent arrays give nothing."""
    return F.flatten(F.filter(F.transform(items, body), lambda a: a.isNotNull()))


def _chunks(docs: Column, emit) -> Column:
    """flatten of ``emit(diff_no, op_no, aggregation, change, entry_no, chunk)`` (an array) over all chunk entries."""

    def side(d, o, a, name, entries):
        return _each(entries, lambda c, n: F.when(c["id"].isNotNull(), emit(d, o, a, F.lit(name), n, c)))

    return _each(
        docs,
        lambda x, d: _each(
            x["ops"],
            lambda op, o: _each(
                F.map_entries(op),
                lambda m: F.concat(
                    F.coalesce(side(d, o, m["key"], "added", m["value"]["added"]), F.array()),
                    F.coalesce(side(d, o, m["key"], "removed", m["value"]["removed"]), F.array()),
                ),
            ),
        ),
    )


def _rows(table: str, docs: Column, fields: tuple[str, ...], tags: bool = False) -> Column:
    big = lambda c: c.cast("bigint")
    if table == "log_diffs":
        return _each(docs, lambda x, d: F.when(x["is_object"], F.array(F.struct(big(d).alias("diff_no"), x["bare"].alias("bare"), F.size(F.coalesce(x["positions"], F.array())).alias("n_positions"), F.size(F.coalesce(x["ops"], F.array())).alias("n_ops")))))
    if table == "positions":
        def position(d, p, n):
            ends = [F.get(p[side], F.lit(i)).cast(kind).alias(f"{side}_{name}") for side in ("from", "to") for i, (name, kind) in enumerate((("file", "string"), ("remainder", "bigint"), ("position", "bigint")))]
            return F.struct(big(d).alias("diff_no"), big(n).alias("position_no"), p["log"].alias("log"), *ends)

        return _each(docs, lambda x, d: F.transform(x["positions"], lambda p, n: position(d, p, n)))
    if table == "ops":
        return _each(docs, lambda x, d: _each(x["ops"], lambda op, o: F.transform(F.map_entries(op), lambda m: F.struct(big(d).alias("diff_no"), big(o).alias("op_no"), m["key"].alias("aggregation"), F.size(F.coalesce(m["value"]["added"], F.array())).alias("n_added"), F.size(F.coalesce(m["value"]["removed"], F.array())).alias("n_removed")))))
    head = lambda d, o, a, ch, n, c: (big(d).alias("diff_no"), big(o).alias("op_no"), a.alias("aggregation"), ch.alias("change"), big(n).alias("entry_no"), c["id"].alias("chunk_id"))
    if table == "chunks":
        more = lambda c: [c[f].alias(f) for f in fields if f not in ("id", "meta")] + ([c["meta"]["node"].alias("node")] if "meta" in fields else []) + ([c["meta"]["tags"].alias("tags")] if tags else [])
        return _chunks(docs, lambda *x: F.array(F.struct(*head(*x), *more(x[-1]))))
    if table == "measures":
        return _chunks(docs, lambda *x: F.transform(x[-1]["measures"], lambda m, i: F.struct(*head(*x), big(i).alias("measure_no"), m.alias("measure"))))
    if table == "tags":
        return _chunks(docs, lambda *x: F.transform(x[-1]["meta"]["tags"], lambda t, i: F.struct(*head(*x), big(i).alias("tag_no"), t["k"].alias("k"), t["v"].alias("v"))))
    raise ValueError(f"no such table: {table}")


_FIELDS = {"chunks": ("id",), "measures": ("id", "measures"), "tags": ("id", "meta")}


def nested_table(df: DataFrame, table: str, text: str, keys: list[str], fields: tuple[str, ...] | None = None) -> DataFrame:
    """The flat table ``table`` (one of TABLES) of the documents in column ``text``.

    ``keys`` are the columns of ``df`` that identify the document; they come
    first in the result. ``fields`` are the chunk fields read for ``chunks``
    (from CHUNK_FIELDS); only these are cast. Defined results: see the module.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    fields = tuple(fields or _FIELDS.get(table, ("id",)))
    rows = _rows(table, log_diffs(F.col(text), fields), fields)
    return df.where(F.col(text).isNotNull()).select(*keys, F.inline(rows))


def nested_tables(df: DataFrame, text: str, keys: list[str]) -> dict[str, DataFrame]:
    """All of TABLES with every field."""
    return {t: nested_table(df, t, text, keys, tuple(CHUNK_FIELDS) if t == "chunks" else None) for t in TABLES}
