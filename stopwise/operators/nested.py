"""Nested documents: flattening, renaming, and JSON arrays held in text cells."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here)
        else:
            yield here


def _field(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{part}`" for part in path))


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """All struct fields as top-level columns named by their path; arrays stay whole."""
    return df.select(*[_field(p).alias(separator.join(p)) for p in _leaves(df.schema)])


def map_fields(df: DataFrame, names: Mapping[str, str], block: str | None = None) -> DataFrame:
    """Keep the columns (or the fields of struct ``block``) named in ``names``, under new names.

    Names the input does not have are left out.
    """
    present = set(df.schema[block].dataType.names if block else df.columns)
    prefix = (block,) if block else ()
    return df.select(*[_field((*prefix, old)).alias(new) for old, new in names.items() if old in present])


def optional_column(df: DataFrame, name: str, data_type: T.DataType | str) -> Column:
    """The column if the input has it, else a null of the given type."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(data_type)


# A quoted string of either kind, or what stands between two of them. Possessive, so a long cell costs no stack.
_TOKEN = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++"""
_ESCAPED = r"(?<!\\)((?:\\\\)*+)\\"  # an escaping backslash, after any number of escaped ones


def _json_string(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    plain = F.regexp_replace(inner, _ESCAPED + "'", "$1'")
    hexed = F.regexp_replace(plain, _ESCAPED + "x([0-9a-fA-F]{2})", r"$1\\u00$2")
    single = token.startswith("'")
    quoted = F.when(single, F.regexp_replace(hexed, r'(?<!\\)((?:\\\\)*+)"', r'$1\\"')).otherwise(hexed)
    special = token.contains("\\") | (single & token.contains('"'))  # the others need no rewriting
    return F.concat(F.lit('"'), F.when(special, quoted).otherwise(inner), F.lit('"'))


def _json_bare(token: Column) -> Column:
    json = token
    for literal, value in (("None", "null"), ("True", "true"), ("False", "false")):
        json = F.regexp_replace(json, rf"\b{literal}\b", value)
    json = F.regexp_replace(json, r",(\s*[\]}])", "$1")
    return F.when(token.rlike(r"None|True|False|,\s*[\]}]"), json).otherwise(token)


def literal_to_json(text: Column) -> Column:
    """A Python literal of lists, dictionaries, strings, numbers, ``None`` and booleans as JSON text.

    Strings are taken out whole first, so a name inside one is never touched. Text that is no such literal
    comes out as no JSON either. Built-in functions only.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.startswith("'") | t.startswith('"'), _json_string(t)).otherwise(_json_bare(t))), ""
    )


def parse_json_array(
    df: DataFrame, column: str, items: str, into: str, repair_literals: bool = True
) -> DataFrame:
    """Parse a text column holding a JSON array of ``items`` (a DDL type).

    Adds ``into`` (the array) and ``{into}_bad`` (text was there, no array came out). Cells that were
    written as Python literals (``None``, ``True``, mixed quotes) are not JSON and are rewritten first.
    """
    array = f"array<{items}>"
    text = F.col(f"`{column}`")
    first, rewritten = f"__{into}_json", f"__{into}_rewritten"
    # The parser costs some microseconds a cell whatever the cell holds, so it is called no more than needed.
    parsed = df.withColumn(first, F.when(text == "[]", F.array().cast(array)).otherwise(F.from_json(text, array)))
    result = F.col(first)
    if repair_literals:
        parsed = parsed.withColumn(rewritten, F.when(result.isNull(), literal_to_json(text)))
        # Text that comes out as it was is not parsed again.
        result = F.coalesce(result, F.from_json(F.when(F.col(rewritten) != text, F.col(rewritten)), array))
    return parsed.withColumns(
        {into: result, f"{into}_bad": text.isNotNull() & result.isNull()}
    ).drop(first, rewritten)


def quality_counts(df: DataFrame) -> DataFrame:
    """Rows, and per parsed column the cells that could not be read (one row)."""
    bad = [c for c in df.columns if c.endswith("_bad")]
    return df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`")).alias(c) for c in bad]
    )
