"""String functions whose rules differ between languages: white space, blanks, templates, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and ECMAScript's trim remove.
_COMMON = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_PY = "".join(map(chr, sorted([*_COMMON, *range(0x1C, 0x20), 0x85])))
WS_JS = "".join(map(chr, sorted([*_COMMON, 0xFEFF])))


def strip_py(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_PY))


def strip_js(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_JS))


def is_filled(c: Column, white: str = WS_PY) -> Column:
    """Whether anything is left after stripping; false for null."""
    return F.coalesce(F.length(F.btrim(c, F.lit(white))) > 0, F.lit(False))


def or_else(*cols: Column | str) -> Column:
    """The first that is neither null nor empty; strings are literals."""
    as_cols = [F.lit(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in as_cols[:-1]], as_cols[-1])


def text_or_empty(c: Column) -> Column:
    """A value as text; null becomes empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_simple(c: Column) -> Column:
    """Lower case by single characters, as DuckDB has it; ``lower`` makes two of İ and looks at what is around a Σ."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def first_tag(c: Column) -> Column:
    """Before the first comma and the first semicolon: the first tag of an Accept-Language header."""
    return F.split_part(F.split_part(c, F.lit(","), F.lit(1)), F.lit(";"), F.lit(1))


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """``{name}`` placeholders replaced in one pass, so that values are never expanded themselves.

    A template with a placeholder that has no value stays as it is; so does any without ``values``."""
    if not values:
        return template
    pieces = F.split(template, r"(?=\{)|(?<=\})")
    names = [f"{{{k}}}" for k in values]
    unknown = F.exists(pieces, lambda p: p.rlike(r"^\{\w+\}$") & ~p.isin(names))

    def put(p: Column) -> Column:
        out = p
        for k, v in values.items():
            out = F.when(p == f"{{{k}}}", text_or_empty(v)).otherwise(out)
        return out

    return F.when(unknown, template).otherwise(F.array_join(F.transform(pieces, put), ""))


def preview(c: Column, n: int = 50) -> Column:
    """The first n characters and an ellipsis, whatever the length."""
    return F.concat(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit("..."))


def unquote(c: Column) -> Column:
    """Without one pair of equal quotes around it; a lone quote counts as a pair."""
    pair = (c.startswith('"') & c.endswith('"')) | (c.startswith("'") & c.endswith("'"))
    inner = F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.when(pair, inner).otherwise(c)


def without_export(c: Column) -> Column:
    return F.when(c.startswith("export "), strip_js(F.substring(c, F.lit(8), F.length(c)))).otherwise(c)


def list_items(c: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones, each once at its first place."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip_js), lambda x: x != ""))


def required_list(c: Column, what: str) -> Column:
    """``list_items``, or an error where none is left."""
    items = list_items(F.coalesce(c, F.lit("")))
    return F.when(F.size(items) > 0, items).otherwise(F.raise_error(F.lit(f"{what} needs at least one item")).cast("array<string>"))


def is_url(c: Column) -> Column:
    """Whether an absolute URL can be read from it (by Java's grammar)."""
    return F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull()


def resolved_path(c: Column, base: str) -> Column:
    """A path that is absolute, or the same under ``base``."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def label_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip_js(c), F.lit("")), F.lit(default))


def cell_column(ref: Column) -> Column:
    return F.regexp_replace(ref, r"[^\p{L}]", "")


def cell_row(ref: Column) -> Column:
    return F.regexp_replace(ref, r"[^\p{Nd}]", "").try_cast("int")


def slide_number(member: Column) -> Column:
    """The digits after ``slide``, or ``?``."""
    return or_else(F.regexp_extract(member, r"slide(\d+)", 1), F.lit("?"))


def xml_texts(xml: Column, local_name: str) -> Column:
    """Texts of all elements of this local name, in any namespace."""
    return F.xpath(xml, F.lit(f"//*[local-name()='{local_name}']/text()"))
