"""What JSON values mean to the rules: their text, truth, number and list, whatever type they were written in.

``member`` gives null for a key that is not there and a variant null for a null that is written: the rules
tell the two apart.  Lists and objects as text are JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

_WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*$"
_NUMBER = r"(?i)^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def member(raw: Column | str, name: str) -> Column:
    return F.try_variant_get(F.col(raw) if isinstance(raw, str) else raw, f"$.{name}", "variant")


def elements(v: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is(v: Column, *kinds: str) -> Column:
    """Whether the value's type is one of those named; the names of some go on after it (``DECIMAL(3,1)``).  Three letters tell them
    apart, and no pattern is run: this is asked of every value of every fact."""
    return F.substring(F.schema_of_variant(v), 1, 3).isin(*(k[:3] for k in kinds))


def written(v: Column, missing: str | None = None) -> Column:
    """The value as text; null where it is null, ``missing`` where there is none."""
    other = F.when(_is(v, "BOOLEAN"), F.initcap(_string(v))).when(_is(v, "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").cast("string")).otherwise(_string(v))
    return F.when(v.isNull(), F.lit(missing)).when(_is(v, "STRING"), _string(v)).when(~F.is_variant_null(v), other)


#: Texts that ``written`` gives of values without truth; texts that were written so have it, but for the empty one.
FALSE_TEXTS = ("", "0", "0.0", "-0.0", "False", "[]", "{}")


def truthy(v: Column) -> Column:
    """False for nulls, empty texts, lists and objects, zeros and false."""
    empty = F.when(_is(v, "STRING"), _string(v) == "").when(_is(v, "ARRAY", "OBJECT"), _string(v).isin("[]", "{}")).otherwise(F.try_variant_get(v, "$", "double") == 0)
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v) & ~empty, F.lit(False))


def _spelled_number(text: Column) -> Column:
    return F.when(strip(text).rlike(_NUMBER), F.replace(strip(text), F.lit("_")).try_cast("double"))


def _spelled_whole(text: Column) -> Column:
    return F.when(strip(text).rlike(_WHOLE), F.replace(strip(text), F.lit("_")).try_cast("bigint"))


def number(v: Column) -> Column:
    """A number, a truth value as 1 or 0, or a text that spells a number; else null."""
    return F.when(_is(v, "STRING"), _spelled_number(_string(v))).when(~_is(v, "ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "double"))


def whole_number(v: Column) -> Column:
    """A number without its fraction, or a text that spells a whole number; else null."""
    return F.when(_is(v, "STRING"), _spelled_whole(_string(v))).when(~_is(v, "ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "double").try_cast("bigint"))


def listed_texts(v: Column) -> Column:
    """The items of a list as texts, those without truth as empty and nulls as nulls; one item for any other value with truth."""
    each = F.transform(elements(v), lambda x: F.when(F.is_variant_null(x), F.lit(None).cast("string")).when(truthy(x), written(x)).otherwise(F.lit("")))
    none = F.array().cast("array<string>")
    return F.when(_is(v, "ARRAY"), each).otherwise(F.when(truthy(v), F.array(written(v))).otherwise(none))


def is_text(v: Column) -> Column:
    return F.coalesce(_is(v, "STRING"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(_is(v, "ARRAY"), F.lit(False))


def texts(v: Column) -> Column:
    """All fields of an object as texts, made in one go: each value taken out and turned into a text by itself costs several times that."""
    return F.try_variant_get(v, "$", "map<string,string>")


class Field:
    """A field of an object by its text in ``texts``; the value itself is looked at only where the text leaves open what was written."""

    def __init__(self, raw: str, fields: str, name: str) -> None:
        self.value, self.text = member(raw, name), F.element_at(fields, F.lit(name))
        self.there = F.map_contains_key(F.col(fields), name)

    def written(self, missing: str | None = None) -> Column:
        open_ = self.text.isin("true", "false") | self.text.rlike(r"^-?[0-9][0-9.]*(E-?[0-9]+)?$")
        known = F.when(open_, written(self.value)).otherwise(self.text)
        return known if missing is None else F.when(self.text.isNull() & ~self.there, F.lit(missing)).otherwise(known)

    def number(self) -> Column:
        return F.when(self.text.isin("true", "false"), number(self.value)).otherwise(_spelled_number(self.text))

    def whole_number(self) -> Column:
        whole = strip(self.text).rlike(_WHOLE)
        return F.when(whole, _spelled_whole(self.text)).when(self.text.isNotNull(), whole_number(self.value))

    def listed_texts(self) -> Column:
        return F.when(self.text.isNull(), F.array().cast("array<string>")).otherwise(listed_texts(self.value))
