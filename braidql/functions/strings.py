"""Strings and conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import FilterError, Typed, const, double, register, shown, text


@register("concat", low=1, high=99)
def _concat(*args: Typed) -> Column:
    return F.concat(*[shown(a) for a in args])


@register("contains", low=2)
def _contains(x: Typed, needle: Typed) -> Column:
    if x.is_array:
        return F.coalesce(F.array_contains(x.col, needle.col), F.lit(False))
    return F.coalesce(F.contains(x.col, needle.col), F.lit(False)) if x.is_string and needle.is_string else F.lit(False)


@register("startswith", low=2, each="str")
def _startswith(x: Typed, y: Typed) -> Column:
    return F.coalesce(F.startswith(x.col, y.col), F.lit(False)) if x.is_string and y.is_string else F.lit(False)


@register("endswith", low=2, each="str")
def _endswith(x: Typed, y: Typed) -> Column:
    return F.coalesce(F.endswith(x.col, y.col), F.lit(False)) if x.is_string and y.is_string else F.lit(False)


@register("lowercase", "tolower", each="str")
def _lower(x: Typed) -> Column:
    return F.lower(x.col)


@register("uppercase", "toupper", each="str")
def _upper(x: Typed) -> Column:
    return F.upper(x.col)


@register("trim", each="str")
def _trim(x: Typed) -> Column:
    return F.regexp_replace(x.col, r"(?U)^\s+|\s+$", "")


@register("lstrip", each="str")
def _lstrip(x: Typed) -> Column:
    return F.regexp_replace(x.col, r"(?U)^\s+", "")


@register("rstrip", each="str")
def _rstrip(x: Typed) -> Column:
    return F.regexp_replace(x.col, r"(?U)\s+$", "")


@register("replace", low=3, each="str")
def _replace(x: Typed, old: Typed, new: Typed) -> Column:
    return F.replace(x.col, old.col, new.col)


@register("split", low=1, high=2, each="str")
def _split(x: Typed, *sep: Typed) -> Column:
    by = const(sep[0], "the separator of split") if sep else " "
    return F.split(x.col, re.escape(by) if by else "(?!^)(?!$)", -1)


@register("join", low=2)
def _join(x: Typed, sep: Typed) -> Column:
    return F.array_join(F.transform(x.col, lambda v: shown(Typed(v, x.dtype.elementType))), const(sep, "the separator of join"))


# Word borders of case conversions: between a small letter or digit and a capital, before the last of several capitals, and at anything that is no letter or digit.
def _word_list(c: Column) -> Column:
    c = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


@register("titlecase", each="str")
def _titlecase(x: Typed) -> Column:
    return F.array_join(F.transform(_word_list(x.col), _capital), " ")


@register("camel_case", each="str")
def _camel(x: Typed) -> Column:
    return F.array_join(F.transform(_word_list(x.col), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")


@register("snake_case", each="str")
def _snake(x: Typed) -> Column:
    return F.lower(F.array_join(_word_list(x.col), "_"))


@register("to_ascii", each="str")
def _to_ascii(x: Typed) -> Column:
    chars = F.filter(F.split(x.col, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.ascii(c).cast("string")), " ")


# Latin spelling of each Cyrillic letter.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "yu", "я": "ya",
}


@register("transliterate", low=3, each="str")
def _transliterate(x: Typed, source: Typed, target: Typed) -> Column:
    pair = (const(source, "a script").lower(), const(target, "a script").lower())
    if pair != ("cyrillic", "latin"):
        raise FilterError(f"cannot transliterate from {pair[0]} to {pair[1]}")
    table = CYRILLIC | {k.upper(): v.capitalize() for k, v in CYRILLIC.items()}
    out = x.col
    for letter, latin in table.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in table.items() if len(v) == 1}
    dropped = "".join(k for k, v in table.items() if not v)
    return F.translate(out, "".join(single) + dropped, "".join(single.values()))


# English plurals that follow no rule.
IRREGULAR = {
    "child": "children", "person": "people", "man": "men", "woman": "women", "tooth": "teeth", "foot": "feet", "mouse": "mice", "goose": "geese", "ox": "oxen",
    "sheep": "sheep", "fish": "fish", "deer": "deer", "species": "species", "series": "series",
}


#: Of these ``pluralize`` knows; any other word follows its rules.
PLURALS = ("child", "man", "woman", "ox", "goose", "tooth", "foot")


def _by_rules(x: Column, known: dict[str, str], rules: list[tuple[str, str, str]], otherwise: Column) -> Column:
    """The first rule whose pattern matches rewrites the word."""
    out = otherwise
    for test, pattern, into in reversed(rules):
        out = F.when(x.rlike(test), F.regexp_replace(x, pattern, into)).otherwise(out)
    for word, other in reversed(list(known.items())):
        out = F.when(F.lower(x) == word, F.lit(other)).otherwise(out)
    return F.when(x == "", x).otherwise(out)


@register("pluralize", each="str")
def _pluralize(x: Typed) -> Column:
    rules = [("(?i)[aeiou]z$", "(?i)z$", "zzes"), ("(?i)(s|sh|ch|x|z)$", "$", "es"), ("(?i)[^aeiou]y$", "(?i)y$", "ies"), ("(?i)fe$", "(?i)fe$", "ves"), ("(?i)f$", "(?i)f$", "ves")]
    return _by_rules(x.col, {k: IRREGULAR[k] for k in PLURALS}, rules, F.concat(x.col, F.lit("s")))


@register("singular", each="str")
def _singular(x: Typed) -> Column:
    rules = [("(?i)ies$", "ies$", "y"), ("(?i)ves$", "ves$", "f"), ("(?i)(ss|us)$", "$", ""), ("(?i)(s|sh|ch|x|z)es$", "es$", ""), ("(?i)s$", "s$", "")]
    return _by_rules(x.col, {v: k for k, v in IRREGULAR.items()}, rules, x.col)


def _grouped(c: Column, digits: int) -> Column:
    return F.format_number(c, digits)


@register("humanize", low=1, high=2)
def _humanize(x: Typed, *form: Typed) -> Column:
    kind = const(form[0], "the form of humanize") if form else ("number" if x.is_number else "text")
    if kind == "number":
        return _grouped(x.col, 0) if x.is_integer else _grouped(double(x), 2)
    if kind == "currency":
        amount = double(x) / 100 if x.is_integer else double(x)
        return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), _grouped(F.abs(amount), 2))
    if kind == "percentage":
        return F.concat(F.format_string("%.1f", double(x) * 100), F.lit("%"))
    if kind == "bytes":
        units = ["B", "KB", "MB", "GB", "TB", "PB"]
        out = F.format_string(f"%.1f {units[-1]}", double(x) / 1024.0 ** (len(units) - 1))
        for i in range(len(units) - 2, -1, -1):
            own = F.format_string("%.1f " + units[i], double(x) / 1024.0**i) if i else F.concat(x.col.cast("long").cast("string"), F.lit(" B"))
            out = F.when(F.abs(double(x)) < 1024.0 ** (i + 1), own).otherwise(out)
        return out
    if kind == "date":
        from .dates import instant

        return F.date_format(instant(x), "MMMM d, yyyy")
    if kind == "text":
        return F.initcap(F.regexp_replace(text(x), "[_-]+", " "))
    raise FilterError(f"humanize has no form {kind}")


@register("dos2unix", each="str")
def _dos2unix(x: Typed) -> Column:
    return F.replace(x.col, F.lit("\r\n"), F.lit("\n"))


@register("unix2dos", each="str")
def _unix2dos(x: Typed) -> Column:
    return F.replace(x.col, F.lit("\n"), F.lit("\r\n"))


@register("tabs_to_spaces", low=1, high=2, each="str")
def _tabs_to_spaces(x: Typed, *n: Typed) -> Column:
    return F.replace(x.col, F.lit("\t"), F.lit(" " * int(n[0].value if n else 4)))


@register("spaces_to_tabs", low=1, high=2, each="str")
def _spaces_to_tabs(x: Typed, *n: Typed) -> Column:
    return F.replace(x.col, F.lit(" " * int(n[0].value if n else 4)), F.lit("\t"))


@register("is_valid_utf8", each="any")
def _is_valid_utf8(x: Typed) -> Column:
    if isinstance(x.dtype, T.BinaryType):
        return F.is_valid_utf8(x.col.cast("string"))
    if not x.is_string:
        return F.lit(False)
    hexed = x.col.rlike("^([0-9A-Fa-f]{2})+$")
    return F.when(hexed, F.is_valid_utf8(F.unhex(x.col).cast("string"))).otherwise(x.col.isNotNull())


@register("to_valid_utf8", each="str")
def _to_valid_utf8(x: Typed) -> Column:
    return x.col if x.is_string else F.make_valid_utf8(x.col.cast("string"))


@register("length", "len")
def _length(x: Typed) -> Column:
    if x.is_null:
        return F.lit(0)
    if x.is_string:
        return F.coalesce(F.char_length(x.col), F.lit(0))
    if x.is_array or isinstance(x.dtype, T.MapType):
        return F.when(x.col.isNull(), 0).otherwise(F.size(x.col))
    return F.when(x.col.isNull(), 0).otherwise(F.lit(len(x.dtype.fields) if x.is_struct else 1))


@register("tostring")
def _tostring(x: Typed) -> Column:
    return shown(x)


@register("tonumber")
def _tonumber(x: Typed) -> Column:
    return x.col if x.is_number else text(x).try_cast("double")
