"""Column functions for markers, numbers, references and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of Chinese numerals and what they stand for.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}
#: Characters that open an item of a bulleted list, and what may follow a marker besides white space and the end.
BULLETS = "•·●○◦▪‣■★☆▸►◊"
AFTER_MARKER = "「『“\"'（(一-鿿"
FULL_WIDTH = "０１２３４５６７８９"
#: White space beyond what Java's \s holds.
BLANK = r"\s\u00a0\u2000-\u200a\u3000"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, FULL_WIDTH, "0123456789")


def chinese_number(text: Column) -> Column:
    """The value of a Chinese numeral below a thousand, null where it is none or zero."""
    digits, units = literal_map(DIGITS), literal_map(UNITS)
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("digit"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        digit, unit = F.try_element_at(digits, c), F.try_element_at(units, c)
        return F.when(unit.isNotNull(), F.struct(
            (acc.total + unit * F.when(acc.digit <= 0, F.lit(1)).otherwise(acc.digit)).alias("total"), F.lit(-1).alias("digit"), acc.ok.alias("ok")
        )).otherwise(F.struct(acc.total.alias("total"), F.coalesce(digit, F.lit(0)).alias("digit"), (acc.ok & digit.isNotNull()).alias("ok")))

    done = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    value = done.total + F.when(done.digit > 0, done.digit).otherwise(F.lit(0))
    return F.when(done.ok & (value > 0), value)


#: The kinds of markers, each with the pattern of its number or sign (group 2) in the marker (group 1).
NUMERAL = "".join(DIGITS) + "十"
MARKERS = {
    "circ": r"(([①-⑳]))",
    "paren": rf"([（(]\s*(\d{{1,3}}|[{NUMERAL}]{{1,4}})\s*[）)])",
    "cn": rf"(([{NUMERAL}百]{{1,4}})\s*[、.．）)])",
    "num": r"((\d{1,3})\s*[.．、）),])",
    "alpha": r"(([A-Za-z])\s*[.．、）)])",
    "bullet": rf"(([{BULLETS}]))",
    "dash": rf"(([-*])[{BLANK}]+)",
}


def list_marker(text: Column) -> Column:
    """Struct (family, kind, raw, number) of the list marker at the start of text; null for none.

    family: ol or ul. What follows the marker must be white space, the end, a quote, an opening bracket or a Chinese
    character, so that 1.5 has none; a dash or asterisk takes at least one space of its own.
    """
    plain = ascii_digits(F.coalesce(text, F.lit("")))
    out = None
    for kind, pattern in MARKERS.items():
        whole = rf"^[{BLANK}]*{pattern}[{BLANK}]*(?=[{BLANK}{AFTER_MARKER}]|$)"
        raw, sign = F.regexp_extract(plain, whole, 1), F.regexp_extract(plain, whole, 2)
        number = {
            "circ": F.conv(F.hex(F.encode(sign, "UTF-16BE")), 16, 10).try_cast("int") - 0x245F,
            "alpha": F.ascii(F.lower(sign)) - 96,
            "paren": F.coalesce(sign.try_cast("int"), chinese_number(sign)),
            "cn": chinese_number(sign),
            "num": sign.try_cast("int"),
        }.get(kind, F.lit(None))
        family = "ul" if kind in ("bullet", "dash") else "ol"
        made = F.struct(F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.trim(raw).alias("raw"), number.cast("int").alias("number"))
        out = F.when(raw != "", made) if out is None else out.when(raw != "", made)
    return out


#: A bracketed note number, and one that leads a note's text; leading zeros don't count.
BRACKETED = r"[\[【〔（(]\s*(?:注|註)?\s*0*(\d{1,4})\s*[\]】〕）)]"
LEADING = r"(?:注|註)?\s*0*(\d{1,4})\s*[.．、]"


def note_number(text: Column, whole: bool = False) -> Column:
    """The note number at the start of text, bracketed or followed by a stop; whole: text must be a bracketed number."""
    plain = F.trim(ascii_digits(F.coalesce(text, F.lit(""))))
    found = F.regexp_extract(plain, f"^{BRACKETED}" + ("$" if whole else ""), 1)
    if not whole:
        found = F.when(found != "", found).otherwise(F.regexp_extract(plain, f"^{LEADING}", 1))
    return found.try_cast("int")


def note_mark(text: Column) -> Column:
    """The bracketed mark at the start of text, or empty."""
    return F.regexp_extract(F.trim(ascii_digits(F.coalesce(text, F.lit("")))), f"^({BRACKETED})", 1)


def lenient_int(text: Column) -> Column:
    """An integer with spaces and a sign around it; null where it is none."""
    return F.trim(ascii_digits(text)).try_cast("int")


def indent_em(style: Column) -> Column:
    """The left indent in em of an inline style: left margin or padding, else text-indent; 16 px are an em."""
    low = F.coalesce(style, F.lit(""))

    def of(names: str) -> Column:
        value = F.regexp_extract(low, rf"(?:{names})\s*:\s*([0-9.]+)\s*(em|rem|px)", 1)
        unit = F.regexp_extract(low, rf"(?:{names})\s*:\s*([0-9.]+)\s*(em|rem|px)", 2)
        return F.when(value != "", value.try_cast("double") / F.when(unit == "px", F.lit(16.0)).otherwise(F.lit(1.0)))

    return F.coalesce(of("(?:margin|padding)-left"), of("text-indent"), F.lit(0.0))


def is_external(ref: Column) -> Column:
    """References with a scheme."""
    return F.trim(ref).rlike("(?i)^[a-z][a-z0-9+.-]*:")


def reference_parts(ref: Column) -> tuple[Column, Column]:
    """(file part, fragment) of a reference; a missing part is empty."""
    return F.substring_index(ref, "#", 1), F.when(ref.contains("#"), F.regexp_replace(ref, "^[^#]*#", "")).otherwise(F.lit(""))


def decoded(ref: Column) -> Column:
    """Percent-encoding undone; what isn't valid stays."""
    return F.coalesce(F.try_url_decode(F.replace(ref, F.lit("+"), F.lit("%2B"))), ref)


def folded(path: Column) -> Column:
    """A path without empty, . and .. parts; .. at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def resolve(document: Column, ref: Column) -> Column:
    """The path that a reference's file part names, seen from document; the document itself where it has none."""
    file = reference_parts(ref)[0]
    return F.when(file == "", document).otherwise(folded(F.concat(F.when(file.startswith("/"), F.lit("")).otherwise(folder_of(document)), decoded(file))))


def relative(document: Column, target: Column, fragment: Column) -> Column:
    """The reference from one path of a package to another."""
    a, b = F.filter(F.split(folder_of(document), "/"), lambda p: p != ""), F.split(target, "/")
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b) - 1), F.lit(1))), F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (i <= F.least(F.size(a), F.size(b) - 1)) & (F.try_element_at(a, i) == F.try_element_at(b, i)), i).otherwise(acc),
    )
    way = F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))
    return F.when(document == target, F.concat(F.lit("#"), fragment)).otherwise(F.concat(F.array_join(way, "/"), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit(""))))


def free_suffix(taken: Column, base: Column) -> Column:
    """base, or base-2, base-3, ...: the first that is not among the array taken."""
    tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.when(i == 1, base).otherwise(F.concat(base, F.lit("-"), i.cast("string"))))
    return F.element_at(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1)


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def any_token(text: Column, *names: str) -> Column:
    """Whether text has one of the tokens; it is taken apart only where it holds one's letters."""
    return reduce(lambda a, b: a | b, [F.coalesce(text.contains(n), F.lit(False)) & F.array_contains(tokens(text), n) for n in names])
