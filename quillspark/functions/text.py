"""Text functions as Column expressions; none leaves whole-stage code generation for Python.

Two case foldings exist side by side: `ascii_lower` for document search and
titles ordered without case, `F.lower` (all of Unicode) for everything else.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers trim it. The spelling is valid for Java and for RE2.
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

PREVIEW, RADIUS = 180, 80

#: Device names that can't be file names.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10))]


#: What can't stand in a file name, with its replacement, one after another.
UNSAFE = [(r'[<>:"/\\|?*\x00-\x1f]', "-"), (f"{WS}+", "-"), ("-+", "-"), (r"[. ]+\z", ""), ("^[-. ]+", "")]


def blank_to(c: Column, default: str | Column) -> Column:
    """The default where c is null or empty; spaces count as content."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def normalize(c: Column) -> Column:
    """Without white space at the ends; null gives ''."""
    return F.coalesce(F.regexp_replace(c, rf"^{WS}+|{WS}+\z", ""), F.lit(""))


def search_form(c: Column) -> Column:
    return F.lower(normalize(c))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.coalesce(F.trim(F.regexp_replace(c, f"{WS}+", " ")), F.lit(""))


def wildcard_pattern(query: str) -> str:
    """A pattern that finds the query without case of ASCII letters; % and _ of the query are wildcards.

    It is matched against the text as it is, so no folded copy of a long text is made. The parts between % are found one
    after another, each at its first place behind the one before; as none of them varies in length, no other place could
    do better, so what is found is never given back and a text is gone through once.
    """
    parts = ["".join("." if c == "_" else re.escape(c) for c in part) for part in query.split("%") if part]
    return "(?is)" + (parts[0] if len(parts) == 1 else r"\A" + "".join(f"(?>.*?{part})" for part in parts))


def request(values: dict[str, object]) -> dict[str, str]:
    """What a form sends: values that are strings, trimmed, without the empty ones."""
    found = {name: query_text(value) for name, value in values.items()}
    return {name: value for name, value in found.items() if value}


def query_text(query: object) -> str:
    """The query as searches take it: a string without white space at the ends, anything else ''."""
    return query.strip(_PY_WS) if isinstance(query, str) else ""


#: The same characters for Python.
_PY_WS = "\t\n\v\f\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def preview(clean: Column) -> Column:
    return F.when(F.length(clean) > PREVIEW, F.concat(F.substring(clean, 1, PREVIEW - 3), F.lit("..."))).otherwise(clean)


def snippet(c: Column, query: str = "") -> Column:
    """80 characters on each side of the first hit, or the start of the text without one."""
    return cut(collapse(c), query)


def cut(clean: Column, query: str = "") -> Column:
    """snippet() of text that is collapsed already; best a column, as it is looked at several times."""
    if not query:
        return preview(clean)
    lowered = query.lower()
    at = F.locate(lowered, F.lower(clean)) - 1
    start = F.greatest(F.lit(0), at - RADIUS)
    end = F.least(F.length(clean), at + len(lowered) + RADIUS)
    around = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.trim(F.substring(clean, start + 1, end - start)),
        F.when(end < F.length(clean), "...").otherwise(""),
    )
    return F.when(at < 0, preview(clean)).otherwise(around)


def first_of(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    (condition, value), *rest = pairs
    return reduce(lambda chain, pair: chain.when(*pair), rest, F.when(condition, value)).otherwise(otherwise)


def labelize(c: Column) -> Column:
    """`repair_log` becomes `Repair Log`; empty becomes `Not set`."""
    parts = F.transform(F.split(c, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.when(blank_to(c, "") == "", "Not set").otherwise(F.array_join(parts, " "))


def base_name(path: Column) -> Column:
    """The last part of a path; slashes at the end don't count."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows; a name that only starts with a dot has none."""
    return F.regexp_extract(base_name(path), r"(?s)[^.].*?(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    name, ext = base_name(path), extension(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def title_from_filename(path: Column) -> Column:
    named = blank_to(path, "document")
    return blank_to(collapse(F.regexp_replace(stem(named), "[_-]+", " ")), "Untitled Document")


def safe_filename(path: Column) -> Column:
    """A name that every file system takes, with the extension in lower case.

    The extension comes off only where it is already lower case, so `A.PDF` keeps both.
    """
    named = blank_to(path, "document")
    name, ext = base_name(named), F.lower(extension(named))
    cuts = (ext != "") & F.endswith(name, ext) & (F.length(name) > F.length(ext))
    base = F.when(cuts, F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    for pattern, value in UNSAFE:
        base = F.regexp_replace(base, pattern, value)
    base = blank_to(base, "document")
    base = F.when(F.upper(base).isin(RESERVED_NAMES), F.concat(base, F.lit("-file"))).otherwise(base)
    return F.concat(base, ext)


def stored_filename(path: Column, unique: Column) -> Column:
    """A safe name of its own: the caller's unique part goes between base and extension."""
    safe = safe_filename(path)
    return F.concat(stem(safe), unique, extension(safe))


def mime_type(path: Column) -> Column:
    return F.when(F.lower(extension(path)) == ".pdf", "application/pdf").otherwise("application/octet-stream")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often it stands in it; plans with functions of arrays repeat it."""
    return F.transform(F.array(value), use)[0]


def distinct_values(values: Column) -> Column:
    """Trimmed non-empty values; of those equal without case, the first stands, in its place.

    Sorted by folded value and place, the first of each run of equal ones is kept; so long lists cost no more than their sort.
    """
    trimmed = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize), lambda v: v != "")
    sorted_ = F.array_sort(F.transform(trimmed, lambda v, i: F.struct(F.lower(v).alias("folded"), i.alias("at"), v.alias("value"))))
    # each beside the one before it
    pairs = once(sorted_, lambda s: F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda e: e["folded"])).alias("before")))
    first = F.filter(pairs, lambda p: p["x"].isNotNull() & ~p["x"]["folded"].eqNullSafe(p["before"]))
    return F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["x"]["at"].alias("at"), p["x"]["value"].alias("value")))), lambda e: e["value"])


def parse_list(json: Column, fallback: list[str]) -> Column:
    """A JSON list of strings; the fallback where it is malformed or holds no value. Elements of other types drop out."""
    parsed = F.try_parse_json(blank_to(json, "[]"))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    texts = F.filter(
        F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))),
        lambda v: v.isNotNull(),
    )
    return once(distinct_values(texts), lambda values: F.when(F.size(values) > 0, values).otherwise(F.array(*map(F.lit, fallback))))


def format_list(values: Column) -> Column:
    return F.to_json(values)


def parse_lines(c: Column) -> Column:
    """The lines of a text area as distinct values."""
    return distinct_values(F.split(c, r"\r?\n"))


def format_lines(values: Column) -> Column:
    return F.array_join(values, "\n")


def join_parts(*parts: Column) -> Column:
    """Parts that have content, joined by a space."""
    return F.array_join(F.filter(F.array(*[normalize(p.cast("string")) for p in parts]), lambda v: v != ""), " ")


def display_time(c: Column) -> Column:
    """`Mar 5, 2024, 3:07 PM`; `Not available` for what isn't a time."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c.cast("string")), "MMM d, yyyy, h:mm a"), F.lit("Not available"))


def extraction_class(status: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return first_of(
        [
            (s.isin("", "not_attempted"), F.lit("not_attempted")),
            (s.isin("completed", "no_text_found"), s),
            (F.startswith(s, F.lit("failed")), F.lit("failed")),
        ],
        F.lit("other"),
    )


def enum_value(c: Column, allowed: list[str], default: str, name: str) -> Column:
    """Trimmed and lower-cased; blank gives the default, an unknown value fails the query."""
    v = search_form(c)
    unknown = F.raise_error(F.concat(F.lit(f"unknown {name}: "), v)).cast("string")
    return F.when(v == "", default).when(v.isin(allowed), v).otherwise(unknown)


#: How a text has to look to be a number, in decimals or to another base.
DECIMAL, RADIX = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", {16: "0[xX][0-9a-fA-F]+", 8: "0[oO][0-7]+", 2: "0[bB][01]+"}
#: The largest id; no row has a larger one.
LARGEST = (1 << 63) - 1


def number(value: object) -> float:
    """A value of a request as a number: '' is 0, what isn't a number NaN; floats, so large ones are rounded."""
    if isinstance(value, (bool, int, float)):
        try:
            return float(value)
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")
    if not isinstance(value, str):
        return float("nan")
    text = query_text(value)
    if any(re.fullmatch(p, text) for p in RADIX.values()):
        return number(int(text, 0))
    return float(text or 0) if not text or re.fullmatch(f"{DECIMAL}|[+-]?Infinity", text) else float("nan")


def column_number(c: Column) -> Column:
    """number() of a column; null for what isn't one, for infinities and for the other bases over 2 ** 64."""
    return _number_of(normalize(c.cast("string")))


def _number_of(text: Column) -> Column:
    digits = F.regexp_replace(text, "^0.0*", "")
    fits = lambda base: F.length(digits) <= {16: 16, 8: 21, 2: 64}[base]
    radix = [(F.rlike(text, F.lit(rf"\A{p}\z")), F.when(fits(base), F.conv(digits, base, 10).try_cast("double"))) for base, p in RADIX.items()]
    return first_of([(text == "", F.lit(0.0)), *radix, (F.rlike(text, F.lit(rf"\A(?:{DECIMAL})\z")), text.try_cast("double"))], F.lit(None).cast("double"))


def positive_id(c: Column) -> Column:
    """A whole number over 0 that an id can be, or null."""
    return _id_of(column_number(c))


def _id_of(number: Column) -> Column:
    return F.when((number > 0) & (number == F.floor(number)) & (number < float(LARGEST)), number.cast("long"))


def positive_ids(values: Column) -> Column:
    """Distinct positive whole numbers of a list; others drop out.

    One step after another over the array, as an expression inside a lambda is worked out again wherever it stands.
    """
    texts = F.transform(values, lambda v: normalize(v.cast("string")))
    return F.array_distinct(F.filter(F.transform(F.transform(texts, _number_of), _id_of), lambda v: v.isNotNull()))


def toggle(values: Column, value: Column) -> Column:
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


#: How a status or difficulty is shown; other values take the first.
BADGES = {
    "status": {"": "bg-slate-100 text-slate-700", "resolved": "bg-emerald-100 text-emerald-800", "monitoring": "bg-amber-100 text-amber-800"},
    "difficulty": {"": "bg-emerald-100 text-emerald-800", "advanced": "bg-red-100 text-red-800", "intermediate": "bg-amber-100 text-amber-800"},
}


def badge(kind: str, c: Column) -> Column:
    """The style of a status or a difficulty."""
    return first_of([(c == value, F.lit(style)) for value, style in BADGES[kind].items() if value], F.lit(BADGES[kind][""]))


def entity_link(kind: Column, id_: Column) -> Column:
    """Deep link of an entity; the dashboard for unknown kinds and missing ids."""
    url = F.concat(F.lit("/"), kind, F.lit("s?"), kind, F.lit("Id="), id_.cast("string"), F.lit("#"), kind, F.lit("-library"))
    known = kind.isin("document", "symptom", "procedure", "note") & (F.coalesce(id_, F.lit(0)) != 0)
    return F.when(known, url).otherwise("/dashboard")


def count_sentence(shown: Column, total: Column, noun: str) -> Column:
    """`Showing all 3 symptoms`, `Showing all 1 symptom`, `Showing 2 of 3 symptoms`."""
    number = F.when(shown == total, F.concat(F.lit("all "), total.cast("string"))).otherwise(F.concat(shown.cast("string"), F.lit(" of "), total.cast("string")))
    return F.concat(F.lit("Showing "), number, F.when(total == 1, f" {noun}").otherwise(f" {noun}s"))
