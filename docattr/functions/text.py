"""String expressions. Every function is ``Column -> Column`` on Spark built-ins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def last_segment(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, sep), -1)


def strip_bucket(path: Column) -> Column:
    """Drop a trailing alphabet bucket such as ``->A-C`` from a ``->`` path."""
    return F.trim(F.regexp_replace(path, r"(^|(->))[#A-Z]-[A-Z]$", ""))


def squeeze(text: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letter of their canonical decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if ord(base) < 128 and base.isalpha():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()

# Letters and punctuation without a canonical decomposition.
FOLD_SPECIAL = [
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"),
    ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("þ", "th"), ("Þ", "Th"), ("ð", "d"), ("ı", "i"),
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."),
    ("¿", "?"), ("¡", "!"),
]


def ascii_fold(text: Column) -> Column:
    """Closest ASCII spelling; anything left outside ASCII is removed."""
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    for char, plain in FOLD_SPECIAL:
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def leaf_name(path: Column) -> Column:
    """Last path element, or the one before it when the last is an alphabet bucket."""
    bucket = F.element_at(path, -1).rlike(r"^[#A-Z]-[A-Z]$") & (F.size(path) > 1)
    return F.when(bucket, F.get(path, F.size(path) - 2)).otherwise(F.element_at(path, -1))


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace placeholders one after the other; later ones also see earlier values."""
    out = F.lit(template) if isinstance(template, str) else template
    for placeholder, value in values.items():
        out = F.replace(out, F.lit(placeholder), value)
    return out


def padded_id(prefix: str, number: Column, width: Column | int) -> Column:
    digits = number.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.lit(prefix), F.lpad(digits, width.cast("int"), F.lit("0")))


def id_width(count: Column) -> Column:
    """Digits of the count: floor(log10(n)) + 1."""
    return F.length(count.cast("string"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def human_list(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.get(names, F.lit(0))).otherwise(
        F.concat(head, F.lit(" and "), F.element_at(names, -1))
    )


def clean_name(name: Column) -> Column:
    """Name without parenthesised parts, or null when it is not a plausible name."""
    plain = F.trim(F.regexp_replace(name, r"\([^)]*\)", ""))
    ok = plain.rlike(r"^[a-zA-Z0-9\s.\-']+$") & (F.regexp_count(plain, F.lit(r"[.\-']")) <= 2)
    return F.when(ok, plain)


# Courtesy and rank words read as a title at the start of a name.
TITLES = [
    "mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord", "king", "queen", "prince", "princess",
    "captain", "colonel", "general", "major", "sergeant", "professor", "agent", "officer",
    "detective", "father", "sister", "uncle", "aunt", "judge", "senator", "president",
]


def name_parts(name: Column) -> Column:
    """struct(title, first, middle, last) of a blank-separated personal name."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    titled = (F.size(words) > 1) & F.regexp_replace(F.lower(F.get(words, F.lit(0))), r"\.$", "").isin(TITLES)
    rest = F.when(titled, F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    n = F.size(rest)
    # a titled single word is a family name, an untitled one a given name
    first = F.when(titled & (n == 1), F.lit("")).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.lit("")))
    last = F.when(n > 1, F.element_at(rest, -1)).when(titled & (n == 1), F.get(rest, F.lit(0))).otherwise("")
    middle = F.when(n > 2, F.array_join(F.slice(rest, 2, F.greatest(n - 2, F.lit(0))), " ")).otherwise("")
    title = F.when(titled, F.get(words, F.lit(0))).otherwise("")
    return F.struct(title.alias("title"), first.alias("first"), middle.alias("middle"), last.alias("last"))


def aliases(name: Column) -> Column:
    """Sorted distinct spellings of a name: whole, part combinations, each also upper-cased."""
    p = name_parts(name)

    def join(*parts: Column) -> Column:
        every = parts[0] != ""
        for part in parts[1:]:
            every = every & (part != "")
        return F.when(every, F.initcap(F.concat_ws(" ", *parts)))

    forms = F.array(
        F.initcap(F.array_join(F.filter(F.split(name, r"\s+"), lambda w: w != ""), " ")),
        join(p["first"], p["last"]),
        join(p["title"], p["first"]),
        join(p["title"], p["last"]),
        join(p["first"]),
        join(p["last"]),
        name,
    )
    forms = F.filter(forms, lambda f: f.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(forms, F.transform(forms, lambda f: F.upper(f)))))


def letter_index(answer: Column) -> Column:
    """``(a)`` -> 0, ``(b)`` -> 1 ..."""
    return F.ascii(F.substring(answer, 2, 1)) - F.lit(97)


def normalized_list(items: Column) -> Column:
    return F.transform(items, lambda x: F.lower(F.trim(x)))


def html_link(url: Column, label: Column, italic: bool = False) -> Column:
    inner = F.concat(F.lit("<i>"), label, F.lit("</i>")) if italic else label
    anchor = F.concat(F.lit('<a href="'), url, F.lit('" target="_blank">'), inner, F.lit("</a>"))
    return F.when(url.isNotNull() & (url != ""), anchor).otherwise(inner)


def pad_columns(items: Column, names: list[str], default: str = "") -> list[Column]:
    """List -> one column per name, missing entries filled."""
    return [F.coalesce(F.get(items, F.lit(i)), F.lit(default)).alias(n) for i, n in enumerate(names)]


def regex_quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
