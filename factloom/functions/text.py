"""String expressions of the evidence rules.  All are JVM-side and safe on nulls."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import vocab


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(column(x).cast("string"), F.lit(""))


#: All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(column(x), F.lit(WHITE))


def blank(x: Column | str) -> Column:
    """Whether there is nothing but white space of any kind."""
    return ~column(x).rlike(f"[^{WHITE}]")


def words(x: Column | str, longer_than: int = 0) -> Column:
    """Split at single blanks, for which no pattern is compiled for each row; other white space becomes one where there is any."""
    plain = F.when(column(x).rlike(r"(?U)[\s&&[^ ]]"), F.regexp_replace(column(x), r"(?U)\s", " ")).otherwise(column(x))
    return F.filter(F.split(plain, " "), lambda w: F.length(w) > longer_than)


def _branches(parts: list[str]) -> str:
    """An alternation that branches at a character once for all parts that share what is before it."""
    rests: dict[str, list[str]] = {}
    for p in parts:
        rests.setdefault(p[0], []).append(p[1:])
    each = [re.escape(c) + ("" if "" in rest else _branches(rest)) for c, rest in sorted(rests.items())]
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


def any_of(parts: list[str]) -> str:
    """A pattern that finds any of the parts.  What holds another part is left out, and the first characters, up to three, are looked
    at as sets before any branch is tried: most places of a text are passed there."""
    least = [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]
    if "" in least:
        return ""
    ahead = "".join(f"[{''.join(sorted({re.escape(p[i]) for p in least}))}]" for i in range(min(3, *map(len, least), 3)))
    return f"(?={ahead}){_branches(least)}"


def contains_any(x: Column | str, parts: list[str]) -> Column:
    """One pass of an alternation, not one search for each part."""
    return column(x).rlike(any_of(parts))


def any_word_in(words_: Column, text_: Column) -> Column:
    return F.exists(words_, lambda w: F.contains(text_, w))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def surface(x: Column | str) -> Column:
    """The lookup form of a term: lower case, straight quotes, only letters, digits and quotes, single spaces."""
    plain = F.regexp_replace(F.lower(strip(text(x))), "[‘’]", "'")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^a-z0-9'\s]", " "), r"(?U)\s+", " "))


def section_name(x: Column | str) -> Column:
    """Canonical name of a heading, or the heading itself without surrounding space."""
    raw = column(x)
    aliases = {a: name for name, all_ in vocab.SECTION_ALIASES.items() for a in all_}
    return lookup(F.regexp_replace(F.lower(raw), "^[ :]+|[ :]+$", ""), aliases, strip(raw))


def eligible(name: Column | str, body: Column | str) -> Column:
    """Sections worth extracting from: not one of the skipped names, and long enough."""
    return ~F.lower(text(name)).isin(vocab.SKIPPED_SECTIONS) & (F.length(strip(text(body))) >= vocab.MIN_SECTION_CHARS)


def truncated(body: Column | str) -> Column:
    return F.substring(column(body), 1, vocab.MAX_SECTION_CHARS)


def paper_id(source: Column | str, ignore_case: bool = True) -> Column:
    """12 digits of the MD5 of a URL, else the file's stem."""
    s = column(source)
    url = F.lower(s).rlike("^https?://") if ignore_case else F.startswith(s, F.lit("http"))
    return F.when(url, F.substring(F.md5(s), 1, 12)).otherwise(F.regexp_extract(s, r"([^/\\]+?)(\.[^./\\]*)?$", 1))


def listed(x: Column | str) -> Column:
    """An array without null and empty items; null as the empty array."""
    return F.filter(F.coalesce(column(x), F.array().cast("array<string>")), lambda i: i.isNotNull() & (i != ""))


def contains_term(span: Column | str, term: Column | str, whole_words: bool = False) -> Column:
    """Whether a term occurs in a text, whatever the case; between word boundaries if asked for."""
    s, t = F.lower(text(span)), F.lower(text(term))
    filled = (s != "") & (t != "")
    if not whole_words:
        return filled & F.contains(s, t)
    plain = F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    return filled & F.rlike(s, F.concat(F.lit(r"(?U)\b"), plain, F.lit(r"\b")))


def readable_size(size: Column | str) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal; a half goes to the even one."""
    b = column(size).cast("double")
    one = lambda unit, x: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    steps = list(enumerate(["B", "KB", "MB", "GB"]))
    last = one("TB", b / 1024**4)
    return reduce(lambda rest, step: F.when(b < 1024 ** (step[0] + 1), one(step[1], b / 1024 ** step[0])).otherwise(rest), reversed(steps), last)
