"""Text functions: tokens, accent folding, file stems, wrapping."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.tolerant import col

TOKEN = "[\\p{L}\\p{Nl}\\p{No}]+(?:[’'-][\\p{L}\\p{Nl}\\p{No}]+)*"


def _folding() -> tuple[str, str]:
    """Lower and upper Latin letters whose decomposition is one letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


#: White space of any kind, and its separators alone (Zs).
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
WHITE_SPACE = "\t\n\x0b\f\r\x85\u2028\u2029" + SPACES


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once; a column used inside a fold is otherwise worked out at each of its steps."""
    return F.transform(F.array(value), body)[0]


def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII characters: those with one and theirs, and those with several."""
    single, several = [], {}
    for code in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800)]:
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append((chr(code), plain))
        elif plain:
            several[chr(code)] = plain
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


_ONE_FROM, _ONE_TO, _SEVERAL = _ascii_forms()


def ascii_form(c: Column | str) -> Column:
    """ASCII characters of a text's compatibility decomposition; what has none is dropped."""
    plain = F.translate(col(c), _ONE_FROM, _ONE_TO)
    forms = F.create_map(*[F.lit(x) for kv in _SEVERAL.items() for x in kv])
    # Only texts that still hold such a character look characters up.
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(x.rlike("^[\\x00-\\x7F]"), x).otherwise(F.coalesce(forms[x], F.lit("")))), "")
    return F.when(plain.rlike("[^\\x00-\\x7F]"), spelled).otherwise(plain)


def fold(c: Column | str) -> Column:
    """Accents removed from Latin letters."""
    return F.translate(col(c), _FROM, _TO)


def tokens(c: Column | str) -> Column:
    """Lower-cased letter runs with inner hyphens or apostrophes."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0)))


def safe_stem(c: Column | str, longest: int = 80) -> Column:
    """A file stem of ASCII letters, digits, dots, underscores and hyphens; 'midia' when nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(ascii_form(c), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.left(F.coalesce(F.nullif(slug, F.lit("")), F.lit("midia")), F.lit(longest))


def cut_middle(c: Column | str, width: int) -> Column:
    """Long text with its middle replaced by an ellipsis, since the end of a name often tells files apart."""
    half = (width - 1) // 2
    c = col(c)
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit("…"), F.right(c, F.lit(width - half - 1))))


# Where a word may be broken: after a hyphen between letters, and on either side of a dash of several hyphens.
_LETTER, _PUNCT = "[^\\d\\W]", "[\\w!\"'&.,?]"
HYPHEN_BREAK = (
    f"(?U)(?<={_LETTER}{{2}}-)(?={_LETTER}-?{_LETTER})|(?<={_LETTER}-{_PUNCT}-)(?={_LETTER}-?{_LETTER})|(?<={_PUNCT})(?=-{{2,}}\\w)|(?<={_PUNCT}-{{2,20}})(?=\\w)"
)


def wrap(c: Column | str, width: int | Column, hyphens: bool = False) -> Column:
    """Words of a text as lines of at most ``width`` characters; a longer word has a line of its own.

    White space inside a line stays as wide as it is. With ``hyphens``, words may break after
    a hyphen. A fold over the pieces, whose state is the finished lines and the open one.
    """
    width = F.lit(width) if isinstance(width, int) else width
    items = F.regexp_extract_all(strip(c), F.lit("\\s*\\S+"), F.lit(0))

    def pieces(item: Column) -> Column:
        word = F.ltrim(item, F.lit(" \t\n\x0b\f\r"))
        gap = F.length(item) - F.length(word)
        whole = F.array(F.struct(gap.alias("gap"), word.alias("w")))
        if not hyphens:
            return whole
        # The pattern is compiled for every word that is split, so only those with a hyphen are.
        broken = F.transform(F.split(word, HYPHEN_BREAK), lambda p, i: F.struct(F.when(i == 0, gap).otherwise(0).alias("gap"), p.alias("w")))
        return F.when(F.contains(word, F.lit("-")), broken).otherwise(whole)

    words = F.flatten(F.transform(items, pieces))
    zero = F.struct(F.array().cast("array<string>").alias("d"), F.lit("").alias("c"))

    def step(z: Column, x: Column) -> Column:
        fits = F.length(z.c) + x.gap + F.length(x.w) <= width
        return (
            F.when(z.c == "", F.struct(z.d.alias("d"), x.w.alias("c")))
            .when(fits, F.struct(z.d.alias("d"), F.concat(z.c, F.repeat(F.lit(" "), x.gap), x.w).alias("c")))
            .otherwise(F.struct(F.concat(z.d, F.array(z.c)).alias("d"), x.w.alias("c")))
        )

    return F.aggregate(words, zero, step, lambda z: F.when(z.c == "", z.d).otherwise(F.concat(z.d, F.array(z.c))))


def wrap_at_most(c: Column | str, width: int, lines: int | Column) -> Column:
    """Lines wrapped with breaks at hyphens, what is over ``lines`` joined into the last."""
    lines = F.lit(lines) if isinstance(lines, int) else lines
    w = wrap(c, width, hyphens=True)
    return F.transform(
        F.array(w),
        lambda a: F.when(F.size(a) <= lines, a).otherwise(F.concat(F.slice(a, F.lit(1), lines - 1), F.array(F.array_join(F.slice(a, lines, F.size(a)), " ")))),
    )[0]


def wrap_indented(c: Column | str, width: int = 78, first: str = "", following: str | None = None) -> Column:
    """Wrapped lines with an indent; ``following`` is the indent from the second line on."""
    following = first if following is None else following
    room = width - max(len(first), len(following))
    return F.transform(wrap(c, room), lambda line, i: F.concat(F.when(i == 0, F.lit(first)).otherwise(F.lit(following)), line))


def json_block(raw: Column | str, schema: str) -> Column:
    """A JSON object, even with talk before or after it: the text itself, else from the first { to the last }."""
    raw = col(raw)
    whole = lambda x: F.when(F.startswith(strip(x), F.lit("{")) & F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))
    return F.coalesce(whole(raw), whole(F.regexp_extract(raw, "(?s)\\{.*\\}", 0)))


def clean_list(c: Column | str, limit: int = 12) -> Column:
    """Trimmed items without blanks, ``limit`` at most."""
    return F.slice(F.filter(F.transform(col(c), strip), lambda x: x != ""), 1, limit)
