"""Times, sizes and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.text import let
from reelspan.functions.tolerant import col

# Words of the reports' language.
UNKNOWN, NONE_MARK, DASH = "desconhecida", "—", "-"
SIZE_UNITS = ("KB", "MB", "GB", "TB", "PB")


def timestamp_ms(ms: Column | str, always_hours: bool = True) -> Column:
    """HH:MM:SS.mmm of milliseconds; below zero counts as zero, null as '--:--:--.---'."""
    x = F.greatest(F.lit(0).cast("bigint"), col(ms).cast("bigint"))
    part = lambda unit, wrap=None: (F.floor(x / unit) % wrap if wrap else F.floor(x / unit)).cast("bigint")
    h, m, s, r = part(3_600_000), part(60_000, 60), part(1000, 60), x % 1000
    long = F.format_string("%02d:%02d:%02d.%03d", h, m, s, r)
    short = F.format_string("%02d:%02d.%03d", m, s, r)
    return F.when(col(ms).isNull(), F.lit("--:--:--.---")).otherwise(long if always_hours else F.when(h == 0, short).otherwise(long))


def srt_time(ms: Column | str) -> Column:
    return F.replace(timestamp_ms(ms), F.lit("."), F.lit(","))


def fixed(c: Column, decimals: int) -> Column:
    """A number with so many decimals, half of the last one to even.

    The binary value decides, as in printf: 96.55 is just under 96.55 and gives 96.5. Its fraction is taken in
    units of 2^-bits, so all is done in whole numbers; from 10^12 on, Spark's own rounding serves.
    """
    ten = 10**decimals
    bits = 61 - (ten - 1).bit_length()

    def digits(v: Column) -> Column:
        # The fraction of a double scaled by a power of two is exact.
        units = F.floor(v.part).cast("bigint") * ten
        kept = F.shiftright(units, bits)
        rest, half = units - F.shiftleft(kept, bits), F.lit(1 << (bits - 1))
        up = (rest > half) | ((rest == half) & ((v.part > F.floor(v.part)) | ((v.whole * ten + kept) % 2 == 1)))
        return let(v.whole * ten + kept + F.when(up, 1).otherwise(0), lambda n: F.concat(v.sign, *_digits(n, ten, decimals)))

    def split(x: Column) -> Column:
        whole = F.floor(F.abs(x)).cast("bigint")
        parts = F.struct(F.when(x < 0, "-").otherwise("").alias("sign"), whole.alias("whole"), ((F.abs(x) - whole) * float(1 << bits)).alias("part"))
        return F.when(F.abs(x) < 1e12, let(parts, digits)).otherwise(F.format_string(f"%.{decimals}f", F.bround(x, decimals)))

    return let(c.cast("double"), split)


def _digits(n: Column, ten: int, decimals: int) -> list[Column]:
    if not decimals:
        return [n.cast("string")]
    return [((n - n % ten) / ten).cast("bigint").cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), decimals, "0")]


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(","))


def duration_human(seconds: Column | str) -> Column:
    """'45,2 s', '3min 02s' or '1h 02min 03s'."""
    s = col(seconds).cast("double")
    whole = F.floor(s).cast("bigint")
    h, m, r = F.floor(whole / 3600).cast("bigint"), (F.floor(whole / 60) % 60).cast("bigint"), whole % 60
    return (
        F.when(s.isNull(), F.lit(UNKNOWN))
        .when(s < 60, F.concat(decimal_comma(fixed(s, 1)), F.lit(" s")))
        .when(h > 0, F.format_string("%dh %02dmin %02ds", h, m, r))
        .otherwise(F.format_string("%dmin %02ds", m, r))
    )


def clock(seconds: Column | str) -> Column:
    """'h:mm:ss' or 'm:ss', half seconds to even; '-' for null."""
    t = F.bround(col(seconds).cast("double")).cast("bigint")
    h, m, r = F.floor(t / 3600).cast("bigint"), (F.floor(t / 60) % 60).cast("bigint"), t % 60
    return F.when(t.isNull(), F.lit(DASH)).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clock_padded(seconds: Column | str) -> Column:
    """'hh:mm:ss', half seconds to even; null for null."""
    t = F.bround(col(seconds).cast("double")).cast("bigint")
    return F.when(t.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("bigint"), (F.floor(t / 60) % 60).cast("bigint"), t % 60))


def duration_words(seconds: Column | str) -> Column:
    """'40 s' (1 at least), '2 min', '1 h' or '1 h 20 min'; a dash for null."""
    t = F.bround(col(seconds).cast("double")).cast("bigint")
    h, m = F.floor(t / 3600).cast("bigint"), (F.floor(t / 60) % 60).cast("bigint")
    return (
        F.when(t.isNull(), F.lit(NONE_MARK))
        .when(t < 60, F.format_string("%d s", F.greatest(F.lit(1).cast("bigint"), t)))
        .when(h == 0, F.format_string("%d min", m))
        .when(m == 0, F.format_string("%d h", h))
        .otherwise(F.format_string("%d h %d min", h, m))
    )


def when_text(iso: Column | str) -> Column:
    """'dd/mm HH:MM' of an ISO time; '-' for anything else."""
    return F.coalesce(F.date_format(F.try_to_timestamp(col(iso)), "dd/MM HH:mm"), F.lit(DASH))


def iso_from_epoch(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(col(epoch))), "yyyy-MM-dd'T'HH:mm:ssXXX")


def human_size(size: Column | str, decimals: int = 2) -> Column:
    """Size in units of 1024 with a decimal comma; plain bytes below 1024."""
    b = col(size).cast("double")
    out = F.when(b < 1024, F.format_string("%d B", col(size).cast("bigint")))
    for k, unit in enumerate(SIZE_UNITS, 1):
        text = F.concat(decimal_comma(fixed(b / float(1024**k), decimals)), F.lit(f" {unit}"))
        out = out.when(b < float(1024 ** (k + 1)), text) if unit != SIZE_UNITS[-1] else out.otherwise(text)
    return F.when(b.isNull(), F.lit(None)).otherwise(out)


def float_text(c: Column | str, suffix: str = "", decimals: int = 2) -> Column:
    c = col(c).cast("double")
    return F.when(c.isNull(), F.lit(NONE_MARK)).otherwise(F.concat(decimal_comma(fixed(c, decimals)), F.lit(suffix)))


def thousands(c: Column | str) -> Column:
    """Whole number with dots between thousands."""
    return F.replace(F.format_number(col(c), 0), F.lit(","), F.lit("."))


def bitrate(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(NONE_MARK)).otherwise(
        F.concat(thousands(c), F.lit(" bps ("), fixed(c / 1000.0, 0), F.lit(" kbps)"))
    )


def key_value(label: str, value: Column | str, indent: str = "") -> Column:
    """'label           : value', with a dash for empty values."""
    v = col(value).cast("string")
    return F.concat(F.lit(f"{indent}{label:<16}: "), F.coalesce(F.nullif(v, F.lit("")), F.lit(NONE_MARK)))


def download_label(status: Column | str, done: Column | str, total: Column | str) -> Column:
    """'status — 1,4 / 9,0 GB (16%)', or the status alone while sizes are unknown."""
    giga = float(1024**3)
    done, total = col(done), col(total)
    known = done.isNotNull() & (total > 0)
    text = F.concat(col(status), F.lit(" — "), decimal_comma(fixed(done / giga, 1)), F.lit(" / "), decimal_comma(fixed(total / giga, 1)), F.lit(" GB ("), fixed(done / total * 100, 0), F.lit("%)"))
    return F.when(known, text).otherwise(F.coalesce(F.nullif(col(status), F.lit("")), F.lit("baixando")))


# How container tags are shown.
TAG_NAMES = {
    "location": "GPS (location)",
    "com.apple.quicktime.location.ISO6709": "GPS (ISO-6709)",
    "com.apple.quicktime.make": "device_make",
    "com.apple.quicktime.model": "device_model",
    "com.apple.quicktime.creationdate": "creation_date",
}


def tag_name(key: Column | str) -> Column:
    """Name under which a container tag is shown."""
    key = col(key)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TAG_NAMES.items() for x in kv])[key], key)
