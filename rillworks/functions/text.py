"""Text expressions. All are plain columns, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB, SPACES = "\t", " " * 8
#: ANSI colour codes.
COLOURS = {"red": 91, "green": 92, "yellow": 93, "light_purple": 94, "purple": 95, "cyan": 96, "light_gray": 97}


def message_id(link: Column) -> Column:
    """MD5, in hexadecimal, of the UTF-8 link."""
    return F.md5(link)


def cache_key(url: Column) -> Column:
    return F.concat(F.lit("analysis:"), F.sha2(url, 256))


def form_encoded(url: Column) -> Column:
    """As in form bodies: a blank is +, ``~`` stays and ``*`` does not."""
    return F.replace(F.replace(F.url_encode(url), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def iso_time(ts: Column) -> Column:
    """ISO 8601 without zone; the fraction has six digits, or is left out when zero."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def human_bytes(n: Column) -> Column:
    """1024 is still bytes: a unit begins above its size. Two digits, ties to even, as binary fractions are."""
    scaled = lambda power, unit: F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1024**power)), 2))
    return F.when(n > 1024**3, scaled(3, "GB")).when(n > 1024**2, scaled(2, "MB")).when(n > 1024, scaled(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def per_line(text: Column, change) -> Column:
    """change (Column -> Column) on each line. What follows a final line feed is no line; an empty text has none."""
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.left(text, F.char_length(text) - 1)).otherwise(text)
    done = F.array_join(F.transform(F.split(body, "\n"), change), "\n")
    return F.when(text == "", text).otherwise(F.concat(done, F.when(ended, "\n").otherwise("")))


def indented(text: Column, by: str = TAB) -> Column:
    return per_line(text, lambda line: F.concat(F.lit(by), line))


def coloured(text: Column, colour: str) -> Column:
    return F.concat(F.lit(f"\x1b[{COLOURS[colour]}m"), text, F.lit("\x1b[00m"))


def ipv4(text: Column) -> Column:
    """All IPv4 addresses in dotted form, in order, as they stand; numbers are not checked to be under 256."""
    return F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), F.lit(1))


def stream_list(text: Column) -> Column:
    """Split at a comma and a blank, nothing else: ``a,b`` is one name."""
    return F.split(text, ", ")
