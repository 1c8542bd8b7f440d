"""Functions of text. All but Unicode normalisation stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Suffixes and types by class of medium.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif", ".tif", ".tiff")
VIDEO_SUFFIXES = (".mov", ".mp4", ".m4v", ".avi", ".mkv", ".webm")
AUDIO_SUFFIXES = (".m4a", ".aac", ".mp3", ".wav", ".caf", ".aiff", ".flac", ".ogg")
DOCUMENT_SUFFIXES = (".pdf", ".txt", ".rtf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")
DOCUMENT_TYPES = ("application/pdf", "text/plain", "text/rtf")

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
URL = r"(?i)(?:https?://|www\.)\S+"
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
_NOT_ASCII = r"[^\x00-\x7F]"


def _normalizer(form: str):
    @pandas_udf(StringType())
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normalize


_nfc, _nfkc = _normalizer("NFC"), _normalizer("NFKC")


def _gated(udf, c: Column) -> Column:
    """Only text with other than ASCII characters has anything to normalise; the others pass as null."""
    return F.coalesce(udf(F.when(c.rlike(_NOT_ASCII), c)), c)


def nfc(c: Column) -> Column:
    return _gated(_nfc, c)


def nfkc(c: Column) -> Column:
    return _gated(_nfkc, c)


def clean_text(c: Column, normalize: bool = True) -> Column:
    """Line ends are \\n, text is NFC, no-break blanks are blanks, control characters go but \\n and \\t, lines have no blanks at their end."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = nfc(t) if normalize else t
    t = F.regexp_replace(F.regexp_replace(t, "\u00a0", " "), r"[\p{Cc}&&[^\n\t]]", "")
    return F.btrim(F.regexp_replace(t, r"(?m)[ \t]+$", ""), F.lit(" \t\n"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def char_count(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def line_count(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)


def emoji_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(EMOJI)), F.lit(0))


def count_of(c: Column, what: str) -> Column:
    """Occurrences of a string, none overlapping."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int"), F.lit(0))


def uppercase_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def has_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def marker_hits(c: Column, markers: tuple[str, ...]) -> Column:
    """The sum over markers of their occurrences in the lower-case text; markers that hold each other count each."""
    low, total = F.lower(c), F.lit(0)
    for m in markers:
        total = total + count_of(low, m.lower())
    return total


def token_text(c: Column, normalize: bool = True) -> Column:
    """The text that tokens are taken of."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return nfkc(low) if normalize else low


def tokens_of(c: Column) -> Column:
    """The tokens of a token_text."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens(c: Column, normalize: bool = True) -> Column:
    return tokens_of(token_text(c, normalize))


def person_name(c: Column, normalize: bool = True) -> Column:
    """For comparing names: normal form, single blanks, lower case; null where nothing is left."""
    t = nfkc(c) if normalize else c
    return F.nullif(F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), F.lit(""))


def excerpt(c: Column, most: int = 240) -> Column:
    """One line of at most so many characters."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…")))


def media_class(mime: Column, filename: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mime, F.lit(""))))
    suffix = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/.](\.[^./]+)$", 1))
    return (
        F.when(m == "image/gif", "gif").when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio")
        .when(m.isin(*DOCUMENT_TYPES), "document").when(suffix == ".gif", "gif").when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video")
        .when(suffix.isin(*AUDIO_SUFFIXES), "audio").when(suffix.isin(*DOCUMENT_SUFFIXES), "document").otherwise("other")
    )


# Words by which a question is routed.
DATA_WORDS = ("kolik", "kdo více", "kdo vic", "počet", "pocet", "průměr", "prumer", "median", "latency", "iniciace", "jak často", "jak casto")
INTERPRETIVE_WORDS = ("proč", "proc", "co znamená", "co znamena", "vzorec", "dynamika", "konflikt", "přibliž", "pribliz", "odtah")
CHANGE_WORDS = ("kdy se změn", "kdy se zmen", "změnila komunikace", "zmenila komunikace", "turning point")


def question_route(c: Column, data=DATA_WORDS, interpretive=INTERPRETIVE_WORDS, change=CHANGE_WORDS) -> Column:
    """COMBINED for questions about change or of both kinds, else DATA or INTERPRETIVE, which is also the default."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))

    def any_of(words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.when(any_of(change), "combined").when(any_of(data) & any_of(interpretive), "combined").when(any_of(data), "data").otherwise("interpretive")


def duration_label(seconds: Column) -> Column:
    """Seconds, minutes, hours or days with one decimal where it is longer than a minute."""
    s = seconds.cast("double")
    return (
        F.when(s.isNull(), "—").when(s < 60, F.format_string("%.0f s", s)).when(s < 3600, F.format_string("%.1f min", s / 60))
        .when(s < 86400, F.format_string("%.1f h", s / 3600)).otherwise(F.format_string("%.1f d", s / 86400))
    )
