"""The text in an archived rich-text body: what its string marker points to, else the best run of text under three encodings."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MARKER = b"NSString"


def decode(raw: bytes | None) -> str | None:
    """Typed-stream bodies hold, after the marker, a '+' and the length of the UTF-8 text: one byte, or 0x81 and two, or 0x82
    and four, little-endian. The text is taken whole. Without a defensible reading the result is None."""
    if not raw or (at := raw.find(MARKER)) < 0:
        return None
    at = raw.find(b"+", at + len(MARKER), at + len(MARKER) + 32)
    if at < 0 or at + 2 > len(raw):
        return None
    size, start = raw[at + 1], at + 2
    if size in (0x81, 0x82):
        width = 2 if size == 0x81 else 4
        size, start = int.from_bytes(raw[start : start + width], "little"), start + width
    if size == 0 or start + size > len(raw):
        return None
    try:
        text = raw[start : start + size].decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if sum(c.isprintable() or c in "\n\t￼" for c in text) >= 0.9 * len(text) else None


# Parts of names that archives hold; a run with one of them is no text of a message.
ARCHIVE_NAMES = ("nsattributedstring", "nsmutableattributedstring", "nsmutablestring", "nsstring", "nsdictionary", "nsmutabledictionary", "nsarray", "nsobject", "streamtyped", "__k", "messagepart", "attribute")
# Fixed value: two and more printable characters of Latin scripts.
LATIN_RUN = re.compile(r"[\x20-\x7E\u00A0-\u024F\u1E00-\u1EFF]{2,}")
#: Share of zero bytes in the place of high bytes from which bytes without a mark are taken for UTF-16.
ZERO_SHARE = 0.4


def may_be(data: bytes, encoding: str) -> bool:
    """Bytes may always be UTF-8; UTF-16 where they begin with its mark, or zeros stand where its high bytes would."""
    if encoding == "utf-8":
        return True
    if data[:2] == (codecs.BOM_UTF16_LE if encoding == "utf-16-le" else codecs.BOM_UTF16_BE):
        return True
    high = data[: min(len(data) // 2 * 2, 8192)][1 if encoding == "utf-16-le" else 0 :: 2]
    return bool(high) and high.count(0) >= ZERO_SHARE * len(high)


@cache
def kind(c: str) -> str:
    """word (letter or number), sign (symbols such as emoji), other (what else belongs to text), or gap."""
    category = unicodedata.category(c)
    if category[0] in "LN":
        return "word"
    if category in ("So", "Sk"):
        return "sign"
    return "other" if c in "\n\r\t" or c.isprintable() or category[0] == "M" or category == "Cf" else "gap"


def runs(data: bytes, encoding: str) -> Iterator[str]:
    """Stretches of text in the bytes under an encoding, without blanks around, that hold a letter, number or sign and no name of an archive's."""
    text = data.decode(encoding, errors="ignore")
    stretches = ("".join(g) for gap, g in groupby(text, key=lambda c: kind(c) == "gap") if not gap)
    for run in chain(LATIN_RUN.findall(text), stretches):
        run = run.strip("\ufeff\x00 \t\r\n")
        low = run.lower()
        if any(kind(c) in ("word", "sign") for c in run) and not any(n in low for n in ARCHIVE_NAMES):
            yield run


def best_run(raw: bytes | None) -> str | None:
    """The run with the most letters, numbers and signs, then the longest, then one in UTF-8; None where no run can be defended.
    It is taken whole."""
    best: tuple[tuple[int, int, bool], str] | None = None
    for encoding in ("utf-8", "utf-16-le", "utf-16-be"):
        if not raw or not may_be(raw, encoding):
            continue
        for run in runs(raw, encoding):
            score = (sum(kind(c) in ("word", "sign") for c in run), len(run), encoding == "utf-8")
            if best is None or score > best[0]:
                best = (score, run)
    return best[1] if best else None


def body_text(raw: bytes) -> str | None:
    """What the marker points to, or else the best run."""
    text = decode(raw)
    return text if text is not None else best_run(raw)


@pandas_udf(StringType())
def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda b: body_text(bytes(b)) if b is not None else None)


def decode_body(c: Column) -> Column:
    return _decode(c)
