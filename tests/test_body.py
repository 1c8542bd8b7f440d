"""Texts of archived bodies: by their marker, or as the best run under three encodings."""

import pytest

from threadloom.functions import body

ARCHIVE = b"\x04\x0bstreamtyped\x81\xe8\x03NSMutableAttributedString\x00NSDictionary\x00"


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        (None, None),
        (b"", None),
        (b"\x02\x05" + "👩‍👧🏾".encode() + b"\x00\x01", "👩‍👧🏾"),  # joined by format characters
        (b"\x01" + "ありがとう、またね".encode() + b"\x07", "ありがとう、またね"),
        (ARCHIVE + "Dobrý den 🙂".encode() + b"\x00NSObject", "Dobrý den 🙂"),
        (ARCHIVE, None),
        (b"\x01NSString\x00__kIMMessagePartAttributeName\x02", None),
        (b"\x01?!...\x00--\x02", None),
        (b"\xff\xfe" + "Добрый вечер, světe".encode("utf-16-le"), "Добрый вечер, světe"),
        (b"\xfe\xff" + "Добрый вечер, světe".encode("utf-16-be"), "Добрый вечер, světe"),
        ("plain words in wide bytes".encode("utf-16-le"), "plain words in wide bytes"),
        ("plain words in wide bytes".encode("utf-16-be"), "plain words in wide bytes"),
        (b"short\x00a longer run of words\x00mid one", "a longer run of words"),
        (b"line one\nline two\tend\x00", "line one\nline two\tend"),
        (b"\xff\xfe\xfd", None),
    ],
)
def test_best_run(raw, text):
    assert body.best_run(raw) == text


def test_nothing_is_cut():
    long = "slovo " * 40_000 + "konec"
    assert body.best_run(b"\x01" + long.encode() + b"\x00") == long


def test_wide_bytes_need_a_sign_of_it():
    # Letters of another script without a mark have no zeros: bytes of a kind that isn't known are not read as text by guess.
    assert not body.may_be("Привет".encode("utf-16-le"), "utf-16-le") and body.may_be(b"\xff\xfe\x1f\x04", "utf-16-le") and not body.may_be(b"", "utf-16-be")


def test_marker_first(spark):
    marked = b"junk that is much longer than the text itself\x00NSString\x01\x94\x84\x01+\x02ok\x86"
    rows = spark.createDataFrame([(1, bytearray(marked)), (2, bytearray(ARCHIVE + b"just a run\x00")), (3, None), (4, bytearray(b"\x00\x01"))], "i int, raw binary")
    assert {r.i: r.t for r in rows.select("i", body.decode_body(rows.raw).alias("t")).collect()} == {1: "ok", 2: "just a run", 3: None, 4: None}
