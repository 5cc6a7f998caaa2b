"""The codes of a run come from one pass over the entries, and decoding takes no step for each bit."""

import pytest

from readloom.functions.huffman import ESCAPE, decode, encode, scheme
from readloom.operators.quality_values import quality_schemes


def test_schemes_are_those_of_the_counts(spark):
    rows = [("!!%!", "\"#$%", "+0++", "5655"), ("", "", "", ""), (None, None, None, None), ("%", "#", "0", "6")]
    entries = spark.createDataFrame(rows, "del string, ins string, mrg string, sub string")
    assert quality_schemes(entries, "!") == {
        "del": scheme({33: 1, 37: 2}), "ins": scheme({34: 1, 35: 2, 36: 1, 37: 1, 33: 1}), "mrg": scheme({43: 3, 48: 2, 33: 1}),
        "sub": scheme({53: 3, 54: 2, 33: 1}), "runs": scheme({2: 1, 1: 1, 0: 1, 255: 1}),
    }
    assert quality_schemes(entries, "!", lossy=True)["ins"] == scheme({34: 3, 36: 2, 33: 1})


def test_short_data_is_an_error():
    codes = {1: "0", 2: "10", ESCAPE: "11"}
    assert decode(encode([2, 7, 1, 200], codes), 4, codes) == [2, 7, 1, 200]
    with pytest.raises(ValueError):
        decode(b"\x00", 9, codes)
