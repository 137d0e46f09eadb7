"""Letters by code point: no text of other characters has a language."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmat.llm import language_id
from gridmat.llm.common import text_buffers

#: One text without letters for each script or lead byte that may hold such characters.
NONE = ["٣٤٥", "؟،؛", "۱۲۳", "१२३ ।॥", "০১২", "௧௨", "๑๒๓ ๏", "༡༢", "́̈", "", "\U000f0000", "\U00100000", "˅", "։", "׳", "႑", "፩", "᠐", "𝟘𝟙", "×÷", "“”…", "、。", "😀"]


def _words(text):
    data, edges = text_buffers(pa.array([text]))
    return [bytes(data[a:b]).decode() for a, b in zip(*language_id.letter_words(data, edges))]


@pytest.mark.parametrize("text", NONE)
def test_no_letters_no_words(text):
    assert not any(c.isalpha() for c in text)
    assert _words(text) == []


def test_words_are_runs_of_letters():
    rng = np.random.default_rng(6)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for top in (0x250, 0x1000, 0x3100, 0x110000):
        text = "".join(chr(points[i]) for i in rng.integers(0, min(top, len(points)), 3000))
        runs = re.split("(?:" + "|".join(map(re.escape, {c for c in text if not c.isalpha()})) + ")+", text)
        assert _words(text) == [r for r in runs if r]


def test_texts_without_letters_are_und(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(NONE)], docs.schema)
    got = language_id.predict(docs.unionByName(more)).where(F.col("doc_id") >= 10**6).collect()
    assert len(got) == len(NONE) and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
