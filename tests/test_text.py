"""Text rules against Python's re (the reference's engine)."""
import re

from pyspark.sql import functions as F

from textstrata.functions.text import MULTI_INTERVAL_PATTERN, normalise
from textstrata.operators import clean

INTERVALS = [
    ("van 10 tot 20 m zand van 20 tot 30 m klei", True),
    ("0,5 - 1,2 m fijn zand", True),
    ("KERNSTROOK 12 3.0 m - 4,5m klei", True),
    ("Kern 1.0-2.0 m", True),
    ("VAN 1 TOT 2 a van b tot c", True),
    ("10 tot 12m klei", True),
    ("grijs zand", False),
    ("zand 0,5 - 1,2 m", False),
    ("van 1 tot 2 klei", False),
    ("x\nvan 1 tot 2", False),
    ("0.10-0.40  m", False),
]

NORMALISE = [
    "Grijs kleiig zand, zeer fijn, met enkele grindjes!",
    "Éléphant à côté — déjà vu?",
    "½ ² ³ ① Ⅳ _ under_score",
    "café combining acute",
    "zero‍width joiner",
    "no break space",
    "漢字 and 123",
    "tabs\tand\nlines\x1c\x1d\x1e\x1fseparators",
    "Straße ÄÖÜ",
]


def test_multi_interval_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(INTERVALS)], "id int, text string")
    kept = {r["id"] for r in clean.drop_multi_interval(df, "text").collect()}
    for i, (text, expected_drop) in enumerate(INTERVALS):
        python_drop = re.match(MULTI_INTERVAL_PATTERN, text, re.IGNORECASE) is not None
        assert python_drop == expected_drop, text
        assert (i not in kept) == expected_drop, text


def test_multi_interval_keeps_null(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert clean.drop_multi_interval(df, "text").count() == 1


def test_normalise_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NORMALISE)], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", normalise("text").alias("n")).collect()}
    for i, text in enumerate(NORMALISE):
        assert got[i] == re.sub(r"[^\w\s]", "", text.lower()), text


def test_detect_language_rule(spark):
    rows = [(1, "le chat et la souris dans une maison"), (2, "the cat and the mouse"),
            (3, "xyz qqq"), (4, "le the")]  # 4: tie -> undetected
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["d"] for r in df.select("id", clean.detect_language("text").alias("d")).collect()}
    assert got == {1: "fr", 2: "en", 3: None, 4: None}
    kept = {r["id"] for r in clean.drop_language(df, "fr", text_col="text").collect()}
    assert kept == {2, 3, 4}


def test_prepare_fills_and_casts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "t", 3)], "row_id int, text string, target int")
    out = {r["row_id"]: r for r in clean.prepare(df, ["row_id", "text"], ["target"]).collect()}
    assert out[1]["text"] == "none" and out[1]["target"] == "none"
    assert out[2]["target"] == "3"


def test_text_hook_python_and_column(spark):
    df = spark.createDataFrame([(1, "AbC"), (2, None)], "id int, text string")
    py = {r["id"]: r["text"] for r in clean.apply_text_hook(df, "text", lambda s: s.upper() + "!").collect()}
    assert py == {1: "ABC!", 2: None}
    col = {r["id"]: r["text"] for r in clean.apply_text_hook(df, "text", F.lower, on_column=True).collect()}
    plus = {r["id"]: r["text"] for r in clean.apply_text_hook(df, "text", lambda s: s + "!").collect()}
    assert plus == {1: "AbC!", 2: None}
    assert col == {1: "abc", 2: None}
