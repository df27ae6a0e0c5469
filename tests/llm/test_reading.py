"""Reading level: held-out samples, prose extraction, edge texts."""

import numpy as np
import pandas as pd
import pytest

from notegraph.llm import reading
from tests.conftest import DATA


@pytest.fixture(scope="module")
def samples():
    return pd.read_parquet(f"{DATA}/reading_samples.parquet").sort_values("sample_id").reset_index(drop=True)


def test_held_out_samples(samples):
    right = 0
    for i in range(len(samples)):
        model = reading.fit(samples.drop(index=i))
        best, score = model.scores(reading.profile([reading.prose(samples.text[i])]))
        level = np.interp(score[0], model.knots, model.levels)
        right += model.languages[best[0]] == samples.lang[i] and reading.BANDS[round(level)] == samples.band[i]
    assert right >= 0.95 * len(samples)


def test_prose_only():
    text = "---\r\nkind: x\r\n---\r\n# Head\r\n\r\nFirst line\r\nsecond line with `code` and [link](http://a.b).\r\n\r\n- item\r\n1. item\r\n| a | b |\r\n```\r\ncode\r\n```\r\n> quoted text &amp; more\r\n\thard tab\r\n    indented\r\nhttps://x.y/z\r\n***\r\nLast."
    assert [" ".join(p.split()) for p in reading.prose(text)] == ["First line second line with and .", "quoted text & more Last."]
    assert reading.prose(None) == [] and reading.prose("") == [] and reading.prose(" \n\t") == []


def test_isotonic():
    knots, levels = reading.isotonic(np.array([3.0, 1, 2, 4]), np.array([1.0, 0, 2, 2]))
    assert knots.tolist() == [1, 1, 2, 3, 4, 4] and levels.tolist() == [0, 0, 1.5, 1.5, 2, 2]


def test_profile_counts():
    p = reading.profile([["Der alte Weg. Ein x1-y Wort"], [], ["日本語 だけ"]])
    assert p.n_words.tolist() == [6, 0, 2] and p.latin_share.tolist() == [1.0, 0.0, 0.0]


def test_levels(spark, samples):
    model = reading.fit(samples)
    long = " ".join(samples[(samples.lang == "en") & (samples.band == "easy")].text) * 30
    rows = [(1, None), (2, ""), (3, "short text"), (4, "Старая метка удалена ночью. " * 40), (5, samples.text[0]), (6, "```\n" + samples.text[0] + "\n```"), (7, long), (7, long)]
    df = spark.createDataFrame([(i, t, "xx", "clash", 1) for i, t in rows], "doc_id int, text string, lang string, band string, j int")
    got = {r.doc_id: r for r in reading.reading_levels(df, model).collect()}
    assert [got[i].band for i in (1, 2, 3, 4, 6)] == [None] * 5 and got[4].language is None
    assert got[5].band == samples.band[0] and got[5].language == samples.lang[0] and got[7].band == "easy"
    assert reading.reading_levels(df.limit(0), model).collect() == []


def test_no_samples():
    with pytest.raises(ValueError):
        reading.fit(pd.DataFrame({"lang": ["en"], "band": ["odd"], "text": ["some words"]}))
