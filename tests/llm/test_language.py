"""Language identification: codewords, whole-text counts, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from panelcast.llm import language
from panelcast.llm.queries import QUERIES


def test_codewords_lie_half_a_matrix_apart():
    assert language.code_table(0).shape == (0, 0) and language.code_table(1).shape == (1, 0)
    for n in (2, 3, 4, 7, 20, 100):
        table = language.code_table(n)
        order = 1 << n.bit_length()
        assert len(table) == n and set(np.unique(table)) == {-1, 1} and (table.min(axis=0) < table.max(axis=0)).all()
        assert {int((a != b).sum()) for i, a in enumerate(table) for b in table[:i]} == {order // 2}


def test_grams_of_the_whole_text_whatever_the_block(monkeypatch):
    text = "Über den Fluß, 42 Mal! " * 90
    whole = language.gram_counts(text)
    raw = (" " + " ".join(["über den fluß mal"] * 90) + " ").encode()
    assert whole.sum() == sum(len(raw) - n + 1 for n in language.LENGTHS)
    for block in (1, 5, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert (language.gram_counts(text) == whole).all()
    assert language.gram_counts("").sum() == language.gram_counts(" ").sum()


def test_trusted_bits_outvote_a_wrong_one():
    decoder = language.Decoder(["a", "b", "c", "d"], np.zeros((language.FEATURES, 7)), np.zeros(7), np.full((4, 7), 1 / 7), 4.0)
    for i, word in enumerate(decoder.code):
        for wrong in range(7):  # distance 4 mends any one wrong bit
            margins = word.copy()
            margins[wrong] *= -1
            assert decoder.losses(margins).argmin() == i


def test_held_out_accuracy(spark):
    got = QUERIES["op12_language"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]].merge(docs.drop_duplicates("doc_id"), on="doc_id")
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() >= 0.99
    assert (held[~held["ambiguous"]]["lang"] == held[~held["ambiguous"]]["lang_pred"]).mean() >= 0.995


ROWS = "doc_id long, text string, lang string, score double, gap string"  # with clashing names


@pytest.fixture(scope="module")
def rows():
    en, de = "the house and the garden of this man with that dog", "das Haus und der Garten von dem Mann mit diesem Hund"
    out = [(i, (en, de)[i % 2] + f" {i}", ("en", "de")[i % 2], 1.0, "g") for i in range(40)]
    out += [(50, None, "en", None, None), (51, "", "de", None, None), (52, "123 !? ²", "en", None, None), (53, en, None, None, None),
            (None, de, "de", None, None), (54, de * 40_000, "de", None, None), (53, en, None, None, None)]
    return out


def test_odd_rows(spark, rows):
    got = [r.asDict() for r in language.identify(spark.createDataFrame(rows, ROWS)).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"], by[i]["ambiguous"]) for i in (50, 51, 52)] == [("und", 0.0, True)] * 3
    assert by[53]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[54]["lang_pred"] == "de" and not by[None]["held_out"]
    assert sum(r["doc_id"] == 53 and r["score"] == by[53]["score"] for r in got) == 2


def test_a_held_out_label_teaches_nothing(spark, rows):
    held = next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 4 == 2)
    more = rows + [(held, "ceci est une autre langue", "fr", None, None)]
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(more, ROWS)).collect()} == {"en", "de", "und"}


def test_one_none_and_no_rows(spark, rows):
    one = spark.createDataFrame([r for r in rows if r[2] == "en"], ROWS)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(one).collect()} == {("en", 1.0), ("und", 0.0)}
    none = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], ROWS)
    assert {r["lang_pred"] for r in language.identify(none).collect()} == {"und"}
    assert language.identify(one.limit(0)).collect() == []
