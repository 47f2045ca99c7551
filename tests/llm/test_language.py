import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from weft.llm.language import Labeller, Model, fit, held_out, identify, query, stage, viterbi

SF = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k, sizes = int(rng.integers(1, 4)), rng.integers(0, 7, 5)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.integers(-9, 1, (edges[-1], k)).astype(np.float32)
        labels = viterbi(scores, edges, 3.0, segment=3)
        for a, b in zip(edges, edges[1:], strict=False):
            value = lambda path, a=a: sum(scores[a + i, x] for i, x in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            if b > a:
                assert value(labels[a:b]) == max(map(value, product(range(k), repeat=b - a)))


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF}/documents.parquet").where(~held_out()))


def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.98


def test_spans_of_mixed_text(spark, model):
    rows = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600 AND length(text) < 3000 AND text NOT LIKE '%#%'").orderBy("doc_id").collect()}
    parts = [rows["en"], rows["de"], rows["en"]]
    _, _, spans = Labeller(model).label(pa.array([" ".join(parts)]))
    assert [s["lang"] for s in spans.to_pylist()[0]] == ["en", "de", "en"]


def test_scripts_narrow():
    model = Model.fit(["мир дом кот " * 9, "the cat sat " * 9], ["ru", "en"])
    names, scores, _ = Labeller(model).label(pa.array(["zzz кот", "qqq", "кот", "日本"]))
    assert names.to_pylist()[1:3] == ["en", "ru"] and scores.to_pylist()[1:3] == [1.0, 1.0] and names.to_pylist()[3] in ("en", "ru")


def test_edges(spark, odd, empty, model):
    got = identify(odd, model).collect()
    assert len(got) == odd.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {9, 10, 11, 16, None}
    assert identify(empty, model).count() == 0
    assert fit(empty).languages == [] and {r["lang_pred"] for r in identify(odd, fit(empty)).collect()} == {"und"}
    kept = stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6


def test_fit_is_bounded(spark):
    """Of a dirty column the most frequent languages are learned; very long texts are taken less often, and whole."""
    rows = [(i, f"word{i} here", f"x{i}") for i in range(50)] + [(100 + i, "the cat sat on a mat " * 50, "en") for i in range(40)] + [(200 + i, "der hund liegt im haus " * 50, "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(fit(docs, languages=2).languages) == ["de", "en"]
    assert len(fit(docs).languages) == 52
    assert fit(docs, languages=2, most=0).languages == []
