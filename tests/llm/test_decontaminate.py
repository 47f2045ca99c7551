import time
from collections import Counter

import regex
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weft.llm import decontaminate
from weft.llm.decontaminate import hits, shingles, stage


def brute(docs, items, k=5, threshold=0.8):
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    runs = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for d, text in docs:
        for i, item in items:
            words = split(item)
            if not words:
                continue
            n = min(k, len(words))
            want, have = runs(words, n), runs(split(text), n)
            size = min(len(want), len(have))
            best = (0, 0)
            for s in range(len(have) - size + 1 if size else 0):
                shared = sum((Counter(have[s : s + size]) & Counter(want)).values())
                best = max(best, (round(shared / (size + len(want) - shared), 6), -s))
            if best[0] >= threshold:
                out[d, i] = (best[0], -best[1])
    return out


def test_against_all_windows(spark, odd, empty):
    item, longer = prose(50, 40), prose(51, 60)
    changed = item.split()
    changed[20] = "other"
    docs = [(1, prose(60, 80) + " " + item.upper() + ", " + prose(61, 50)), (2, prose(62, 30) + " " + " ".join(changed)), (3, " ".join(longer.split()[:55])), (4, prose(63, 300)), (5, "go go go go go go go go go"), (6, "say hello world now"), (7, None), (8, ""), (9, item + " " + item), (None, item)]
    items = [(0, item), (1, longer), (2, "go go go go go go go"), (3, "hello world"), (4, None), (5, "  "), (6, item + "."), (None, "never there at all in any of them")]
    got = hits(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"))
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in got.collect()} == brute(docs, items)


def test_edges(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30))], "item_id long, text string")
    found = {r["doc_id"] for r in hits(odd, benchmark).collect()}
    assert found == {3, 5, 7, 8, None}
    assert hits(empty, benchmark).count() == 0 and hits(odd, benchmark.limit(0)).count() == 0


def test_stage(spark, odd, tmp_path):
    spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = stage(spark, odd, str(tmp_path))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6


def test_scripts_without_spaces(spark):
    """Each character is a word there: an item inside a longer text is found, with a character changed too."""
    item = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(200))
    around = "".join(chr(0x4E00 + (i * 104729 + 5) % 20000) for i in range(300))
    docs = spark.createDataFrame([(1, around + item + around), (2, around + item[:99] + "\u3042" + item[100:]), (3, around)], "doc_id long, text string")
    got = hits(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["start"]) for r in got.collect()) == [(1, 7, 300), (2, 7, 300)]


def test_shuffled_where_nothing_is_broadcast(spark, odd, monkeypatch):
    benchmark = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    rows = lambda: sorted(map(tuple, hits(odd, benchmark).collect()), key=str)
    before = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert rows() == before


def test_long_words_take_time_in_proportion(spark):
    """Words of a megabyte, alone, last and among others; and the shingles stay what they were."""
    base = prose(7, 12)
    docs = spark.createDataFrame([(1, "f" * (1 << 20)), (2, f"{base} {'0a' * (1 << 19)}"), (3, f"{'x' * (1 << 20)} {base} {'y' * (1 << 20)} z"), (4, base)], "doc_id long, text string")
    items = spark.createDataFrame([(1, base), (2, "g" * (1 << 20))], "item_id long, text string")
    began = time.time()
    assert sorted(r["doc_id"] for r in hits(docs, items).collect()) == [2, 3, 4]
    assert time.time() - began < 60
    words = base.split(" ")
    got = docs.where("doc_id = 4").select(shingles(F.lit(base), 5).alias("s")).first()["s"]
    assert got == [" ".join(words[i : i + 5]) for i in range(8)]
