import hashlib
import re
from collections import defaultdict

from weft.llm.exact_dedup import exact_groups, stage


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        first = min(ids, key=lambda x: (x is None, x))
        out += [(i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out, len(groups)


def test_against_plain_python(odd, small):
    for docs in (odd, small):
        want, groups = expected(docs.collect())
        got = exact_groups(docs).collect()
        key = lambda t: tuple((x is None, x) for x in t)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)
        assert len({r["text_sha256"] for r in kept}) == groups


def test_shared_beginnings(spark):
    long = "a" * 5000
    docs = spark.createDataFrame([(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long), (5, "a" * 64), (6, "a" * 64), (7, "b" * 300_000 + "c"), (8, "b" * 300_000 + "d"), (9, "b" * 300_000 + "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_groups(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 7}


def test_stage_and_empty(spark, odd, empty):
    kept = stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == expected(odd.collect())[1]
    assert exact_groups(empty).count() == 0
