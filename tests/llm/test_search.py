import math
import re
from collections import Counter

import pytest

from weft.llm import common, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(search.UPPER, search.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, best):
    """(item, rank, id, score) by loops over all pairs; docs and items are (id, text)."""
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, wanted in asked.items():
        scores = []
        for doc, c in counts:
            n = sum(c.values())
            weigh = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total)))  # noqa: E731, B023
            if (score := sum(weigh(t) for t in wanted if t in c)) > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1)]
    return found


ITEMS = [(1, "alphabra bravocha charlie"), (2, "ONE two\x1ctwo three 123"), (3, None), (4, ""), (None, "日本語 é"), (2, "x aa"), (5, "nowhere to be found"), (1, "alphabra bravocha charlie"), (6, "é" * 250)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_loops(spark, odd, small, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    for docs, items, best in ((odd, ITEMS, 3), (small, [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:12], 50)):
        frame = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, term string, score int")
        got = [tuple(r) for r in search.search(docs, frame, best).collect()]
        want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items, best)
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(empty, items).count() == 0
    assert search.search(odd, items.limit(0)).count() == 0
    assert dict(search.search(odd, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_postings_of_rows(odd):
    rows = [r["text"] for r in odd.select("text").collect()]
    want = Counter((t, n, len(terms(text))) for text in rows for t, n in Counter(terms(text)).items())
    got = search.postings(odd).collect()
    assert Counter((r["term"], r["tf"], r["n"]) for r in got) == want
    assert len({(r["row"], r["term"]) for r in got}) == len(got)


def test_sums_are_not_shuffled(spark, small):
    """Scores are dealt by row once; a group limit stands below the shuffle of the ranks."""
    found = search.search(small, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan and "CartesianProduct" not in plan
