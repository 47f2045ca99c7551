import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import EXTRA, SCHEMA, odd_rows, prose
from weft.llm import common, line_dedup
from weft.llm.line_dedup import FOLD, deduped, digests, keep_bitmaps, order

COMMON = ["Subscribe to our newsletter today!", "All rights reserved, 2024 edition", "éééééééééééééééééééé", "short", "", "  \t "]


def key(line):
    return line.strip(" \t\n\v\f\r").encode().translate(FOLD).decode()


def brute(rows):
    """(id, text) of rows by loops: (id, lines, dropped, kept text)."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    last = {k: max(v, key=order) for k, v in holders.items() if len(v) >= 3}
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        found.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return found


@pytest.fixture(scope="module")
def lined(spark):
    """Documents of few different lines: frames, blanks, one line in all, null and repeated ids."""
    rng, none = random.Random(5), [None] * (EXTRA.count(",") + 1)
    pool = [*COMMON, *(prose(i, 5) for i in range(12))]
    texts = ["\n".join([COMMON[0].upper() if i % 2 else f"\t{COMMON[0]}\r", *(rng.choice(pool) for _ in range(rng.randrange(6))), *[COMMON[1]] * (i % 3)]) for i in range(70)]
    rows = [(None if i % 20 == 7 else i // 2 if i % 9 == 0 else i, text) for i, text in enumerate(texts)] + [(3, "one line only here, really"), (3, "one line only here, really"), (4, "one line only here, really"), (None, "one line only here, really"), (60, None), (61, "\n\n")]
    return spark.createDataFrame([(d, t, None, None, None, *none) for d, t in rows] + odd_rows(), SCHEMA).repartition(5)


@pytest.mark.parametrize(("block", "broadcast"), [(16 << 20, True), (300, True), (1, False)])
def test_against_loops(spark, lined, small, monkeypatch, block, broadcast):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", 40)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    for docs in (lined, small):
        want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        assert any(w[2] for w in want)
        got = digests(docs)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((d, n, k, hashlib.sha256(t.encode()).hexdigest())) for d, n, k, t in want)
    assert sorted(map(str, map(tuple, deduped(lined).collect()))) == sorted(str((d, t)) for d, _, _, t in brute([(r["doc_id"], r["text"]) for r in lined.select("doc_id", "text").collect()]))


def test_bitmaps(lined, empty):
    rows = keep_bitmaps(lined).collect()
    assert len(rows) == lined.selectExpr("doc_id", "xxhash64(text)").distinct().count()
    for r in rows:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8))
        assert len(bits) - r["n_lines"] < 8 and bits.sum() == r["n_lines"] - r["n_dropped"]
    assert keep_bitmaps(empty).count() == 0 == digests(empty).count()


def test_a_block_sends_two_rows_of_a_line_at_most(spark):
    """A line that all documents hold is decided within the block but for the largest id."""
    docs = spark.createDataFrame([(i, COMMON[0]) for i in range(500)], "doc_id long, text string").coalesce(2)
    found = [tuple(r) for r in digests(docs).collect()]
    assert sorted(k for _, _, k, _ in found) == [0] + [1] * 499 and next(d for d, _, k, _ in found if not k) == 499
    gone, still, enough = line_dedup.folded([(i, 0, b"") for i in range(500)])
    assert (len(gone), still, enough) == (499, [(499, 0, b"")], True)
    assert line_dedup.folded([(1, 0, b""), (2, 0, b""), (2, 1, b"")]) == ([], [(1, 0, b""), (2, 0, b""), (2, 1, b"")], False)
