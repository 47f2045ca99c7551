import random

import numpy as np
import pytest

from weft.llm import buckets, substring_dedup
from weft.llm.substring_dedup import KEY, LENGTH, WINDOW, _triggered, remove_repeats, repeated


def brute(rows):
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if (s := data[i : i + LENGTH]) in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(s)
        out.append(bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("bucket", "spread"), [(8 << 20, 1 << 17), (20_000, 1 << 17), (20_000, 2)])
def test_against_all_strings(spark, small, odd, monkeypatch, bucket, spread):
    monkeypatch.setattr(buckets, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substring_dedup, "SPREAD", spread)
    rows = small.orderBy("doc_id").collect()
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(small).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows]), strict=True))


def test_edges(odd, empty):
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    got = remove_repeats(odd).collect()
    assert sorted(bytes(r["kept"]) for r in got) == sorted(brute([r["text"] for r in rows]))
    sizes = sorted(len((r["text"] or "").encode()) for r in rows)
    assert sorted(len(r["kept"]) + sum(x["end"] - x["start"] for x in r["spans"]) for r in got) == sizes
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_combined_order_against_strings(seed):
    """Phrases of few triggers with few different surroundings, zero bytes too: the repeats are those of the strings themselves."""
    rng = random.Random(seed)
    left, key, right = ([bytes(rng.choice(b"\0\0ab") for _ in range(n)) for _ in range(k)] for n, k in ((WINDOW, 3), (KEY, 2), (LENGTH, 3)))
    place, sizes, data = [], [], []
    for _ in range(60):
        a, b = sorted((rng.randrange(WINDOW), rng.randrange(WINDOW)))
        text = rng.choice(left)[:b] if rng.random() < 0.3 else rng.choice(left)[WINDOW - b :]
        tail = LENGTH - a - KEY
        follow = rng.choice(right)
        follow = follow[: rng.randrange(LENGTH)] + rng.choice(right)
        place.append(b)
        data.append(text + rng.choice(key) + follow[:tail])
        sizes.append(len(data[-1]))
    place, sizes = np.array(place), np.array(sizes)
    phrase, offset = repeated(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes, place)
    seen, want = set(), set()
    for i, text in enumerate(data):
        for o in range(len(text) - LENGTH + 1):
            string = (int(place[i]) - o, text[o : o + LENGTH])
            if string in seen:
                want.add((i, o))
            seen.add(string)
    assert set(zip(phrase.tolist(), offset.tolist(), strict=True)) == want and want


def test_triggers_stay_whole(monkeypatch):
    monkeypatch.setattr("weft.llm.substring_dedup.SORTED", 3)
    hashes = np.array([5, 1, 5, 2, 2, 9, 1, 1, 1, 7, 5], np.uint64)
    parts = [p.tolist() for p in _triggered(hashes)]
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert all(len({k for k, p in enumerate(parts) if {i for i in p if hashes[i] == h}}) <= 1 for h in set(hashes.tolist()))
