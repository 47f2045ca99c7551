from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
import pytest
import regex

from tests.llm.conftest import prose
from weft.llm import buckets, near_dedup
from weft.llm.near_dedup import classes, components, counted, shingles, stage


def brute(rows, threshold=0.8):
    """The class, as the least row number, of each text."""
    bags = []
    for text in rows:
        w = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}&&[\p{L}\p{N}]]|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]]+", (text or "").lower(), regex.V1)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([(text or "").strip()]))
    seen = Counter(s for b in bags for s in b)
    idf = {s: 1 + log((1 + len(rows)) / (1 + n)) / log(1 + len(rows)) for s, n in seen.items()}
    weight = [sum(n * idf[s] for s, n in b.items()) for b in bags]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        shared = sum(n * idf[s] for s, n in (bags[i] & bags[j]).items())
        if shared and shared / (weight[i] + weight[j] - shared) >= threshold - 1e-9:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def partition(keys):
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    return sorted(groups.values())


@pytest.mark.parametrize("bucket", [8 << 20, 20_000])
def test_against_all_pairs(spark, small, monkeypatch, bucket):
    monkeypatch.setattr(buckets, "BUCKET_BYTES", bucket)
    rows = small.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in classes(small).collect()}
    want = brute([r["text"] for r in rows])
    assert [got[r["doc_id"]]["class_id"] for r in rows] == [rows[i]["doc_id"] for i in want]
    assert sum(r["kept"] for r in got.values()) == len(set(want))


def test_chains_of_edits(spark):
    """Neighbours in a chain are alike, its ends are not: one class, whatever the pivots."""
    texts = []
    for family in range(3):
        words = prose(100 + family, 150).split()
        for step in range(25):
            texts.append(" ".join(words))
            words[(step * 13) % 150 : (step * 13) % 150 + 2] = [f"new{family}x{step}", f"new{family}y{step}"]
    rng = np.random.default_rng(1)
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    assert partition([got[i] for i in range(len(texts))]) == partition(brute([texts[k] for k in order]))


def test_edges(spark, odd, empty):
    rows = odd.collect()
    got = classes(odd).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(set(brute([r["text"] for r in rows])))
    by_id = {r["doc_id"]: r["class_id"] for r in got}
    assert by_id[5] == by_id[3] == by_id[7] == by_id[8] == 3 and by_id[13] == 12 and by_id[10] == by_id[11] == by_id[9] == 9 and by_id[20] == 19
    assert classes(empty).count() == 0
    kept = stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == len(set(brute([r["text"] for r in rows])))


def test_group_just_below_the_threshold(spark, monkeypatch):
    """Copies that are just below the threshold to each other aren't all compared, and no link is lost by it: those of one edit are still one class."""
    words, rng, texts = prose(7, 120).split(), np.random.default_rng(7), []
    for i in range(90):
        own = list(words)
        for k, at in enumerate(rng.choice(110, 3, replace=False)):
            own[at] = f"edit{i}x{k}"
        texts += [" ".join(own)] + ([" ".join([*own, "end"])] if i % 9 == 0 else [])
    compared, real = [], near_dedup.settle

    def counting(df):
        kept = real(df)
        if "similarity" in kept.columns:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(near_dedup, "settle", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    want = partition(brute(texts))
    assert partition([got[i] for i in range(len(texts))]) == want and 50 < len(want) < 95
    assert sum(compared) < 5 * len(texts)


def test_group_that_shares_its_rarest_shingles(spark, monkeypatch):
    """Copies of a text that isn't among them, of two edits each: their rarest common shingles are the same, yet few pairs are compared, rounds are few, and those of one edit are one class."""
    words, rng, texts = prose(8, 200).split(), np.random.default_rng(8), []
    for i in range(90):
        own = list(words)
        for k, at in enumerate(5 + 10 * rng.choice(19, 2, replace=False)):
            own[at] = f"edit{i}x{k}"
        texts += [" ".join(own)] + ([" ".join([*own, "end"])] if i % 9 == 0 else [])
    compared, real = [], near_dedup.settle

    def counting(df):
        kept = real(df)
        if "similarity" in kept.columns:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(near_dedup, "settle", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    want = partition(brute(texts))
    assert partition([got[i] for i in range(len(texts))]) == want and 50 < len(want) < 95
    assert sum(compared) < 10 * len(texts) and len(compared) <= 3


def test_groups_bound_what_is_shared():
    """Whatever two texts share weighs no more than the sum of the lesser weights of their groups."""
    rng = np.random.default_rng(4)
    pool = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    bags = [(pool[np.sort(rng.choice(3000, n, replace=False))], rng.random(n).astype(np.float32) + 1) for n in (1, 40, 600, 2000)]
    edges = np.cumsum([0, *(len(v) for v, _ in bags)])
    sums = near_dedup.grouped(np.concatenate([v for v, _ in bags]), np.concatenate([w for _, w in bags]), edges)
    for (a, (v, w)), (b, (x, y)) in combinations(enumerate(bags), 2):
        _, i, j = np.intersect1d(v, x, return_indices=True)
        assert np.minimum(w[i], y[j]).sum() <= np.minimum(sums[a], sums[b]).sum() * (1 + 1e-5)
        assert np.allclose(sums[a].sum(), w.sum(), rtol=1e-5)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 120), (101, 120), (101, 140)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 120, 140), 100)}


def test_scripts_without_spaces(spark):
    """Each character is a word there, so a changed one leaves a near copy."""
    text = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(200))
    other = "".join(chr(0x4E00 + (i * 104729 + 5) % 20000) for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text[:99] + "\u3042" + text[100:]), (3, other), (4, "abc " + text)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_slices_change_nothing(monkeypatch):
    texts = pa.array(["", "one two", prose(1, 300), "日本語" * 50 + " end", prose(2, 3000), "x" * 5000 + " y", "a"])
    whole = shingles(texts)
    monkeypatch.setattr(near_dedup, "SLICE", 500)
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    for a, b in zip(whole, shingles(texts), strict=True):
        assert (a == b).all()
    for a, b in zip(counted(*whole[:2]), counted(*shingles(texts)[:2]), strict=True):
        assert (a == b).all()


def exact_links(bags, threshold=0.8):
    """All pairs of weighted bags at the threshold, by prefixes: rare shingles first, a pair shares one before the rest weighs too little."""
    held = Counter(s for b in bags for s in b)
    seen, links = {}, []
    for i, bag in enumerate(bags):
        total = rest = sum(bag.values())
        near = set()
        for s in sorted(bag, key=lambda s: (held[s], s)):
            if rest < threshold * total - 1e-9:
                break
            rest -= bag[s]
            near.update(seen.setdefault(s, []))
            seen[s].append(i)
        for j in near:
            other = bags[j]
            shared = sum(min(w, other[s]) for s, w in bag.items() if s in other)
            if shared / (total + sum(other.values()) - shared) >= threshold - 1e-9:
                links.append((j, i))
    return links


def test_recall_on_ten_thousand_documents(spark):
    """Every pair at the threshold, of 10,000 documents, falls into one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    table = docs.select("doc_id", "text").toArrow()
    edges, hashes, counts = counted(*shingles(table.column("text").combine_chunks().fill_null(""))[:2])
    _, which, documents = np.unique(hashes, return_inverse=True, return_counts=True)
    weight = near_dedup.idf(documents, table.num_rows)[which] * counts
    bags = [dict(zip(hashes[a:b].tolist(), weight[a:b].tolist(), strict=True)) for a, b in zip(edges, edges[1:], strict=False)]
    first = {}
    for i, bag in enumerate(bags):
        first.setdefault(frozenset(bag.items()), i)
    chosen = sorted(first.values())
    links = exact_links([bags[i] for i in chosen])
    got = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    ids = table.column("doc_id").to_pylist()
    found = sum(got[ids[chosen[a]]] == got[ids[chosen[b]]] for a, b in links)
    assert len(links) > 20 and found == len(links)
