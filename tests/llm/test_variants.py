import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import variants
from weft.llm.variants import near_pairs, pairs_below, roots, spelling_variants


def near(a, b):
    """One inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def partners(words):
    """The near words of each, through words with a letter left out."""
    found, shapes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            shapes[i, less].add(w)
            if less in words:
                found[w].add(less)
                found[less].add(w)
    for group in shapes.values():
        for w in group:
            found[w] |= group - {w}
    return found


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            counts[doc, run] += n
    words = Counter()
    for (doc, run), n in counts.items():
        h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        words[run] += n
    words = {w: n for w, n in words.items() if n >= 3 and len(w) >= 5}
    by, form = partners(words), {}
    for w, n in words.items():
        if by[w] and words[best := min(by[w], key=lambda x: (-words[x], x))] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(by[w]), words.get(form.get(w)) or 0) for w, n in words.items())


def plain(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def text_of(words):
    return " ".join(f"{w} " * n for w, n in words.items())


#: A chain of forms, ties, runs of one letter, words of five letters that differ in every place, accents, and a long word.
PLANTED = {
    "center": 40, "centre": 9, "centr": 4, "ventre": 4, "xentre": 3, "aaaaa": 20, "aaaaaa": 9, "aaaaaaa": 4, "aabaa": 5, "baaaa": 8, "aaaab": 8, "caaaa": 3, "école": 6, "Écolé": 3, "ecole": 13, "ecoles": 3,
    "z" * 3000: 3, "z" * 2999: 7, "z" * 1500 + "y" + "z" * 1499: 3, "words": 6, "sword": 6, "swords": 3, "abcdefgh": 6, "bcdefgh": 3, "abcdefg": 3, "abcdxefgh": 3,
}


@pytest.mark.parametrize("group", [20_000, 3, 1])
def test_against_loops(spark, odd, small, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP_WORDS", group)
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    planted = {w: n for w, n in PLANTED.items() if len(w) < 100 or group > 3}  # a letter a round
    rows = [(i, text_of(planted)) for i in range(2)] + [(None, "nulls ids nulls nulls"), (7, None), (8, ""), (9, "x" * 70 + " " + "x" * 70)] + [(10 + i, "some words that lose a letter anywhere") for i in range(400)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert plain(spelling_variants(docs)) == brute(rows)
    if group > 1:
        frame = odd if group == 3 else small
        assert plain(spelling_variants(frame)) == brute([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])


def test_empty(empty):
    assert plain(spelling_variants(empty)) == []


@settings(max_examples=300)
@given(st.lists(st.text(alphabet="abc", max_size=7), unique=True, max_size=40), st.integers(0, 2))
def test_active_nodes_against_pairs(words, start):
    words = [w for w in words if w[:start] == "ab"[:start]]
    got = [tuple(sorted((words[i], words[j]))) for i, j in pairs_below(words, start)]
    assert len(set(got)) == len(got)
    # below a common prefix the edit lies behind it, or the pair is one by an edit there too, as in runs of a letter
    assert set(got) == {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a[start:], b[start:])}


def test_every_pair_once_from_either_side(spark):
    words = sorted({"".join(p) for p in __import__("itertools").product("ab", repeat=6)} | {"".join(p) for p in __import__("itertools").product("ab", repeat=5)})
    got = [(r["word"], r["near"]) for r in near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()]
    by = partners(set(words))
    assert sorted(got) == sorted((w, x) for w in words for x in by[w])


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "x")]
    assert {(r["word"], r["root"]) for r in roots(spark.createDataFrame(links, "word string, form string")).collect()} == {(w, "w37") for w, _ in links}
