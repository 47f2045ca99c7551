import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st

from weft.llm import token_counts
from weft.llm.token_counts import MARK, Trie, count, unigram

PATH = P.path("piece_bpe_32k.model")


def brute(scores, word, unknown=None, longest=None):
    """The best segmentation without a trie: (score, tokens) by position."""
    unknown, longest = unknown or min(scores.values()) - 10.0, longest or max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            found.append((best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())))
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


@given(st.lists(st.text(alphabet="abcdé▁日", min_size=1, max_size=12), max_size=20))
def test_trie_against_words_alone(words):
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -4.5, "c": -3.0, "▁a": -1.5, "▁": -2.0, "dd": -3.0, "bcd": -3.5}
    trie = Trie(scores, nodes=40)
    assert [trie.count(w) for w in words] == [brute(scores, w) for w in words]


def test_against_the_library(small):
    from tokenizers import Tokenizer, models

    scores = unigram(PATH)
    library = Tokenizer(models.Unigram([*scores.items(), ("<unk>", -1.0)], len(scores), False))
    words = sorted({w for r in small.collect() for w in r["text"].split() if all(c in scores for c in w)})
    trie = Trie(scores)
    assert [trie.count(MARK + w) for w in words] == [len(x.ids) for x in library.encode_batch([MARK + w for w in words])]


def test_whole_table(odd, small, empty):
    scores = unigram(PATH)
    unknown, longest = min(scores.values()) - 10.0, max(map(len, scores))
    for docs in (odd, small):
        rows = docs.collect()
        known = {w: brute(scores, MARK + w, unknown, longest) for w in {w for r in rows for w in (r["text"] or "").split()}}
        want = sorted((str(r["doc_id"]), sum(known[w] for w in (r["text"] or "").split()), len((r["text"] or "").split())) for r in rows)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_pretokens"]) for r in count(docs, PATH).collect()) == want
    assert count(empty, PATH).count() == 0


def test_long_words_stay_out_of_the_trie(monkeypatch):
    scores = {"a": -2.0, "ab": -2.5, "abc": -2.9, "b": -3.0, "ca": -2.2, "abab": -4.0}
    words = ["abc" * 400, "abab" * 301 + "x" + "ca" * 100, "xyz" * 100, "é" + "ab" * 300]
    monkeypatch.setattr(token_counts, "DEPTH", 10_000)
    whole = [token_counts.Trie(scores).count(w) for w in words]
    monkeypatch.setattr(token_counts, "DEPTH", 5)
    trie = token_counts.Trie(scores)
    assert [trie.count(w) for w in words] == whole and len(trie.best) <= 1 + 5 * len(words)
