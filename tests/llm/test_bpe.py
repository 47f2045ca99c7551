import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from weft.llm.bpe import decode, digests, encode, query, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(PATH))}, special_tokens={})


def test_against_tiktoken(odd, small, oracle):
    for docs in (odd, small):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        got = sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in encode(docs, PATH, P.PATTERN, decoded=True).collect())
        assert got == sorted((str(i), oracle.encode_ordinary(t), t.encode()) for i, t in texts)


def test_characters_beyond_the_regex_library(spark, oracle):
    texts = ["\U000125b7's<|endoftext|>﻿", "\U00018f76's", "aᲉ's ֋", "don't  \n\n x　 "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in encode(docs, PATH, P.PATTERN).collect()} == {i: oracle.encode_ordinary(t) for i, t in enumerate(texts)}


def test_offsets_cover_the_text(odd):
    rows = {(r["doc_id"], r["text"]): r["text"] for r in odd.collect()}
    texts = {i: t for (i, t) in rows if i in (14, 18, 21)}
    for r in encode(odd, PATH, P.PATTERN, offsets=True).collect():
        if r["doc_id"] in texts:
            text = texts[r["doc_id"]]
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
            covered = {c for a, b in zip(r["starts"], r["ends"], strict=True) for c in range(a, b)}
            assert covered == set(range(len(text))) and all(a < b for a, b in zip(r["starts"], r["ends"], strict=True))


def test_decode_round_trip(spark, odd, empty):
    tokens = encode(odd, PATH, P.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in decode(tokens, PATH, P.PATTERN).collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert digests(encode(empty, PATH, P.PATTERN, offsets=True, decoded=True)).count() == 0


def test_query_offsets_hash(spark):
    """The query's hash of offsets is that of offsets counted character by character."""
    rows = query(spark, "/root/testdata/sf0.001").limit(20).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokens = read_ranks(PATH)
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for r in rows:
        character = [i for i, c in enumerate(texts[r["doc_id"]]) for _ in c.encode()]
        starts, ends, at = [], [], 0
        for i in coder.encode_ordinary(texts[r["doc_id"]]):
            starts.append(character[at])
            at += len(tokens[i])
            ends.append(character[at - 1] + 1)
        expected = spark.createDataFrame([(starts, ends)], "starts array<int>, ends array<int>").select(F.xxhash64("starts", "ends").alias("h")).first()["h"]
        assert r["offsets_hash"] == expected
