"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merges of the library's model are derived from a rank file: a token's merge
is the last pair that the lower ranks leave of its bytes. Texts are cut by the
pattern, and each distinct piece of a worker is encoded once by the library;
ids map back to bytes, bytes to characters, and so to character offsets.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, hold, table

#: Pieces that a worker remembers; beyond that it starts anew, so memory is bounded.
REMEMBERED = 250_000
#: Pieces to a call of the library, whose results are large.
CALL = 16_384


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a tiktoken rank file by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that become the token when all merges of lower rank are made."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            raise ValueError(f"token {token!r} can't be reached by merges")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def library_model(path: str) -> str:
    """The rank file as the tokenizers library's JSON."""
    tokens = read_ranks(path)
    ranks, shown = {t: i for i, t in enumerate(tokens)}, byte_characters()
    name = lambda t: "".join(shown[b] for b in t)
    merges = [[name(x) for x in merge_of(t, ranks)] for t in tokens if len(t) > 1]
    model = {"type": "BPE", "vocab": {name(t): i for i, t in enumerate(tokens)}, "merges": merges}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": byte_level, "post_processor": None, "decoder": byte_level, "model": model})


@lru_cache(maxsize=4)
def careful_pattern(pattern: str) -> tuple[str, str]:
    """The pattern with letters and numbers as tiktoken's Unicode tables have them, and the first character that is classed otherwise by the regex library.

    A tiktoken encoding of single bytes skips what its pattern doesn't match, so
    one pass over all characters shows a class.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    first = chr(0x10FFFF)
    for name in (r"\p{L}", r"\p{N}"):
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        if theirs != ours:
            first = min(first, *(theirs ^ ours))
            listed = lambda some: "[" + "".join(f"\\U{ord(c):08x}" for c in sorted(some)) + "]"
            changed = name
            if ours - theirs:
                changed = f"[{changed}--{listed(ours - theirs)}]"
            if theirs - ours:
                changed = f"[{changed}||{listed(theirs - ours)}]"
            pattern = pattern.replace(name, changed)
    return pattern, first


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, model: str, tokens: list[bytes], pattern: str, careful: tuple[str, str]) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_str(model), regex.compile(pattern).findall
        self.careful, self.rare = regex.compile(careful[0], regex.V1).findall, regex.compile(f"[{careful[1]}-\U0010ffff]").search
        self.known: dict[str, bytes] = {}
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def cut(self, text: str) -> list[str]:
        return self.careful(text) if not text.isascii() and self.rare(text) else self.plain(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for some in pieces for p in some}.difference(self.known))
        for start in range(0, len(new), CALL):
            self._learn(new[start : start + CALL])
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, some)), np.int32) for some in pieces]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes the pieces in one call, each as a word of its own, and remembers their ids as bytes."""
        done = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, np.int32).tobytes()
        ends = np.cumsum(np.bincount(np.array(done.word_ids, np.int64), minlength=len(pieces))) * 4
        start = 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            self.known[piece] = ids[start:end]
            start = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. A character may be split over tokens; the bytes are whole again once joined."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.table[at].tobytes()

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token; tokens that share a character both cover it."""
        first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        character = np.concatenate([np.cumsum(first) - 1, [first.sum()]])
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def _codec(key: tuple, shared) -> Codec:
    """One codec for a worker process, whatever the number of its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    return hold(("bpe", *key), lambda: Codec(*shared.value))


def _shared(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast((library_model(path), read_ranks(path), pattern, careful_pattern(pattern)))  # a vocabulary: its size is fixed


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and ids array<int>; on request starts and ends array<int> (character offsets) and decoded binary.

    Null and empty texts give no ids. Strings of special tokens are ordinary
    text. Rows stay as they are, repeated ones too; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, path, pattern)
    key = (path, pattern)

    def make():
        codec = _codec(key, shared)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").fill_null("").to_pylist()
            ids = codec.encode(texts)
            many = lambda arrays: pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, arrays)]), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32))).cast(pa.list_(pa.int32()))
            out = [batch.column("doc_id"), many(ids)]
            if offsets:
                spans = [codec.offsets(i, t.encode()) for i, t in zip(ids, texts, strict=True)]
                out += [many([s for s, _ in spans]), many([e for _, e in spans])]
            if decoded:
                out.append(pa.array([codec.decode(i) for i in ids], pa.binary()))
            return pa.RecordBatch.from_arrays(out, names)

        return work

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    return arrow_map(docs.select("doc_id", "text"), make, schema, most=1 << 20)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded binary of rows with doc_id and ids; null ids count as none."""
    shared = _shared(tokens.sparkSession, path, pattern)
    key = (path, pattern)

    def run(batches):
        codec = _codec(key, shared)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns; offsets_hash is over both arrays of character offsets."""
    shown = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("starts", "ends").alias("offsets_hash")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document's ids and the digests of its round trip."""
    import public_tokenizers

    encoded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, offsets=True, decoded=True))
