"""Token counts by trie-shared dynamic programming over a unigram model.

The distinct pre-tokens (words between white space, with the word mark before
them) of a worker go into one trie. A node stands for a prefix and holds the
best unigram score and the number of tokens of that prefix, computed once from
its ancestors, however many words share it; a word's count is the value at its
last node. Beyond its first DEPTH characters a word is carried on outside the
trie, with as many scores as the longest token asks for.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import arrow_map, hold, table

MARK = "▁"
#: How much worse than the rarest token a character outside the vocabulary is; it counts as its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0
#: Nodes that a worker's trie holds at most; beyond that it starts anew, so memory is bounded.
NODES = 600_000
#: Characters of a word that go into the trie.
DEPTH = 256


@lru_cache(maxsize=4)
def unigram(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file with log probabilities after Zipf's law for their rank; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = log(sum(1 / (rank + 2.7) for rank in range(len(plain))))
    return {model.id_to_piece(i): -log(rank + 2.7) - norm for rank, i in enumerate(plain)}


class Trie:
    def __init__(self, scores: dict[str, float], nodes: int = NODES) -> None:
        self.scores, self.longest, self.nodes = scores, max(map(len, scores), default=1), nodes
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """The number of tokens of the best segmentation; of equal scores the one with fewer tokens."""
        if len(self.best) > self.nodes:
            self.clear()
        node, path = 0, [0]
        for depth, character in enumerate(word[:DEPTH]):
            child = self.children.get((node, character))
            if child is None:
                child = self.children[node, character] = len(self.best)
                self._forward(word, depth + 1, path)
            node = child
            path.append(node)
        return self.tokens[node] if len(word) <= DEPTH else self._beyond(word, path)

    def _beyond(self, word: str, path: list[int]) -> int:
        """The same forward scores for the rest of a long word; the last ones are kept, and only for this word."""
        scores, longest = self.scores, self.longest
        best, tokens, first = [self.best[n] for n in path], [self.tokens[n] for n in path], 0
        for end in range(len(path), len(word) + 1):
            most, fewest, found = -1e300, 0, False
            for start in range(max(0, end - longest), end):
                if (score := scores.get(word[start:end])) is not None:
                    found |= start == end - 1
                    value, number = best[start - first] + score, tokens[start - first] + 1
                    if value > most or (value == most and number < fewest):
                        most, fewest = value, number
            if not found and (value := best[end - 1 - first] + self.unknown) > most:
                most, fewest = value, tokens[end - 1 - first] + len(word[end - 1].encode(errors="surrogatepass"))
            best.append(most)
            tokens.append(fewest)
            if len(best) > 64 * longest + DEPTH:
                first = end + 1 - longest
                del best[:-longest], tokens[:-longest]
        return tokens[-1]

    def _forward(self, word: str, end: int, path: list[int]) -> None:
        scores, best, tokens, found, most, fewest = self.scores, self.best, self.tokens, False, -1e300, 0
        for start in range(max(0, end - self.longest), end):
            if (score := scores.get(word[start:end])) is not None:
                found |= start == end - 1
                at = path[start]
                if (value := best[at] + score) > most or (value == most and tokens[at] + 1 < fewest):
                    most, fewest = value, tokens[at] + 1
        if not found:
            at = path[end - 1]
            if (value := best[at] + self.unknown) > most:
                most, fewest = value, tokens[at] + len(word[end - 1].encode(errors="surrogatepass"))
        best.append(most)
        tokens.append(fewest)


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens long, n_pretokens long of every row and whole text.

    Null, empty and blank texts have none. A repeated row is counted again;
    only doc_id and text are read. A word may have any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(unigram(path))  # a vocabulary: its size is fixed

    def make():
        trie = hold(("trie", path), lambda: Trie(shared.value))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = pc.utf8_split_whitespace(batch.column("text").fill_null(""))
            distinct = words.flatten().dictionary_encode()
            held = distinct.dictionary.to_pylist()
            counts = np.array([trie.count(MARK + w) if w else 0 for w in held] + [0], np.int64)[distinct.indices.to_numpy()]
            present = np.array([bool(w) for w in held] + [False])[distinct.indices.to_numpy()]
            edges = words.offsets.to_numpy()
            total = lambda each: np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[edges])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total(counts)), pa.array(total(present))], ["doc_id", "n_tokens", "n_pretokens"])

        return work

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pretokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
