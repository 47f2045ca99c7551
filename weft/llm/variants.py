"""Spelling variants: words at edit distance one, by a self-join of the vocabulary's trie with active-node sets.

The trie is cut at prefixes. Two words at distance one, the longer of n letters,
share their first n // 2 letters or their last n - n // 2: each pair lies below
one such prefix of the trie of the words or of the trie of the words spelt
backwards. Below a prefix, a task walks its part of the trie and carries with
each node the active nodes at distance one; where a walk ends at a word, the
active nodes that are words are its pairs. A prefix with too many words is
taken apart by joins first: the edits at its next letter are looked up, and its
words go on under prefixes that are one letter longer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import BATCH_BYTES, bounded_batches, cut, slices, table, trim, written

#: What a word is made of, and the letters that are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: One in so many pairs of document and run loses a letter.
SLIPS = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form is this many times as frequent.
RATIO = 2
#: Words below a prefix that a task joins.
GROUP_WORDS = 20_000
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 1 << 18


def words_in(doc: object, text: str | None) -> Counter:
    """The words of a text with their counts: runs of letters, of which a hash of id and run makes some lose a letter."""
    found, start = Counter(), zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(RUN.findall((text or "").encode().translate(FOLD).decode())).items():
        slip = zlib.crc32(run.encode(), start)
        if slip % SLIPS == 0:
            at = slip % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough. Tasks send counts of words, not words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 65_536], pa.string()), pa.array(counts[at : at + 65_536], pa.int64())], ["word", "n"])

        held = Counter()
        for batch in slices(batches, "text", BATCH_BYTES):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.update(words_in(doc, text))
                if len(held) >= HELD_WORDS:
                    yield from flush()
        yield from flush()
        trim()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Node(dict):
    """A node of a trie: its children by letter, and the number of the word that ends here."""

    __slots__ = ("word",)

    def __init__(self) -> None:
        super().__init__()
        self.word = None


def pairs_below(paths: list[str], start: int) -> Iterator[tuple[int, int]]:
    """Numbers (longer or later, other) of the paths at distance one from each other that agree in their first `start` letters. Paths are distinct.

    The active nodes of a node are those that its word part turns into by one
    deletion, or by the replacement of a letter by a lesser one: a pair is then
    met from one side only. Of alignments of a pair the last one counts, so an
    active node that is the node's own parent is not carried twice.
    """
    root = Node()
    for number, path in enumerate(paths):
        node = root
        for letter in path[start:]:
            child = node.get(letter)
            if child is None:
                child = node[letter] = Node()
            node = child
        node.word = number
    open_ = [(root, [])]
    while open_:
        node, active = open_.pop()
        for letter, child in node.items():
            near = [node]
            for other in active:
                found = other.get(letter)
                if found is not None and found is not node:
                    near.append(found)
            for other, found in node.items():
                if other < letter:
                    near.append(found)
            if child.word is not None:
                for other in near:
                    if other.word is not None:
                        yield child.word, other.word
            if child:
                open_.append((child, near))


def _spelt(word: Column, way: Column) -> Column:
    return F.when(way == 1, F.reverse(word)).otherwise(word)


def groups(words: DataFrame) -> DataFrame:
    """(way, longest, depth, head, path, n): the prefixes under which a word can meet others. way 1: words are spelt backwards. longest: letters of a pair's longer word."""
    size = F.char_length("word")
    rows = words.withColumn("longest", F.explode(F.array(size, size + 1))).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.col("longest") / 2).cast("int")
    rows = rows.withColumn("depth", F.when(F.col("way") == 0, half).otherwise(F.col("longest") - half)).withColumn("path", _spelt(F.col("word"), F.col("way")))
    return rows.select("way", "longest", "depth", F.expr("left(path, depth)").alias("head"), "path", "n")


KEY = ["way", "longest", "head"]
PAIRS = "word string, n long, near string, near_n long"


def _new(path: Column, other: Column, way: Column, longest: Column) -> Column:
    """Is the pair one that the other way doesn't give? Backwards, only pairs whose first halves differ count."""
    half = F.floor(longest / 2).cast("int")
    return (way == 0) | (F.left(_spelt(path, way), half) != F.left(_spelt(other, way), half))


def _apart(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One letter further down under the given prefixes: the pairs whose edit is there, and the rows under the longer prefixes."""
    letter = F.expr("substring(path, depth + 1, 1)")
    rest = F.expr("substring(path, depth + 2)")
    letters = rows.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(letter != "", letter))).alias("letters"))  # an alphabet at most
    whole = rows.join(letters, KEY).where((F.char_length("path") == F.col("longest")) & (letter != ""))
    swapped = F.transform(F.filter("letters", lambda x: x < letter), lambda x: F.concat("head", x, rest))
    left_out = F.when(F.left(rest, F.lit(1)) != letter, F.array(F.concat("head", rest))).otherwise(F.array().cast("array<string>"))
    asked = whole.select("way", "longest", "path", "n", F.explode(F.concat(swapped, left_out)).alias("other"))
    asked = asked.where(_new(F.col("path"), F.col("other"), F.col("way"), F.col("longest"))).select(_spelt(F.col("path"), F.col("way")).alias("word"), "n", _spelt(F.col("other"), F.col("way")).alias("near"))
    found = asked.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
    deeper = rows.where(letter != "").withColumn("depth", F.col("depth") + 1).withColumn("head", F.expr("left(path, depth)"))
    return found, deeper


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix: the pairs of each prefix, from either side."""

    def joined() -> Iterator[tuple]:
        way, longest, _ = key
        for a, b in pairs_below([p for p, _ in held], depth):
            (one, n), (two, m) = held[a], held[b]
            if max(len(one), len(two)) == longest:
                if way:
                    one, two = one[::-1], two[::-1]
                    if one[: longest // 2] == two[: longest // 2]:
                        continue
                yield one, n, two, m
                yield two, m, one, n

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])

    key, depth, held, out = None, 0, [], []
    for rows in batches:
        for way, longest, at, head, path, n in zip(*(rows.column(c).to_pylist() for c in ("way", "longest", "depth", "head", "path", "n")), strict=True):
            if (way, longest, head) != key:
                if len(held) > 1:
                    out.extend(joined())
                key, depth, held = (way, longest, head), at, []
                if len(out) >= 20_000:
                    yield batch()
            held.append((path, n))
    if len(held) > 1:
        out.extend(joined())
    yield batch()
    trim()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of distinct words at distance one, from either side, once each. words: distinct (word, n), read more than once."""
    rows, found = groups(words), []
    while True:
        large = cut(rows.groupBy(*KEY).count().where(F.col("count") > GROUP_WORDS).select(*KEY))
        if large.isEmpty():
            break
        pairs, deeper = _apart(rows.join(large, KEY, "left_semi"), words)
        found.append(written(pairs))
        rows = written(rows.join(large, KEY, "left_anti").unionByName(deeper))
    below = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_walk, PAIRS)
    for pairs in found:
        below = below.unionByName(pairs).unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return below


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end. Each form is more frequent than its word, so there is no circle; the ways double with every join."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root string, n, n_near, form_n long of each word of five letters or more that occurs three times or more.

    Two words are near if one inserted, deleted or replaced code point turns one
    into the other. A word's form is its most frequent near word (of equals the
    first by code points), if that is at least twice as frequent; its root is
    where the forms end, the word itself without one.

    Null and empty texts have no words. Every row counts, repeated ones too; a
    null id reads as an empty one where a hash makes a run lose a letter. An
    empty table gives an empty result; other columns are ignored. A word may
    have any length, but a task holds the words of a prefix.
    """
    words = written(vocabulary(docs))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    formed = -F.col("best.n") >= RATIO * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    found = written(found)
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
