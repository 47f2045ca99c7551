"""Removal of repeated lines: hashes dealt by range, sorted by document and place, streamed.

A task first folds the lines of a block of documents. A line that three of them
hold goes from all but the block's largest document, whatever other blocks
hold; only that document, or the one or two that hold a rarer line, go on. So
the rows of a line that is everywhere number two a block at most. They are
dealt by ranges of the line's hash, sorted with the largest document first, and
streamed: the first occurrence stays. What comes back is a compressed bitmap of
the lines that each document keeps, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, bounded_batches, cut, sized, table, written

#: What is stripped from a line's ends, and the letters that are lower-cased.
BLANK = " \t\n\v\f\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
#: Code points of the shortest key that is removed, and documents that hold it.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
#: Bytes of text to a block, and rows to a range.
BLOCK_BYTES = 16 << 20
RANGE_ROWS = 1_000_000

Entry = tuple[int | None, int, bytes]  # (document, mark of its text, places of a line in it)


def keys_of(text: str | None) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the places of each key that is long enough, by a hash of 128 bits."""
    lines, places = (text or "").split("\n"), {}
    for at, line in enumerate(lines):
        key = line.strip(BLANK)
        if len(key) >= LEAST_LENGTH:
            places.setdefault(hashlib.blake2b(key.encode().translate(FOLD), digest_size=16).digest(), []).append(at)
    return len(lines), places


def order(doc: int | None) -> tuple[bool, int]:
    """Documents by id; those without one come first."""
    return doc is not None, doc or 0


def folded(entries: list[Entry]) -> tuple[list[Entry], list[Entry], bool]:
    """What a block's entries of one line come to: (removed, still open, are there enough documents)."""
    if len(entries) < LEAST_DOCUMENTS or len(docs := {e[0] for e in entries}) < LEAST_DOCUMENTS:
        return [], entries, False
    largest = max(docs, key=order)
    return [e for e in entries if e[0] != largest], [e for e in entries if e[0] == largest], True


FOUND = "key binary, enough boolean, doc_id {id}, mark long, n_lines long, places binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (n_lines), for each place that goes for sure (places) and for each line that is open (key, places)."""

    def flush() -> Iterator[pa.RecordBatch]:
        for key, entries in lines.items():
            gone, still, enough = folded(entries)
            rows.extend((None, None, doc, mark, None, places) for doc, mark, places in gone)
            rows.extend((key, enough, doc, mark, None, places) for doc, mark, places in still)
        lines.clear()
        while rows:
            yield _batch(rows[:20_000], names, types)
            del rows[:20_000]

    names, types = ["key", "enough", "doc_id", "mark", "n_lines", "places"], [pa.binary(), pa.bool_(), None, pa.int64(), pa.int64(), pa.binary()]
    lines, rows, held = {}, [], 0
    for batch in batches:
        types[2] = batch.schema.field("doc_id").type
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
            count, places = keys_of(text)
            rows.append((None, None, doc, mark, count, None))
            for key, at in places.items():
                lines.setdefault(key, []).append((doc, mark, np.array(at, np.uint32).tobytes()))
            held += len(text or "")
            if held >= BLOCK_BYTES:
                yield from flush()
                held = 0
    yield from flush()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and falling document: all that aren't of a key's first document, where enough documents hold it. No more than the rows of a key's second document wait."""
    key, first, last, seen, enough, waiting = None, None, None, 0, False, []
    for batch in batches:
        out = []
        for at, sure, doc, mark, places in zip(*(batch.column(c).to_pylist() for c in ("key", "enough", "doc_id", "mark", "places")), strict=True):
            if at != key:
                key, first, last, seen, enough, waiting = at, doc, doc, 1, False, []
            elif doc != last:
                last, seen = doc, seen + 1
            enough = enough or sure or seen >= LEAST_DOCUMENTS
            if doc != first:
                waiting.append((doc, mark, places))
            if enough:
                out += waiting
                waiting = []
        yield _batch(out, ["doc_id", "mark", "places"], [batch.schema.field("doc_id").type, pa.int64(), pa.binary()])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_lines long, n_dropped long, keep binary) of each id and text: keep is the bitmap of the lines that stay, most significant bit first, compressed by zlib. mark: a hash of the text, which tells rows of one id apart.

    Lines are parted by newlines; a line's key is the line without blanks at its
    ends, with A to Z in lower case. Keys of 20 code points or more that three
    documents or more hold go from all of them but the one with the largest id.

    Null and empty texts have one empty line. A document is an id: rows that
    share one count once, and if it is the largest all of them keep the line.
    Rows without an id are one document, smaller than the others. Repeated rows
    have one bitmap. An empty table gives an empty result; other columns are
    ignored. A long text's lines are held by one task.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(spark)
    found = written(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_blocks, FOUND.format(id=kind)))
    still = found.where("key IS NOT NULL").select("key", "enough", "doc_id", "mark", "places")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), still.count() // RANGE_ROWS)
    sorted_ = still.repartitionByRange(ranges, "key").sortWithinPartitions("key", F.desc_nulls_last("doc_id"), "mark")
    gone = sorted_.mapInArrow(_stream, f"doc_id {kind}, mark long, places binary")
    parts = found.where("key IS NULL").select("doc_id", "mark", "n_lines", "places").unionByName(gone, allowMissingColumns=True)
    lines = parts.groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, keep = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
                stays = np.ones(n, bool)
                stays[np.frombuffer(b"".join(places), np.uint32)] = False
                dropped.append(n - int(stays.sum()))
                keep.append(zlib.compress(np.packbits(stays).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "mark", "n_lines", "n_dropped", "keep"])

    return lines.mapInArrow(bitmaps, f"doc_id {kind}, mark long, n_lines long, n_dropped long, keep binary")


def kept(text: str | None, keep: bytes | None) -> str:
    """The lines of a text that its bitmap keeps; all without one."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, stay in zip(lines, stays, strict=True) if stay)


def clean(docs: DataFrame, work, schema: str) -> DataFrame:
    """Each row's (doc_id, text, keep) through `work`, a function of Arrow batches; keep is null where no line goes. Texts are shuffled only where the bitmaps are too many to be broadcast."""
    losing = cut(keep_bitmaps(docs).where("n_dropped > 0").select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "keep"))
    rows = docs.select("doc_id", "text").join(sized(losing, F.octet_length("keep") + 64), F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_mark")), "left")
    return arrow_map(rows.select("doc_id", "text", "keep"), lambda: work, schema)


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id and the text that stays, of every row."""
    work = lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(kept, b.column("text").to_pylist(), b.column("keep").to_pylist()), pa.string())], ["doc_id", "text"])
    return clean(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, keep in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "keep")), strict=True):
            n = (text or "").count("\n") + 1
            stay = n if keep is None else int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).sum())
            rows.append((doc, n, n - stay, hashlib.sha256(kept(text, keep).encode()).hexdigest()))
        return _batch(rows, ["doc_id", "n_lines", "n_dropped", "kept_sha256"], [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string()])

    return clean(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER.decode()}', '{LOWER.decode()}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
j AS (SELECT doc_id, line, place, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
