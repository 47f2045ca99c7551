"""Corpus-wide counts without a row for each item: buckets of documents and packed lists.

Documents are dealt into buckets of a bounded number of bytes. A bucket sends
its distinct keys as packed, sorted lists, one for each key partition; a key
partition answers each list by an array aligned with it, so an answer needs no
keys. A key that is everywhere costs one entry a bucket, however many documents
hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bounded_batches, numbered

#: Bytes of text to a bucket, on average, and entries to a key partition.
BUCKET_BYTES = 8 << 20
PARTITION_ENTRIES = 4_000_000
#: Bits of a key beside those that choose its partition.
KEY_BITS = 40


@dataclass(frozen=True)
class Layout:
    rows: int
    buckets: int
    partitions: int

    @property
    def shift(self) -> int:
        """Bits that a 64-bit key drops."""
        return max(0, 64 - KEY_BITS - self.partitions.bit_length())


def bucketed(docs: DataFrame, entries_per_byte: float) -> tuple[DataFrame, Layout]:
    """Rows (bucket, doc_id, rid, text), dealt by the hash of the row and shuffled once, and the layout that the bytes of the texts ask for. A null text is empty."""
    bounded_batches(docs.sparkSession)
    rows = numbered(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = Layout(size["rows"], max(1, -(-size["bytes"] // BUCKET_BYTES)), max(least, int(size["bytes"] * entries_per_byte) // PARTITION_ENTRIES))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "rid"), F.lit(layout.buckets)).cast("int").alias("bucket"), "doc_id", "rid", "text")
    return dealt.repartition(min(layout.buckets, max(least, layout.buckets // 4)), "bucket"), layout


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences of 4 bytes, or of 8 where one is larger."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return (b"4" + steps.astype(np.uint32).tobytes()) if not len(steps) or steps.max() < 1 << 32 else b"8" + steps.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if data[:1] == b"4" else np.uint64, offset=1), dtype=np.uint64)


def split_keys(keys: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (partition, rest) of 64-bit keys in their order, how often each occurs, and which of them each key is. Few arrays as long as the keys are held at a time."""
    bits = np.uint64(64 - layout.partitions.bit_length())
    joined = keys >> np.uint64(layout.shift)
    part = joined % np.uint64(layout.partitions)
    joined //= np.uint64(layout.partitions)
    part <<= bits
    joined |= part
    del part
    order = np.argsort(joined)
    joined = joined[order]
    new = np.concatenate([[True], joined[1:] != joined[:-1]])[: len(joined)]
    inverse = np.empty(len(joined), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    first = np.flatnonzero(new)
    distinct = joined[first]
    return (distinct >> bits).astype(np.int64), distinct & ((np.uint64(1) << bits) - np.uint64(1)), np.diff(np.append(first, len(joined))), inverse


def lists(bucket: int, part: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> pa.Table:
    """The bucket's list for each key partition: rows (part, bucket, keys, counts)."""
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(edges[1:], len(part))[: len(edges)]
    return pa.table(
        {
            "part": pa.array(part[edges], pa.int32()),
            "bucket": pa.array(np.full(len(edges), bucket), pa.int32()),
            "keys": pa.array([pack(rest[a:b]) for a, b in zip(edges, ends, strict=True)], pa.binary()),
            "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()),
        }
    )


LISTS = "part int, bucket int, keys binary, counts binary"
ANSWERS = "bucket int, part int, answer binary"


def totals(table: pa.Table) -> pa.Table:
    """For each list of one key partition, its keys' counts over all buckets: numbers of 4 bytes with a point, which no corpus is too large for. They are exact up to 2**24 and within a part of 2**24 beyond."""
    each = [unpack(x) for x in table.column("keys").to_pylist()]
    keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    total = np.bincount(inverse, counts, len(keys)).astype(np.float32)[inverse]
    edges = np.cumsum([0, *map(len, each)])
    return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "answer": pa.array([total[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})


def counted_lists(found: DataFrame, layout: Layout) -> DataFrame:
    """Answers to the buckets' lists. The lists are dealt into as many partitions as the layout has, whatever the session's setting, so no task grows with the input."""
    return found.repartition(layout.partitions, "part").groupBy("part").applyInArrow(totals, ANSWERS)


def answered(answers: pa.Table) -> np.ndarray:
    """The answers to a bucket's lists, as one array in the order of its distinct keys."""
    order = np.argsort(answers.column("part").to_numpy())
    data = answers.column("answer").to_pylist()
    return np.concatenate([np.frombuffer(data[i], np.float32) for i in order]) if data else np.zeros(0, np.float32)
