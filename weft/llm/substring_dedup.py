"""Removal of repeated 100-byte strings by prefix-free parsing: suffixes of the dictionary and of the parse, combined.

Parsing: a rolling hash of KEY bytes triggers where it is the leftmost least of
a window of such hashes; the window is as wide as makes every string of LENGTH
bytes hold a trigger. So each such string belongs to the phrase of its own
trigger, which depends on its bytes alone, and equal strings sit at equal places
of phrases with equal triggers.

A string is then two parts: what is left of its trigger, a suffix of the
dictionary's phrase that ends there, and what follows from the trigger on, the
start of the parse's suffix there, held as its bytes as far as a string needs
them and not as numbers of phrases. Both are sorted by their bytes, with the length
of the prefix that neighbours share: the parse's suffixes from the trigger on
(which brings equal triggers together), and the dictionary's from the trigger
backwards, which sorts its suffixes of every length at once. For each distance
to the trigger the two orders' runs of equal parts are combined, and within a
pair of runs the strings stand in the order of the corpus: all but the first are
repeats. Parts longer than a string of LENGTH bytes can need are not sorted.

A phrase takes part once a bucket, with its first place; of equal phrases in a
bucket all but the first are repeats as they stand. Phrases of triggers that
occur once in the corpus, most of them, never leave their bucket.

A trigger that occurs so often that its phrases might not fit a task is resolved
string by string instead: its strings are dealt out by a hash, so equal strings
meet and different ones spread, and are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.buckets import LISTS, Layout, answered, bucketed, counted_lists, lists, split_keys
from weft.llm.common import release, table

LENGTH = 100
KEY = 37
WINDOW = LENGTH - KEY + 1
#: Occurrences of a trigger from which its strings are dealt out one by one.
SPREAD = 1 << 17
#: Bytes that are hashed at a time.
BLOCK = 1 << 15
#: Phrases that are sorted at a time, but for a single trigger's; SPREAD bounds those.
SORTED = 1 << 16
#: Order of rows without an id: after all others.
LAST = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP = np.full(BLOCK + LENGTH + 1, _BASE, np.uint64)
_DOWN = np.full(BLOCK + LENGTH + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
_UP[0] = _DOWN[0] = 1
_UP, _DOWN = np.cumprod(_UP), np.cumprod(_DOWN)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, the same wherever a string stands."""
    out = np.empty(max(0, len(data) - size + 1), np.uint64)
    for i in range(0, len(out), BLOCK):
        part = data[i : i + BLOCK + size - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)])])
        h = (sums[size:] - sums[:-size]) * _DOWN[: len(part) - size + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[i : i + BLOCK] = h ^ (h >> np.uint64(32))
    return out


def triggers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts that stand one after the other, text i from edges[i]: hash and place of the trigger, and the first and last start of the strings that belong to it. Strings over an edge don't count."""
    found = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
    blocks, whole = [], np.ones(len(data), bool)
    for end in edges[1:].tolist():
        whole[max(0, end - LENGTH + 1) : end] = False
    for i in range(0, len(data) - LENGTH + 1, BLOCK):
        h = rolling(data[i : i + BLOCK + LENGTH - 1], KEY)
        least, width = h, 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        # The leftmost place of a run of windows with one least hash: the first from the run's start on.
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        # It is the new right end where that is less than all before; else it is looked for.
        at = starts + (WINDOW - 1)
        entered = h[at] < np.concatenate([least[:1], least[starts[1:] - 1]])
        entered[0] = False
        todo = np.flatnonzero(~entered)
        for d in range(WINDOW):
            hit = h[starts[todo] + d] == least[starts[todo]]
            at[todo[hit]] = starts[todo[hit]] + d
            todo = todo[~hit]
            if not len(todo):
                break
        place = np.repeat(at, np.diff(np.append(starts, len(least))))
        # Later windows of the run have passed it; the hash occurs again for them.
        late = np.flatnonzero(place < np.arange(len(least)))
        if len(late):
            among = np.isin(h, least[late])
            where = np.flatnonzero(among)
            order = np.lexsort((where, h[where]))
            where, value = where[order], h[where[order]]
            base = np.searchsorted(value, least[late])
            group = np.searchsorted(value, least[late], side="right")
            # Within the places of its hash, in order, the first that isn't before the window.
            rank = np.searchsorted(where + len(h) * np.unique(value, return_inverse=True)[1], late + len(h) * np.searchsorted(np.unique(value), least[late]))
            place[late] = where[np.clip(rank, base, group - 1)]
        window = np.flatnonzero(whole[i : i + len(least)])
        place, least, window = place[window] + i, least[window], window + i
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(place)) - 1 if len(place) else first
        blocks.append((least[first], place[first], window[first], window[last]))
    if blocks:
        found = [np.concatenate([b[k] for b in blocks]) for k in range(4)]
    least, place, first, last = found
    run = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)  # a phrase over two blocks is one
    return least[run], place[run], first[run], last[np.append(run[1:], len(place)) - 1] if len(run) else last


class Bucket:
    """The parse of a bucket: its texts in order, one after the other, and their phrases; places count from the first text."""

    def __init__(self, data: pa.Table) -> None:
        release()
        ids = data.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy() if data.num_rows else np.zeros(0, np.int64)
        rids = data.column("rid").to_numpy()
        self.order = np.lexsort((rids, ids))
        self.ids, self.rids = ids[self.order], rids[self.order]
        texts = data.column("text").to_pylist()
        parts = [texts[i].encode() for i in self.order]
        self.edges = np.concatenate([[0], np.cumsum(np.array([len(x) for x in parts], np.int64))]).astype(np.int64)
        self.raw = b"".join(parts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.hash, self.place, self.first, self.last = triggers(self.data, self.edges)
        self.text = np.searchsorted(self.edges, self.first, side="right") - 1

    def phrase(self, i: int) -> bytes:
        return self.raw[self.first[i] : self.last[i] + LENGTH]


def _lists(layout: Layout):
    def run(key, data):
        part, rest, counts, _ = split_keys(Bucket(data).hash, layout)
        return lists(key[0].as_py(), part, rest, counts)

    return run


PHRASES = "deal int, bucket int, hash binary, text binary, id binary, rid binary, first binary, place binary, sizes binary, bytes binary, spread boolean"
REPEATS = "bucket int, text binary, first binary, last binary"


def _phrases(layout: Layout, deals: int):
    def run(key, data, answers):
        """The distinct phrases of the bucket whose triggers occur again, dealt by their triggers; strings of triggers that are everywhere, dealt by their hashes."""
        bucket, parse = key[0].as_py(), Bucket(data)
        total = answered(answers)[split_keys(parse.hash, layout)[3]] if len(parse.hash) else np.zeros(0, np.float32)
        rows: dict[str, list] = {name.split(" ")[0]: [] for name in PHRASES.split(", ")}

        def send(deal, hashes, text, first, place, sizes, data_of, spread):
            order = np.argsort(deal, kind="stable")
            edges = np.flatnonzero(np.diff(deal[order], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(order))[: len(edges)], strict=True):
                some = order[a:b]
                values = (int(deal[some[0]]), bucket, hashes[some].tobytes(), text[some].astype(np.int32).tobytes(), parse.ids[text[some]].tobytes(), parse.rids[text[some]].tobytes(), first[some].astype(np.int64).tobytes(), place[some].astype(np.uint8).tobytes(), sizes[some].astype(np.uint8).tobytes(), data_of(some), spread)
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)

        new, _ = _distinct(parse, total > 1)
        common = total[new] >= SPREAD
        some = new[~common]
        send((parse.hash[some] % np.uint64(deals)).astype(np.int64), parse.hash[some], parse.text[some], parse.first[some] - parse.edges[parse.text[some]], parse.place[some] - parse.first[some], parse.last[some] - parse.first[some] + LENGTH, lambda at, some=some: b"".join(parse.phrase(i) for i in some[at]), False)
        wide = new[common]
        count = parse.last[wide] - parse.first[wide] + 1
        text = np.repeat(parse.text[wide], count)
        start = np.repeat(parse.first[wide] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        code = rolling(parse.data, LENGTH)[start] if len(start) else np.zeros(0, np.uint64)
        nothing = np.zeros(len(text), np.int64)
        send((code % np.uint64(deals)).astype(np.int64), code, text, start - parse.edges[text], nothing, nothing, lambda at: b"".join(parse.raw[i : i + LENGTH] for i in start[at].tolist()), True)
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), (pa.int32(), pa.int32(), *[pa.binary()] * 8, pa.bool_()), strict=True)})

    return run


def _distinct(parse: Bucket, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases `among`, the first place of each distinct one, and the other places."""
    offset, at = parse.place - parse.first, np.flatnonzero(among)
    _, inverse, counts = np.unique(parse.hash[at], return_inverse=True, return_counts=True)
    alone = counts[inverse] == 1
    seen: set[tuple[int, bytes]] = set()
    new, old = [], []
    for i in at[~alone].tolist():
        key = (int(offset[i]), parse.phrase(i))
        if key in seen:
            old.append(i)
        else:
            seen.add(key)
            new.append(i)
    return np.sort(np.concatenate([at[alone], np.array(new, np.int64)])), np.array(old, np.int64)


def _resolve(data):
    """Of the phrases of one deal, the strings that also start earlier: runs (text, first, last) for each bucket."""
    found = []
    for spread in (False, True):
        rows = [r for r in data.to_pylist() if r["spread"] == spread]
        if not rows:
            continue
        joined = lambda name, kind, rows=rows: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        text, first = joined("text", np.int32), joined("first", np.int64)
        bucket = np.repeat(np.array([r["bucket"] for r in rows], np.int32), [len(r["text"]) // 4 for r in rows])
        content = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        earlier = np.lexsort((first, joined("rid", np.int64), joined("id", np.int64)))
        if spread:
            strings = np.unique(content.view(f"S{LENGTH}")[earlier], return_inverse=True)[1]
            order = np.argsort(strings, kind="stable")
            at = earlier[order[1:][strings[order[1:]] == strings[order[:-1]]]]
            found.append((bucket[at], text[at], first[at]))
            continue
        place, sizes = joined("place", np.uint8).astype(np.int64), joined("sizes", np.uint8).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        for some in _triggered(joined("hash", np.uint64)[earlier]):
            at = earlier[some]
            phrase, offset = repeated(content, begins[at], sizes[at], place[at])
            found.append((bucket[at[phrase]], text[at[phrase]], first[at[phrase]] + offset))
    bucket, text, start = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]).astype(np.int64) for k in range(3))
    order = np.lexsort((start, text, bucket))
    bucket, text, start = bucket[order], text[order], start[order]
    run = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)])[: len(order)])
    last = start[np.append(run[1:], len(order)) - 1] if len(run) else run
    edges = np.flatnonzero(np.diff(bucket[run], prepend=-1))
    ends = np.append(edges[1:], len(run))[: len(edges)]
    cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary())
    return pa.table({"bucket": pa.array(bucket[run][edges], pa.int32()), "text": cut(text[run].astype(np.int32)), "first": cut(start[run]), "last": cut(last)})


def _triggered(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The phrases of triggers that have several, whole triggers and about SORTED phrases at a time, each time in their order."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    groups = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    counts = np.diff(np.append(groups, len(order)))
    order, counts = order[np.repeat(counts > 1, counts)], counts[counts > 1]
    ends = np.cumsum(counts)
    start = 0
    while start < len(order):
        end = int(ends[min(np.searchsorted(ends, start + SORTED), len(ends) - 1)])
        yield np.sort(order[start:end])
        start = end


def _sorted(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their bytes, and the length of the prefix that each shares with the one before it (-1 for the first)."""
    order = np.argsort(strings.view(f"S{strings.shape[1]}").ravel())
    common = np.full(len(order), -1, np.int64)
    for i in range(0, len(order) - 1, 1 << 13):
        differ = strings[order[i + 1 : i + 1 + (1 << 13)]] != strings[order[i : i + (1 << 13)]][: len(order) - 1 - i]
        common[i + 1 : i + 1 + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, common


def repeated(content: np.ndarray, begins: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and offsets of the strings that stand in an earlier phrase too. Phrase i has sizes[i] bytes of the content from begins[i], its trigger at place[i]; phrases are in the order of the corpus."""
    n, trigger = len(begins), begins + place
    after, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for i in range(0, n, 1 << 13):
        part = slice(i, i + (1 << 13))
        for held, step, most in ((after, np.arange(LENGTH), sizes - place), (before, -1 - np.arange(WINDOW), place)):
            at = np.clip(trigger[part, None] + step, 0, len(content) - 1)
            held[part] = np.where(np.arange(held.shape[1]) < most[part, None], content[at], 0)
    (parse, parse_common), (dictionary, dictionary_common) = _sorted(after), _sorted(before)
    del after, before
    bits = np.uint64(max(1, n.bit_length()))
    ahead, behind, index = np.empty(n, np.uint64), np.empty(n, np.uint64), np.arange(n, dtype=np.uint64)
    phrases, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for distance in range(WINDOW):
        # Bytes beyond a phrase's end are 0 in the sorted rows, but phrases that hold a string at this distance have all that it needs.
        holds = (distance <= place) & (place - distance <= sizes - LENGTH)
        if np.count_nonzero(holds) < 2:
            continue
        ahead[parse] = np.cumsum(parse_common < LENGTH - distance)
        behind[dictionary] = np.cumsum(dictionary_common < distance)
        key = np.sort((((behind << bits) | ahead) << bits | index)[holds])
        again = key[1:][key[1:] >> bits == key[:-1] >> bits]
        phrase = (again & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        phrases.append(phrase)
        offsets.append(place[phrase] - distance)
    return np.concatenate(phrases), np.concatenate(offsets)


RESULT = "doc_id {}, rid long, kept binary, spans array<struct<start:long,end:long>>"


def _remove(data, repeats):
    parse = Bucket(data)
    change = np.zeros(len(parse.data) + 1, np.int64)
    _, old = _distinct(parse, np.ones(len(parse.hash), bool))
    joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in repeats.column(name).to_pylist())])
    base = parse.edges[joined("text", np.int32)]
    np.add.at(change, np.concatenate([parse.first[old], base + joined("first", np.int64)]), 1)
    np.add.at(change, np.concatenate([parse.last[old], base + joined("last", np.int64)]) + LENGTH, -1)
    gone = np.cumsum(change) > 0
    kept, spans = [], []
    for start, end in zip(parse.edges, parse.edges[1:], strict=False):
        mask = gone[start:end]
        kept.append(parse.data[start:end][~mask].tobytes() if mask.any() else parse.raw[start:end])
        turn = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)) if mask.any() else []
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
    back = np.argsort(parse.order)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": data.column("doc_id"), "rid": data.column("rid"), "kept": pa.array([kept[i] for i in back], pa.binary()), "spans": pa.array([spans[i] for i in back], kind)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, rid, kept binary and spans (removed bytes, start and end) of every row and whole text.

    A byte goes if a string of LENGTH bytes that covers it starts earlier too: in
    a row with a smaller doc_id, or earlier in the same row. Rows without an id
    come last, and ties (repeated rows) are in the table's order, so one of them
    stays. Null and empty texts have no bytes; shorter texts than LENGTH stay
    whole. An empty table gives an empty result; only doc_id and text are read.
    rid numbers the rows in more than one job, so docs must be a scan, or another
    frame whose rows keep their order.
    """
    dealt, layout = bucketed(docs, 1 / 28)
    counts = counted_lists(dealt.groupBy("bucket").applyInArrow(_lists(layout), LISTS), layout)
    deals = max(layout.partitions, layout.buckets)
    phrases = dealt.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_phrases(layout, deals), PHRASES)
    repeats = phrases.repartition(deals, "deal").groupBy("deal").applyInArrow(_resolve, REPEATS)
    return dealt.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_remove, RESULT.format(docs.schema["doc_id"].dataType.simpleString()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
