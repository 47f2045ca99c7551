"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle (five words) weighs its count in the text times its inverse document
frequency in the whole corpus. Consistent weighted samples of a text, three to a
band, make candidates of texts that share a band; weighted Jaccard similarity
decides. Classes are the connected components of the links.

What keeps it linear: texts of the same words are one node; a text whose shared
shingles (those in two documents or more) weigh less than the threshold's part
of it can't have a partner and draws no samples; and a band's bucket is never
expanded into pairs. There, every member is compared with one pivot, the one
that meets most others, as the original of a group of copies does. Members that
this leaves outside the pivot's class become pivots in the next rounds, FIRST in
a bucket and then MORE times as many in each, until none is left; a round reads
only the buckets that have some. Pairs of one class need no comparison, nor do
pairs whose shared shingles weigh too little for the threshold, however they
overlap; all other members of a bucket are compared. From the second round on,
where the copies of a large group that are just below the threshold to each
other would all be compared, the shingles' weights in GROUPS groups by their
hashes tell more: what two texts share weighs no more than the lesser of their
weights in each group, summed. No link is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.buckets import LISTS, Layout, answered, bucketed, counted_lists, lists, split_keys
from weft.llm.common import cut, picked, release, setting, settle, table, tidy, trim

WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with a chance of (1 - 0.8 ** 3) ** 14 = 4e-5.
BANDS, ROWS = 14, 3
#: Pivots of a bucket in the second round, and times as many in each round after it.
FIRST, MORE = 8, 64
#: Groups of shingles in the bound on what two texts share.
GROUPS = 64
#: Pairs to an Arrow batch, as two texts' shingles may be long.
PAIRS = 256
#: Bytes of a shingle's fingerprint in the comparison of two texts.
PRINT = 5

#: Bytes of text that are split into words at a time, and shingles that are worked on at a time.
SLICE, CHUNK = 1 << 20, 1 << 17
#: Scripts written without spaces.
SOLO = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"

MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about SLICE bytes, each with the number of its first text; a longer text alone, in parts that end before a character that is in no word, or a word by itself."""
    import regex

    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > SLICE:
            yield start, texts.slice(start, i - start)
            start, held = i, 0
        if n > SLICE:
            whole, at, edge = texts[i].as_py(), 0, regex.compile(rf"[^\pL\pN]|[{SOLO}]")
            while at < len(whole):
                found = edge.search(whole, at + SLICE)
                end = found.start() if found else len(whole)
                yield i, pa.array([whole[at:end]], pa.string())
                at = end
            start, held = i + 1, 0
        else:
            held += n
    if start < len(texts):
        yield start, texts.slice(start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, one text after the other, and how many words each has.

    Words are runs of letters and digits in lower case; in scripts that are
    written without spaces each character is one.
    """
    import xxhash

    hashes, sizes = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for first, part in _parts(texts):
        part = pc.utf8_lower(part)
        if not pc.all(pc.string_is_ascii(part)).as_py():
            part = pc.replace_substring_regex(part, f"([{SOLO}])", r" \1 ")
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(part, r"[^\pL\pN]+", " "))
        coded = split.flatten().dictionary_encode()
        held, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        real = np.array([bool(w) for w in held] + [False])[code]
        hashes.append(np.array([xxhash.xxh3_64_intdigest(w) for w in held] + [0], np.uint64)[code[real]])
        sizes[first : first + len(part)] += np.diff(np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()])
    return np.concatenate(hashes), sizes


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' shingles in order, where each text's begin (and the last one's end), and two 64-bit hashes of each text's words.

    A text of fewer than five words is one shingle; one without words is one
    shingle of what it is but for the white space around it, so equal ones are
    alike.
    """
    import xxhash

    hashes, sizes = words(texts)
    number = np.maximum(1, sizes - WORDS + 1)
    edges, ends = np.concatenate([[0], np.cumsum(number)]), np.cumsum(sizes)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    value, whole = np.empty(edges[-1], np.uint64), np.zeros((2, len(texts)), np.uint64)
    empty = {int(i): xxhash.xxh3_64_intdigest(texts[int(i)].as_py().strip(), seed=1) for i in np.flatnonzero(sizes == 0)}
    for a in range(0, len(value), CHUNK):
        index = np.arange(a, min(a + CHUNK, len(value)))
        text = np.searchsorted(edges, index, side="right") - 1
        place = index - edges[text]
        start, end = place + (ends - sizes)[text], ends[text]
        some = np.full(len(index), 7, np.uint64)
        for k in range(WORDS):
            some = np.where(start + k < end, mixed(some * np.uint64(0x9E3779B97F4A7C15) + padded[np.minimum(start + k, len(hashes))]), some)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        for at in first[sizes[text[first]] == 0]:
            some[at] = empty[int(text[at])]
        value[a : a + len(some)] = some
        for k, step in enumerate((1, 2)):
            whole[k, text[first]] += np.add.reduceat(mixed(some + (place.astype(np.uint64) << np.uint64(step)) * MIX + np.uint64(k)), first)
    return value, edges, mixed(whole ^ number.astype(np.uint64))


def ranges(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, after the last) of about CHUNK entries."""
    first = 0
    while first < len(edges) - 1:
        after = max(first + 1, int(np.searchsorted(edges, edges[first] + CHUNK, side="right")) - 1)
        yield first, after
        first = after


def counted(value: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text in their order: where each text's begin, hashes, counts."""
    sizes, hashes, counts = np.zeros(len(edges) - 1, np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for a, b in ranges(edges):
        text = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(edges[a : b + 1]))
        v = value[edges[a] : edges[b]]
        v = v[np.lexsort((v, text))]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])]))
        sizes += np.bincount(text[first], minlength=len(sizes))
        hashes.append(v[first])
        counts.append(np.diff(np.append(first, len(v))).astype(np.int32))
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(hashes), np.concatenate(counts)


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the sampling's random numbers: r and ln c after Gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(5)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16).astype(np.float32)


def bands(value: np.ndarray, weight: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys. Text i has the distinct hashes value[edges[i]:edges[i + 1]], in order, with weights."""
    r_of, c_of, beta_of = draws()
    log_weight = np.log(weight).astype(np.float32)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keys = np.zeros((len(edges) - 1, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        at = (mixed(value + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(48)).astype(np.int64)
        r, beta = r_of[at], beta_of[at]
        t = np.floor(log_weight / r + beta)
        log_a = c_of[at] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, edges[:-1])
        hit = np.flatnonzero(log_a == least[text])
        hit = hit[np.concatenate([[True], text[hit][1:] != text[hit][:-1]])]
        sample = mixed(value[hit] + t[hit].astype(np.int64).astype(np.uint64) * MIX)
        band = k // ROWS
        keys[:, band] = mixed(keys[:, band] ^ sample + np.uint64(band + 1))
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' sorted fingerprints and weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def idf(documents: np.ndarray, rows: int) -> np.ndarray:
    """From 1 for a shingle of all documents to nearly 2 for one of a single document.

    The logarithm is taken as a part of its largest value. Left as it is, it
    would weigh the few words in which the copies of a large group differ
    several times as much as those they share, and the group would fall apart.
    """
    return (1 + np.log((1 + rows) / (1 + documents.astype(np.float64))) / np.log(1 + max(1, rows))).astype(np.float32)


def _lists(layout: Layout):
    def run(key, data):
        release()
        _, distinct, _ = counted(*shingles(_text(data))[:2])
        return lists(key[0].as_py(), *split_keys(distinct, layout)[:3])

    return run


def _text(data: pa.Table) -> pa.Array:
    return data.column("text").combine_chunks() if data.num_rows else pa.array([], pa.string())


#: What rounding may take from a sum of weights, as a part of it.
SLACK = 1e-4


def grouped(value: np.ndarray, weight: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(texts, GROUPS): the weight of each text's shingles in the groups that their hashes fall into."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    at = text * GROUPS + (value % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(at, weight, (len(edges) - 1) * GROUPS).astype(np.float32).reshape(-1, GROUPS)


NODES = "rid long, alike binary, weight double, shared double, prints binary, weights binary, bands array<long>, groups array<float>"


def _nodes(layout: Layout):
    def run(key, data, answers):
        """A row for each document; of those with the same words in the bucket, and those that can have a partner, the first has samples."""
        release()
        value, places, whole = shingles(_text(data))
        edges, v, n = counted(value, places)
        del value
        rows, sizes = data.num_rows, np.diff(edges)
        documents = answered(answers)[split_keys(v, layout)[3]]
        weight = idf(documents, layout.rows) * n.astype(np.float32)
        total, shared = np.zeros(rows), np.zeros(rows)
        for a, b in ranges(edges):
            some, text = weight[edges[a] : edges[b]], np.repeat(np.arange(b - a), sizes[a:b])
            total[a:b] = np.bincount(text, some, b - a)
            shared[a:b] = np.bincount(text, np.where(documents[edges[a] : edges[b]] > 1, some, 0), b - a)
        alike = np.ascontiguousarray(whole.T).view("V16").ravel()
        chosen = np.zeros(rows, bool)
        chosen[np.unique(alike, return_index=True)[1]] = True
        chosen &= shared >= (THRESHOLD - 1e-6) * total
        blobs = {name: [None] * rows for name in ("prints", "weights", "bands", "groups")}
        for a, b in ranges(edges):
            which = np.flatnonzero(chosen[a:b]) + a
            if not len(which):
                continue
            keep = np.repeat(chosen[a:b], sizes[a:b])
            some, heavy = v[edges[a] : edges[b]][keep], weight[edges[a] : edges[b]][keep]
            at = np.concatenate([[0], np.cumsum(sizes[which])])
            keys = bands(some, heavy, at)
            prints = (some >> np.uint64(64 - 8 * PRINT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT]
            groups = grouped(some, np.where(documents[edges[a] : edges[b]][keep] > 1, heavy, 0), at)
            for i, row in enumerate(which):
                first, after = at[i], at[i + 1]
                blobs["prints"][row], blobs["weights"][row], blobs["bands"][row], blobs["groups"][row] = prints[first:after].tobytes(), heavy[first:after].tobytes(), keys[i].view(np.int64), groups[i]
        columns = {"rid": data.column("rid"), "alike": pa.array([x.tobytes() for x in alike], pa.binary()), "weight": pa.array(total), "shared": pa.array(shared)}
        columns |= {"prints": pa.array(blobs["prints"], pa.binary()), "weights": pa.array(blobs["weights"], pa.binary()), "bands": pa.array(blobs["bands"], pa.list_(pa.int64()))}
        columns |= {"groups": pa.array(blobs["groups"], pa.list_(pa.float32()))}
        return pa.table(columns)

    return run


def _compare(batches):
    """Pairs with both texts' shingles to pairs with their similarity."""

    def read(prints: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(prints) // PRINT, 8), np.uint8)
        wide[:, :PRINT] = np.frombuffer(prints, np.uint8).reshape(-1, PRINT)
        return wide.view("<u8").ravel(), np.frombuffer(weights, np.float32)

    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        found, held, last = [], None, None
        for i in range(batch.num_rows):
            if (a := columns[0][i].as_py()) != last:
                last, held = a, read(columns[2][i].as_py(), columns[3][i].as_py())
            found.append(similarity(held, read(columns[4][i].as_py(), columns[5][i].as_py())))
        yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(found, pa.float64())], ["a", "b", "similarity"])
    trim()


#: Rows up to which a settled frame of an iteration is broadcast, so that what it is joined with isn't shuffled in every round.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """The settled frame, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of links (a, b). Each round takes the least label around and then that node's label, so long chains halve."""
    edges = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = edges.join(few(labels).select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = settle(few(labels).join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = few(nearer).select(F.col("node").alias("label"), F.col("label").alias("further"))
        nearer = settle(nearer.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = nearer.select("node", "label")
        if nearer.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (a, b): only links between different classes are followed."""
    if labels is None:
        return components(links)
    known = few(labels)
    of = lambda side: known.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    between = settle(between.where("a <> b").distinct())
    if between.isEmpty():
        return labels
    moved = settle(components(between).select(F.col("node").alias("label"), F.col("label").alias("to")))
    fresh = moved.join(known.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return settle(labels.join(few(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label")).union(fresh))


def common() -> Column:
    """The most that a member and its pivot may share: in each group of shingles, the lesser of their weights."""
    return F.aggregate(F.zip_with("groups", "pivot.groups", lambda a, b: F.least(a, b)), F.lit(0.0), lambda total, x: total + x)


def compared(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """Settled pairs (a, b) with their similarity. Where they are few, only the shingles of their texts are shuffled."""
    side = lambda of, held: held.select(F.col("node").alias(of), F.col("prints").alias(f"{of}_prints"), F.col("weights").alias(f"{of}_weights"))
    first = few(pairs)
    if pairs.count() <= FEW:
        shingled = shingled.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "node", "left_semi")
    full = side("b", shingled).join(first, "b").join(side("a", shingled), "a").select("a", "b", "a_prints", "a_weights", "b_prints", "b_weights")
    with setting(pairs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS)):
        return settle(full.mapInArrow(_compare, "a long, b long, similarity double"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: rid, doc_id, class_id, class_rid, class_size, kept.

    The class id is the smallest doc_id of the class (rows without an id come
    last; ties, as of repeated rows, go to one row), whose row is kept. Texts of
    the same words are one class; null and blank texts are alike. An empty
    table gives an empty result; only doc_id and text are read. The rows are
    read in more than one job, so docs must be a scan or another frame that
    gives its rows in the same order each time.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are made for a threshold of {THRESHOLD} or more")
    dealt, layout = bucketed(docs, 1 / 6)
    ids = dealt.select("rid", "doc_id")
    counts = counted_lists(dealt.groupBy("bucket").applyInArrow(_lists(layout), LISTS), layout)
    nodes = cut(dealt.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_nodes(layout), NODES))

    tidy(docs.sparkSession)  # the texts' shuffles

    # Copies by words are one node, named by the least rid among those with samples.
    named = nodes.where(F.col("bands").isNotNull()).groupBy("alike").agg(F.min("rid").alias("node"))
    nodes_of = named.withColumnRenamed("node", "rid")
    samples = cut(nodes.join(nodes_of, ["alike", "rid"], "left_semi").select(F.col("rid").alias("node"), "weight", "shared", "prints", "weights", "bands", "groups"))
    members = samples.select("node", "weight", "shared", "bands", F.posexplode("bands").alias("band", "key")).select("node", "weight", "shared", "bands", "band", F.xxhash64("band", "key").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(members.join(full, "bucket"))
    meets = members.groupBy("node").agg((-F.sum("n")).alias("order"))
    members = settle(members.drop("n").join(meets, "node"))
    tidy(docs.sparkSession)

    groups, shingled = samples.select("node", "groups"), samples.select("node", "prints", "weights")
    spark, labels, most = docs.sparkSession, None, 1
    # The shared shingles of the one that has less of them are the most that the two have in common.
    enough = (threshold - SLACK) * (F.col("weight") + F.col("pivot.weight"))
    least = (1 + threshold) * F.least("shared", "pivot.shared") >= enough
    # A pair meets in the first band that it shares; there too its members are compared before the rounds end.
    first = F.array_position(F.zip_with("bands", "pivot.bands", lambda a, b: a == b), True) == F.col("band") + 1
    while True:
        if labels is None:
            now, meets = members, (F.col("node") != F.col("pivot.node")) & least & first
            pivots = settle(members.groupBy("bucket").agg(F.min(F.struct("order", "node", "weight", "shared", "bands")).alias("pivot")))
            live = members.withColumn("done", F.lit(False))
        else:
            now = live.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
            heads = now.groupBy("bucket").agg(F.min(F.struct("order", "node", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            now = now.join(heads.select("bucket", F.col("head.node").alias("head"), F.col("head.label").alias("main")), "bucket")
            # The groups' weights are fetched once, for the open buckets alone.
            now = settle(now if "groups" in now.columns else now.join(groups, "node"))
            # A bucket's first pivot, its head, and the later ones have been compared with all that they meet.
            meets = (F.col("label") != F.col("pivot.label")) & ~F.col("done") & (F.col("node") != F.col("head")) & least & first & ((1 + threshold) * common() >= enough)
            most = FIRST if most == 1 else most * MORE
            waiting = now.where("label <> main and not done").withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("order", "node")))
            pivots = settle(waiting.where(F.col("rank") <= most).select("bucket", F.struct("node", "weight", "shared", "bands", "label", "groups").alias("pivot")))
            # A bucket without a pivot has none later, as classes only grow.
            seen = few(pivots.select("bucket", F.col("pivot.node").alias("node"), F.lit(True).alias("seen")))
            live = now.drop("label", "head", "main").join(seen.select("bucket"), "bucket", "left_semi").join(seen, ["bucket", "node"], "left").withColumn("done", F.col("done") | F.col("seen").isNotNull()).drop("seen")
        if pivots.isEmpty():
            break
        pairs = now.join(few(pivots), "bucket").where(meets)
        result = compared(settle(pairs.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()), shingled)
        labels = merge(labels, result.where(F.col("similarity") >= threshold - 1e-9))
        tidy(spark)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")

    by_words = named.join(labels, "node", "left").select("alike", F.coalesce("label", "node").alias("class"))
    kin = nodes.select("rid", "alike").join(by_words, "alike", "left")
    # Texts without samples have no partner but those of the same words.
    name = F.coalesce(F.concat(F.lit("n"), F.col("class").cast("string")), F.concat(F.lit("w"), F.hex("alike")))
    own = cut(ids.join(kin, "rid").select("rid", "doc_id", name.alias("class")))
    heads = own.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))).alias("head"), F.count("*").alias("class_size"))
    # Cut, so that the join has a shuffle of its own on either side: only then are a large class's partitions split.
    heads = cut(heads)
    return own.join(heads, "class").select("rid", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("head.rid").alias("class_rid"), "class_size", (F.col("rid") == F.col("head.rid")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, with all the columns of docs."""
    tidy(spark)  # what the stages before have left
    kept = classes(docs).where("kept")
    tidy(spark)  # what the classes were found by, before whole texts are shuffled again
    return picked(docs, kept)
