"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame operations only.

A window of a text is as many words as an item has. Windows that can hold an
item lie where enough of the text's shingles are shingles of that item; each of
them gets a 64-bit SimHash. Two fingerprints within RADIUS bits of each other
agree in one of eight bytes but for two bits, so an index over the items' bytes
with up to two bits flipped finds every such pair. The exact weighted Jaccard
similarity of the shingles (a shingle weighs as often as it occurs) decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import cut, table

WORDS = 5
THRESHOLD = 0.8
#: At the threshold fingerprints differ by 10 bits on average, with a standard deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Part of an item's shingles that a window must share to be fingerprinted; 0.8 of them is the least that the threshold allows.
SEED = 0.75
#: Bytes up to which a side is broadcast; beyond that the join shuffles. A row's columns of fixed width count as ROW_BYTES.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Scripts written without spaces.
SOLO = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"

#: The counters of four bits, 16 bits each, for every value of the four.
LANES = [sum(((v >> i) & 1) << (16 * i) for i in range(4)) for v in range(16)]
#: The bytes that differ from 0 by two bits at most.
FLIPS = [v for v in range(256) if v.bit_count() <= RADIUS // BLOCKS]


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case, joined by single spaces; in scripts that are written without spaces each character is one."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, f"([{SOLO}])", " $1 "), r"[^\p{L}\p{N}]+", " "))


def shingles(words: Column, k: int) -> Column:
    """The runs of k words by their place: a lookahead takes the run, the match one word. It starts at words alone and gives no letter back, so a word of any length takes time in proportion."""
    return F.regexp_extract_all(words, F.lit(rf"(?<!\S)(?=((?:\S++ ){{{k - 1}}}\S++))\S++"), F.lit(1))


def hashed(runs: Column) -> Column:
    return F.transform(runs, lambda x: F.xxhash64(x))


def simhash(hashes: Column) -> Column:
    """64 bits: each is the majority of that bit over the hashes, which count as often as they occur. A tie is 0."""
    lanes = F.array(*[F.lit(v) for v in LANES])
    start = F.array_repeat(F.lit(0).cast("long"), 16)
    counted = F.aggregate(hashes, start, lambda a, x: F.transform(a, lambda v, j: v + F.get(lanes, _nibble(x, j))))
    most = F.size(hashes).cast("long")
    bit = lambda v, i: F.when(F.shiftright(v, 16 * i).bitwiseAND(F.lit(0xFFFF)) * 2 > most, F.lit(1 << i)).otherwise(0)
    nibbles = F.transform(counted, lambda v: reduce(lambda a, b: a + b, [bit(v, i) for i in range(4)]).cast("long"))
    return reduce(lambda a, j: a.bitwiseOR(F.shiftleft(F.get(nibbles, F.lit(j)), 4 * j)), range(1, 16), F.get(nibbles, F.lit(0)))


def _nibble(x: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, (j * 4).cast("int")).bitwiseAND(F.lit(15)).cast("int")


def _sized(df: DataFrame, entries: Column | int = 0) -> DataFrame:
    """The frame, to be broadcast if its rows and the entries of its arrays, 8 bytes each, take few enough bytes."""
    wide = entries if isinstance(entries, Column) else F.lit(entries)
    size = df.agg(F.coalesce(F.sum(ROW_BYTES + 8 * wide.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _shared(a: Column, b: Column) -> Column:
    """The size of the intersection of two bags."""
    same = F.array_intersect(a, b)
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    often = F.aggregate(same, F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(once, F.size(same)).otherwise(often)


def _hits(rows: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, item_id, similarity, start) over items whose shingles have k words."""
    items = cut(items.select("item_id", hashed(shingles(F.col("words"), k)).alias("item")).withColumn("n", F.size("item")))
    keys = cut(items.select("item_id", "n", F.explode(F.array_distinct("item")).alias("key")))
    places = rows.select("doc_id", "mark", F.posexplode(shingles(F.col("words"), k)).alias("at", "run")).select("doc_id", "mark", "at", F.xxhash64("run").alias("key"))
    found = places.join(_sized(keys), "key").groupBy("doc_id", "mark", "item_id", "n").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most a text's words
    need = F.ceil(F.col("n") * SEED).cast("int")
    seeds = found.where(F.size("at") >= need).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("item_id", "n", "at")).alias("seeds"))
    seeds = cut(seeds.withColumnsRenamed({"doc_id": "of", "mark": "of_mark"}))
    texts = rows.join(_sized(seeds, F.aggregate("seeds", F.lit(0), lambda n, x: n + F.size(x["at"]) + 4)), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")))
    near = texts.select("doc_id", "mark", hashed(shingles(F.col("words"), k)).alias("all"), F.explode("seeds").alias("seed")).select("doc_id", "mark", "all", "seed.*")
    size, need = F.least("n", F.size("all")), F.ceil(F.col("n") * SEED).cast("int")
    begins = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - need), lambda i: _range(F.greatest(F.lit(0), F.get("at", i + need - 1) - size + 1), F.least(F.get("at", i), F.size("all") - size))))
    windows = near.select("doc_id", "mark", "n", F.explode(F.transform(F.array_distinct(begins), lambda s: F.struct(s.alias("start"), F.slice("all", s + 1, size).alias("window")))).alias("w")).select("doc_id", "mark", "n", "w.*")
    windows = windows.withColumn("print", simhash(F.col("window")))
    probes = windows.withColumn("block", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(F.col("print"), i).alias("v")) for i in range(BLOCKS)])))
    index = items.withColumn("item_print", simhash(F.col("item")))
    index = cut(index.withColumn("block", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(F.col("item_print"), i).alias("v")) for i in range(BLOCKS)]))))
    index = index.withColumn("flip", F.explode(F.array(*[F.lit(v) for v in FLIPS]))).select("item_id", "item", "item_print", F.col("n").alias("item_n"), F.col("block.i").alias("item_i"), F.col("block.v").bitwiseXOR(F.col("flip")).alias("item_v"))
    candidates = probes.join(_sized(index, F.size("item")), (F.col("n") == F.col("item_n")) & (F.col("block.i") == F.col("item_i")) & (F.col("block.v") == F.col("item_v")))
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    # A pair that several blocks find is verified in the first of them.
    first = reduce(lambda rest, i: F.when(F.bit_count(_block(F.col("print"), i).bitwiseXOR(_block(F.col("item_print"), i))) <= RADIUS // BLOCKS, F.lit(i)).otherwise(rest), reversed(range(BLOCKS)), F.lit(-1))
    shared = _shared(F.col("window"), F.col("item"))
    verified = candidates.where(within & (F.col("block.i") == first)).withColumn("similarity", F.round(shared / (F.size("window") + F.size("item") - shared), 6)).where(F.col("similarity") >= THRESHOLD)
    best = verified.groupBy("doc_id", "mark", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("place"))).alias("best"))
    return best.select("doc_id", "mark", "item_id", "best.similarity", (-F.col("best.place")).cast("long").alias("start"))


def _range(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_id, similarity, start): each item that a text holds, with its best window's first word. mark: a hash of the text, which tells rows of one id apart.

    An item of fewer than five words is one shingle. A text shorter than the
    item is one window. Null and blank texts and items match nothing; repeated
    rows of either table give one hit; null ids stay null; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words"))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("words <> ''").distinct().withColumn("k", F.least(F.lit(WORDS), F.size(F.split("words", " "))))
    items = cut(items)
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # five at most
    parts = [_hits(rows, items.where(F.col("k") == k), k) for k in lengths]
    if not parts:
        return docs.select("doc_id", F.lit(0).cast("long").alias("mark")).limit(0).join(benchmark.select("item_id").limit(0)).select("doc_id", "mark", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start"))
    return reduce(DataFrame.unionByName, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\pL\pN]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\pL\pN]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM d),
bs AS (SELECT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM b),
dx AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM ds),
bx AS (SELECT item_id, unnest(s) AS x FROM bs),
bn AS (SELECT item_id, x, count(*) AS n FROM bx GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id FROM dx JOIN bn USING (x)),
w AS (SELECT doc_id, item_id, unnest(range(0, greatest(1, len(ds.s) - len(bs.s) + 1))) AS start, least(len(bs.s), len(ds.s)) AS size, len(bs.s) AS items
      FROM pairs JOIN ds USING (doc_id) JOIN bs USING (item_id)),
near AS (SELECT DISTINCT w.* FROM w JOIN dx ON dx.doc_id = w.doc_id AND dx.p > w.start AND dx.p <= w.start + w.size JOIN bn ON bn.item_id = w.item_id AND bn.x = dx.x),
c AS (SELECT near.doc_id, near.item_id, start, size, items, dx.x, count(*) AS n FROM near JOIN dx ON dx.doc_id = near.doc_id AND dx.p > start AND dx.p <= start + size GROUP BY ALL),
i AS (SELECT c.doc_id, c.item_id, start, size, items, sum(least(c.n, bn.n)) AS shared FROM c JOIN bn ON bn.item_id = c.item_id AND bn.x = c.x GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, round(shared / (size + items - shared), 6) AS similarity FROM i)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start)) AS start FROM j WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item, with all the columns of docs."""
    found = cut(hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).distinct())
    return docs.join(_sized(found), docs["doc_id"].eqNullSafe(F.col("of")) & (F.xxhash64(docs["text"]) == F.col("of_mark")), "left_anti")
