"""Language identification of mixed text: script ranges, word scores, Viterbi.

A word's script narrows the languages it can be in. Over these, a word known
from training scores by its frequency, any word by its character trigrams;
Viterbi with a penalty for each switch then labels the words, and runs of one
label are spans. A text's language is the one with most letters.

Long texts are cut into segments that all run in step: a segment's transfer
matrix says how each language at its start leads to each at its end, so the
segments of a text are linked without walking through its words one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import arrow_map, column_of, hold, table

# The main Unicode ranges of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F)),
}

#: Labelled rows of each language that a fit takes, on average (a hash of the id chooses them).
TRAIN_ROWS = 1000
#: Languages that a model learns, the most frequent first, and UTF-8 bytes that a fit takes of all of them, on average.
LANGUAGES, TRAIN_BYTES = 200, 256 << 20
#: Words and trigrams that a model keeps, the most frequent first.
MODEL_WORDS = 40_000
MODEL_TRIGRAMS = 60_000
#: Words whose scores a worker remembers; beyond that it starts anew.
REMEMBERED = 150_000
#: Log score of a change of language between two words.
SWITCH = 8.0
#: The most that a single word can say against a language.
LEAST = -12.0
#: Words to a segment.
SEGMENT = 512
#: Share of a language's training words in a script from which it is a candidate there.
SCRIPT_SHARE = 0.01


def script_of(word: str) -> str:
    code = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def split_words(texts: pa.Array) -> pa.ListArray:
    """The maximal runs of letters in lower case; ends may give empty words."""
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " "))


class Model:
    def __init__(self, languages: list[str], words: dict[str, int], word_scores: np.ndarray, trigrams: dict[str, int], trigram_scores: np.ndarray, allowed: dict[str, np.ndarray]) -> None:
        self.languages, self.words, self.word_scores, self.trigrams, self.trigram_scores, self.allowed = languages, words, word_scores, trigrams, trigram_scores, allowed

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        parts = [split_words(pa.array([t for t, x in zip(texts, labels, strict=True) if x == name], pa.string())).flatten().value_counts() for name in languages]
        counts: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = {}
        in_script: dict[str, np.ndarray] = {}
        for k, part in enumerate(parts):
            for word, n in zip(part.field("values").to_pylist(), part.field("counts").to_pylist(), strict=True):
                if word:
                    counts.setdefault(word, np.zeros(len(languages)))[k] += n
                    in_script.setdefault(script_of(word), np.zeros(len(languages)))[k] += n
                    padded = f" {word} "
                    for i in range(len(padded) - 2):
                        grams.setdefault(padded[i : i + 3], np.zeros(len(languages)))[k] += n
        known = lambda table, most: {x: i for i, x in enumerate(sorted(table, key=lambda x: (-table[x].sum(), x))[:most])}
        words, trigrams = known({w: c for w, c in counts.items() if c.sum() > 2}, MODEL_WORDS), known(grams, MODEL_TRIGRAMS)

        def scores(table: dict, index: dict, extra: int) -> np.ndarray:
            """Log shares within each language; `extra` rows for what isn't known."""
            all_of = np.array([table[x] for x in index]).reshape(len(index), len(languages))
            total = sum(table.values(), np.zeros(len(languages)))
            smooth = np.concatenate([all_of, np.zeros((extra, len(languages)))]) + 0.1
            return np.log(smooth / (total + 0.1 * (len(index) + 1))).astype(np.float32)

        share = {s: n / np.maximum(1, sum(in_script.values())) for s, n in in_script.items()}
        return cls(languages, words, scores(counts, words, 0), trigrams, scores(grams, trigrams, 1), {s: x >= SCRIPT_SHARE for s, x in share.items() if (x >= SCRIPT_SHARE).any()})

    def score(self, words: list[str]) -> np.ndarray:
        """A row of log scores for each word, the best language at 0."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)), np.float32)
        get, unknown, ids, edges = self.trigrams.get, len(self.trigrams), [], [0]
        for word in words:
            padded = f" {word} "
            ids += [get(padded[i : i + 3], unknown) for i in range(len(padded) - 2)]
            edges.append(len(ids))
        out = np.add.reduceat(self.trigram_scores[ids], edges[:-1], axis=0)
        at = np.array([self.words.get(w, -1) for w in words])
        out[at >= 0] += self.word_scores[at[at >= 0]]
        scripts = [script_of(w) for w in words]
        for script in set(scripts):
            if (may := self.allowed.get(script)) is not None and not may.all():
                rows = np.array([s == script for s in scripts])
                out[np.ix_(rows, ~may)] = -np.inf
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, LEAST)


def viterbi(scores: np.ndarray, edges: np.ndarray, switch: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """The best label of each word: the sum of its scores less `switch` for each change. Text i has the words edges[i] to edges[i + 1]; ties go to the first language, and to no change."""
    words, languages = scores.shape
    labels = np.zeros(words, np.int8 if languages < 128 else np.int16)
    if not words:
        return labels
    sizes = np.diff(edges)
    pieces = -(-sizes // segment)
    text = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = edges[:-1][text] + number * segment
    lengths = np.minimum(segment, edges[1:][text] - begins)
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin, length = begins[order], lengths[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes that have a word number t

    def forward(value: np.ndarray, lanes: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Values (lane, ..., language) after the lanes' words; back gets where each came from."""
        for t in range(int(length[lanes[0]]) if len(lanes) else 0):
            n = len(lanes) if len(lanes) < len(order) and length[lanes[-1]] > t else (active[t] if len(lanes) == len(order) else int(np.searchsorted(-length[lanes], -t, side="left")))
            now = value[:n]
            top = now.max(axis=-1, keepdims=True) - switch
            at = begin[lanes[:n]] + t
            if back is not None:
                stay = now >= top
                back[at] = np.where(stay, np.arange(languages), now.argmax(axis=-1)[..., None])
            s = scores[at]
            value[:n] = np.maximum(now, top) + (s[:, None] if now.ndim == 3 else s)
        return value

    enter = np.zeros((len(order), languages), np.float32)
    many = np.flatnonzero(pieces > 1)
    if len(many):
        lanes = np.sort(place[np.isin(text, many)])
        start = np.where(np.eye(languages, dtype=bool), np.float32(0), np.float32(-1e30))
        across = forward(np.repeat(start[None], len(lanes), axis=0), lanes)
        row = {int(lane): i for i, lane in enumerate(lanes)}
        first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
        for i in many:
            value = np.zeros(languages, np.float32)
            for piece in range(pieces[i]):
                lane = place[first[i] + piece]
                value = value - value.max()
                enter[lane] = value
                value = (value[:, None] + across[row[int(lane)]]).max(axis=0)
    back = np.empty((words, languages), labels.dtype)
    last = forward(enter.copy(), np.arange(len(order)), back)

    # Backwards from every language at each segment's end; the texts' ends then say which of these paths holds.
    paths = np.empty((words, languages), labels.dtype)
    state = np.repeat(np.arange(languages)[None], len(order), axis=0)
    for t in range(int(length[0]) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        paths[at] = state[:n]
        state[:n] = np.take_along_axis(back[at].astype(np.int64), state[:n], axis=1)
    end = last.argmax(axis=1)
    if len(many):
        for i in many:
            for piece in range(pieces[i] - 1, 0, -1):
                lane = place[first[i] + piece]
                end[place[first[i] + piece - 1]] = state[lane, end[lane]]
    of_word = np.repeat(end[place], lengths)
    return np.take_along_axis(paths, of_word[:, None].astype(np.int64), axis=1)[:, 0]


class Labeller:
    """A model and the words a worker has scored so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.row = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.row.clear()
            self.scores = self.scores[:0]
        new = [w for w in words if w not in self.row]
        self.row.update((w, i) for i, w in enumerate(new, len(self.row)))
        self.scores = np.concatenate([self.scores, self.model.score(new)])
        return np.array([self.row[w] for w in words], np.int64)

    def label(self, texts: pa.Array) -> list[pa.Array]:
        """Language, score and spans (first word, word after the last, language) of each text."""
        split = split_words(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        held, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        real = np.array([bool(w and self.model.languages) for w in held] + [False])[code]
        inside = np.concatenate([[0], np.cumsum(real)])
        edges = inside[split.offsets.to_numpy()]
        rows = self.rows([w for w in held if w])
        index = np.zeros(len(held) + 1, np.int64)
        index[[i for i, w in enumerate(held) if w]] = rows
        letters = np.array([len(w) for w in held] + [0])[code[real]] if len(held) else np.zeros(0)
        n, k = len(texts), len(self.model.languages)
        labels = viterbi(self.scores[index[code[real]]], edges) if k else np.zeros(0, np.int8)
        text = np.repeat(np.arange(n), np.diff(edges))
        share = np.bincount(text * k + labels, letters, n * k).reshape(n, k)
        total, best = share.sum(axis=1), share.argmax(axis=1) if k else np.zeros(n, int)
        names = np.array([*self.model.languages, "und"], dtype=object)
        starts = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])])) if len(labels) else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [len(labels)]])[: len(starts)]
        spans = pa.StructArray.from_arrays([pa.array((starts - edges[text[starts]]).astype(np.int32)), pa.array((ends - edges[text[starts]]).astype(np.int32)), pa.array(names[labels[starts]] if len(starts) else [], pa.string())], ["start", "end", "lang"])
        of = np.searchsorted(text[starts] if len(starts) else np.zeros(0), np.arange(n + 1)).astype(np.int32)
        return [pa.array(names[np.where(total > 0, best, k)], pa.string()), pa.array(np.where(total > 0, share.max(axis=1, initial=0) / np.maximum(total, 1), 0.0)), pa.ListArray.from_arrays(of, spans)]


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, languages: int = LANGUAGES, most: int = TRAIN_BYTES) -> Model:
    """A model of the labelled texts: about `rows` of each language, chosen by a hash of the id. Null languages and texts don't count.

    A dirty `lang` column or very long texts don't fill the driver: the
    `languages` with most rows are learned, and fewer whole texts are taken of a
    language whose part of `most` bytes they would exceed.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    held = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not held:
        return Model.fit([], [])
    unit = 1 << 30
    share = F.create_map(*[x for r in held for x in (F.lit(r["lang"]), F.lit(int(unit * min(1.0, rows / r["n"], most / len(held) / max(1, r["bytes"])))))])
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(unit)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0))
    sample = known.where(chosen).toArrow()
    return Model.fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row and whole text; with `whole`, `row` (the input row) takes the place of doc_id.

    `und` with score 0 and no spans where the text is null or has no letter, or
    the model knows no language. The score is the share of the text's letters
    in spans of lang_pred. Rows stay as they are, repeated ones too; other
    columns are ignored.
    """
    key = ("language", hash((tuple(model.languages), len(model.words), model.word_scores.tobytes())))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_WORDS and MODEL_TRIGRAMS

    def make():
        labeller = hold(key, lambda: Labeller(shared.value))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(carried), *labeller.label(column_of(batch, text))], [carried, "lang_pred", "score", "spans"])

        return work

    chosen = docs.select(F.struct(*docs.columns).alias("row")) if whole else docs.select("doc_id", "text")
    carried, text = ("row", "row.text") if whole else ("doc_id", "text")
    schema = T.StructType([chosen.schema[carried]]).simpleString()[len("struct<") : -1]
    return arrow_map(chosen, make, f"{schema}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>", text)


def held_out() -> Column:
    """Whether a row is kept from training; rows without an id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a language; those that have no letter go."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model, whole=True).where(F.col("lang_pred") != "und").select("row.*")
