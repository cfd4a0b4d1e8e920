"""Brown class-based bigram language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .quality import held_out
from .runtime import stored

#: Words with a place of their own in the clustering, none longer than WORD_BYTES; the others share places by their endings. They
#: bound the model's size: a place is a number of 16 bits.
WORDS, ENDINGS, CLASSES, ROUNDS, WORD_BYTES = 60_000, 2_048, 64, 3, 48
CHUNK = 1024


def ending(words: pa.Array) -> np.ndarray:
    """A place for each word from its last three bytes: a fixed function, so that any task can place any word alone."""
    o = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(1, np.uint8)
    out = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        has = o[1:] - o[:-1] >= k
        out = out * np.uint64(257) + np.where(has, data[np.maximum(o[1:] - k, 0)], 256).astype(np.uint64)
    return (tk.mix(out) % np.uint64(ENDINGS)).astype(np.int64)


class Places:
    """Which place of the clustering a word has: its own, or its ending's."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts

    @property
    def end(self) -> int:
        return len(self.words) + ENDINGS

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and the count of those with a place of their own, else -1."""
        at = pc.index_in(words, value_set=pa.array(self.words, pa.large_binary())).to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), -1, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        own = at >= 0
        out = np.where(own, at, len(self.words) + ending(words))
        count = np.full(len(words), -1, np.int64)
        count[own] = self.counts[at[own]]
        return out, count


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training texts; each task counts runs of its texts before anything is shuffled."""

    def run(batches):
        for b in batches:
            data, offs = tk.flat(b.column(0))
            for _, _, d, o in tk.slices(data, offs, 4 << 20):
                w, _ = tk.words(d, o)
                coded = w.dictionary_encode()
                c = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(c)], names=["word", "c"])

    return docs.filter(~F.col("held_out")).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, places: Places) -> DataFrame:
    """Each text as places, what its frequent words add to the scores, and its other words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        p = sent.value
        for b in batches:
            data, offs = tk.flat(b.column(2))
            for lo, hi, d, o in tk.slices(data, offs):
                w, bounds = tk.words(d, o)
                n = hi - lo
                coded = w.dictionary_encode()
                place, count = p.of(coded.dictionary)
                u = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), np.diff(bounds))
                own = count[u] >= 0
                logs = np.log10(np.maximum(count, 0) + 0.1)[u]
                tail, times = np.unique(row[~own] * max(len(coded.dictionary), 1) + u[~own], return_counts=True)
                cut = np.searchsorted(tail // max(len(coded.dictionary), 1), np.arange(n + 1)).astype(np.int32)
                ids = place[u].astype("<u2")
                view = ids.tobytes()
                words = coded.dictionary.take(pa.array(tail % max(len(coded.dictionary), 1))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(np.diff(bounds) + 1), pa.array([view[2 * x : 2 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
                        pa.array(np.bincount(row[own], logs[own], n).astype(np.float64)), pa.array(np.bincount(row[own], minlength=n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cut), words), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int64))),
                    ], names=["doc_id", "held_out", "n_tokens", "places", "own_log", "own_known", "tail", "times"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, places binary, own_log double, own_known long, tail array<binary>, times array<long>")


def _sequences(column: pa.Array, end: int):
    """The places of runs of texts, each text closed by `end` and a run's first with one before it, and the texts' sizes."""
    data, offs = tk.flat(column)
    for _, _, part, o in tk.slices(data, offs, 1 << 19):
        n, counts = len(o) - 1, np.diff(o) // 2
        out = np.full(counts.sum() + n + 1, end, np.int32)
        inner = np.ones(len(out), bool)
        inner[0] = False
        inner[np.cumsum(counts + 1)] = False
        out[inner] = np.frombuffer(part.tobytes(), "<u2")
        yield out, counts + 1


def _sums(df: DataFrame, cells: int, collect) -> np.ndarray:
    """Dense sums of the (cells, numbers) that collect(batch) yields over all rows: each task adds its own, chunks of cells are
    added up in streams, and the driver gets one array of `cells` numbers, a size that the model's bounds set."""
    spark = df.sparkSession

    def part(batches):
        total = np.zeros(-(-cells // CHUNK) * CHUNK, np.int64)
        for b in batches:
            for at, many in collect(b):
                np.add.at(total, at, many)
        for i in np.flatnonzero(total.reshape(-1, CHUNK).any(1)).tolist():
            x = total[i * CHUNK : (i + 1) * CHUNK]
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"chunk": [i], "at": [at.astype("<u2").tobytes()], "many": [x[at].astype("<i8").tobytes()]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total.setdefault(i, np.zeros(CHUNK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(many, "<i8")
        for i, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"chunk": [i], "at": [at.astype("<u2").tobytes()], "many": [x[at].tobytes()]})

    kind = "chunk long, at binary, many binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(-(-cells // CHUNK) * CHUNK, np.int64)
    got = df.mapInArrow(part, kind).repartition(parts, "chunk").mapInArrow(add, kind).toArrow()
    for i, at, many in zip(*(c.to_pylist() for c in got.columns), strict=True):
        out[i * CHUNK + np.frombuffer(at, "<u2").astype(np.int64)] += np.frombuffer(many, "<i8")
    return out[:cells]


def contexts(train: DataFrame, classes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each place stands before, and after, each class. The last place, the end, is the class many - 1."""
    places, end = len(classes), len(classes) - 1
    size = places * many

    def collect(b):
        for s, _ in _sequences(b.column(0), end):
            c = classes[s]
            yield s[:-1] * many + c[1:], 1
            yield size + s[1:] * many + c[:-1], 1

    got = _sums(train.select("places"), 2 * size, collect)
    return got[:size].reshape(places, many), got[size:].reshape(places, many)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, many: int) -> np.ndarray:
    """One round of exchange: each place in turn, frequent ones first, moves to the class with the highest likelihood of the
    class bigrams. Contexts are those of the round's start; the end stays alone in the last class."""
    classes = classes.copy()
    n = np.zeros((many, many))
    np.add.at(n, classes, after)
    weight = after.sum(1)
    for w in np.argsort(-weight[:-1], kind="stable").tolist():
        if not weight[w]:
            break
        a, r, l = classes[w], after[w].astype(float), before[w].astype(float)
        n[a] -= r
        n[:, a] -= l
        rows, cols = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_xlogx(np.maximum(n[:, rows], 0) + r[rows]) - _xlogx(np.maximum(n[:, rows], 0))).sum(1)
        gain += (_xlogx(np.maximum(n[cols], 0) + l[cols, None]) - _xlogx(np.maximum(n[cols], 0))).sum(0)
        out, inn = np.maximum(n.sum(1), 0), np.maximum(n.sum(0), 0)
        gain -= _xlogx(out + r.sum()) - _xlogx(out) + _xlogx(inn + l.sum()) - _xlogx(inn)
        b = int(gain[:-1].argmax())
        b = b if gain[b] > gain[a] + 1e-9 else a
        n[b] += r
        n[:, b] += l
        classes[w] = b
    return classes


def transitions(n: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): bigram shares, with Witten-Bell weight for the class shares."""
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    keep = total / np.maximum(total + kinds, 1)
    return np.log10(keep * n / np.maximum(total, 1) + (1 - keep) * (mass / mass.sum())[None, :])


def score(docs: DataFrame, words: int = WORDS, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text.

    Words of the training texts are counted; the `words` most frequent of at most WORD_BYTES bytes and the endings of all others are
    places that exchange clustering deals to classes, from their contexts in all training texts; the end of a text is a class alone.
    P(w | before) = P(class(w) | class(before)) * (c + 0.1) / (tokens + 0.1 * (kinds + 1)) of the class: the class's words
    and one unknown word sum to 1. A text starts after an end. The factor c + 0.1 is in the base score too, so that
    counts of rare words, joined by word, only add up per text; no list of all words is sent to any task.
    Null or empty texts have the end alone; repeated rows count and score each; a null id is held out; without training
    texts every count is 0.
    """
    if words + ENDINGS >= 1 << 16:
        raise ValueError(f"score: at most {(1 << 16) - 1 - ENDINGS} words can have places of their own")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col, mod).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = stored(word_counts(texts), "words")
    top = counts.filter(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(words).toArrow()
    places = Places(top["word"].to_pylist(), np.array(top["c"].to_pylist(), np.int64))
    # The written table gives every row a number that stays.
    encoded = stored(encode(texts, places).withColumn("row", F.monotonically_increasing_id()), "places")
    train = encoded.filter(~F.col("held_out"))

    own, end = len(places.words), places.end

    def kinds(b):
        at, _ = places.of(b.column(0).cast(pa.large_binary()))
        n = np.bincount(at, minlength=end + 1)
        c = np.bincount(at, b.column(1).to_numpy(zero_copy_only=False), end + 1)
        yield np.arange(2 * (end + 1)), np.concatenate((n, c)).astype(np.int64)

    got = _sums(counts.select("word", "c"), 2 * (end + 1), kinds)
    n_kinds, n_tokens = got[: end + 1], got[end + 1 :]
    ends = train.count()
    n_tokens[end], n_kinds[end] = ends, min(ends, 1)
    train_tokens, vocabulary = int(n_tokens.sum()), int(n_kinds.sum())

    cls = np.append(np.arange(end) % (classes - 1), classes - 1)
    for _ in range(rounds):
        after, before = contexts(train, cls, classes)
        cls = exchange(cls, after, before, classes)
    after, _ = contexts(train, cls, classes)
    n = np.zeros((classes, classes))
    np.add.at(n, cls, after)
    unknown = np.append(np.ones(classes - 1), 0 if ends else 1)
    mass = np.bincount(cls, n_tokens, classes) + 0.1 * (np.bincount(cls, n_kinds, classes) + unknown)
    table = transitions(n, mass) - np.log10(mass)[None, :]
    base = float(np.log10(train_tokens + 0.1 * (vocabulary + 1)))
    end_log, end_known = float(np.log10(ends + 0.1)), int(ends > 0)

    def local(batches):
        for b in batches:
            parts = []
            for places_, sizes in _sequences(b.column(1), end):
                s = cls[places_]
                sums = np.concatenate(([0], np.cumsum(table[s[:-1], s[1:]])))
                parts.append(np.diff(sums[np.concatenate(([0], np.cumsum(sizes)))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["row", "local"])

    rows = encoded
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), "t.times")
    c = F.coalesce("c", F.lit(0))
    rare = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("tail_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    inner = rows.select("row", "places").mapInArrow(local, "row long, local double")
    whole = rows.select("row", "doc_id", "held_out", "n_tokens", "own_log", "own_known").join(inner, "row").join(rare, "row", "left")
    logs = F.col("own_log") + F.coalesce("tail_log", F.lit(0.0)) + F.lit(end_log)
    out = whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("own_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(end_known)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * base).alias("base_score"), (logs + F.col("local")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
