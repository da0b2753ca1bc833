"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the SIDE tokens on its left and on its right. Tokens are words. The
network sees and predicts their class, one of CLASSES = HALF x HALF, in two steps (its first half,
then its second half given the first), so a prediction costs 2 HALF outputs instead of CLASSES;
the word follows from its class by the words' counts in the corpus, with a share for unseen words.

    h = tanh(b + sum over places p of E_p[class at p])
    p(first | h) = softmax(h W1 + c1),  p(second | h, first) = softmax((h + A[first]) W2 + c2)
    p(word | class) = (count + UNSEEN) / (class's count + UNSEEN (class's words + 1))

Training is plain numpy in tasks: in each of ROUNDS passes every partition of the corpus trains
the network it was given on all its tokens (Adagrad), and the resulting weights are averaged,
weighted by tokens, in a tree of tasks. What is gathered so grows with the partitions, and only
the last FAN_IN sets of weights, of fixed size, reach the driver; they depend on how the rows are
dealt to partitions. The table of words grows with the corpus and stays distributed: the few words
with over 1/HOT_WORDS of all tokens go to all tasks, the others of a document are joined by word. A
document's score is the sum of the log-probabilities of all its tokens.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint

HALF = 32
CLASSES = HALF * HALF
HIDDEN = 16
SIDE = 2
ROUNDS = 2
RATE = 0.08
STEP_TOKENS = 4_096
CHUNK_TOKENS = 1 << 18
CHUNK_BYTES = 1 << 21  # of texts, or one text
FAN_IN = 32
PAD = CLASSES
KEPT_WORDS = 500_000  # words that a task remembers
HOT_WORDS = 1 << 20
UNSEEN = 0.5
SHAPES = {
    "E": (2 * SIDE, CLASSES + 1, HIDDEN),
    "b": (HIDDEN,),
    "W1": (HIDDEN, HALF),
    "c1": (HALF,),
    "A": (HALF, HIDDEN),
    "W2": (HIDDEN, HALF),
    "c2": (HALF,),
}


def new_weights(seed: int = 1) -> np.ndarray:
    draw = np.random.default_rng(seed)
    parts = [draw.normal(0, 0.1, shape) if len(shape) > 1 else np.zeros(shape) for shape in SHAPES.values()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


class Words(dict):
    """From a word to its number here, and by number its class and a 64-bit id."""

    def __init__(self) -> None:
        self.classes, self.ids = array("h"), array("q")

    def learn(self, words: list[bytes]) -> None:
        """Numbers for words that are new."""
        self.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.classes.extend([zlib.crc32(w) & (CLASSES - 1) for w in words])
        self.ids.extend([xxhash.xxh64_intdigest(w) - (1 << 63) for w in words])

    def __missing__(self, word: bytes) -> int:
        self.learn([word])
        return self[word]

    def numbers(self, text: str | None) -> np.ndarray:
        """Of the words of a whole text, lower-cased (A-Z), cut at ASCII blanks."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def token_classes(text: str | None) -> np.ndarray:
    words = Words()
    numbers = words.numbers(text)
    return np.array(words.classes, np.int16)[numbers]


def word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode().lower()) - (1 << 63)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, targets, text number) of every token; texts do not see each other."""
    pad = np.full(SIDE, PAD, np.int16)
    stream = np.concatenate([x for t in texts for x in (t, pad)] or [pad])
    stream = np.concatenate([pad, stream])
    at = np.flatnonzero(stream != PAD)
    places = [d for d in range(-SIDE, SIDE + 1) if d]
    contexts = np.stack([stream[at + d] for d in places])
    return contexts, stream[at], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis: outputs in rows, tokens in columns, so every step runs along tokens."""
    x -= x.max(axis=0)
    x -= np.log(np.exp(x).sum(axis=0))
    return x


def _hidden(w: dict[str, np.ndarray], contexts: np.ndarray) -> np.ndarray:
    hidden = w["b"] + w["E"][0][contexts[0]]
    for p in range(1, 2 * SIDE):
        hidden += w["E"][p][contexts[p]]
    return np.tanh(hidden, out=hidden)


def _outputs(w: dict[str, np.ndarray], hidden: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What goes into both softmaxes, and the hidden values of the second."""
    joined = hidden + w["A"][first]
    return w["W1"].T @ hidden.T + w["c1"][:, None], w["W2"].T @ joined.T + w["c2"][:, None], joined


def forward(w: dict[str, np.ndarray], contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log-probability of every target."""
    first, second = targets >> 5, targets & (HALF - 1)
    one, two, _ = _outputs(w, _hidden(w, contexts), first)
    row = np.arange(len(targets))
    return _log_softmax(one)[first, row] + _log_softmax(two)[second, row]


def _excess(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Softmax of every column, less 1 at its target."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    x[target, np.arange(len(target))] -= 1
    return x


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """values (one column for each entry of rows) summed by row number."""
    out = np.empty((n, len(values)), np.float32)
    for i, v in enumerate(values):
        out[:, i] = np.bincount(rows, v, n)
    return out


def gradient(w: dict[str, np.ndarray], contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log-probability, flat like the weights."""
    first, second = targets >> 5, targets & (HALF - 1)
    hidden = _hidden(w, contexts)
    one, two, joined = _outputs(w, hidden, first)
    d_one, d_two = _excess(one, first), _excess(two, second)
    d_joined = w["W2"] @ d_two
    d_hidden = (w["W1"] @ d_one + d_joined) * (1 - hidden * hidden).T
    parts = {
        "E": np.stack([_summed(place, d_hidden, CLASSES + 1) for place in contexts]),
        "b": d_hidden.sum(axis=1),
        "W1": hidden.T @ d_one.T,
        "c1": d_one.sum(axis=1),
        "A": _summed(first, d_joined, HALF),
        "W2": joined.T @ d_two.T,
        "c2": d_two.sum(axis=1),
    }
    return np.concatenate([parts[name].ravel() for name in SHAPES]) / np.float32(len(targets))


def _numbers(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """Word numbers of every text; the words are cut and grouped by Arrow, each different one is
    looked up once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    different = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    places = np.fromiter(map(words.get, different, repeat(-1)), np.int32, len(different))
    new = [i for i in np.flatnonzero(places < 0).tolist() if different[i]]  # the empty word keeps -1
    places[new] = np.arange(len(words), len(words) + len(new))
    words.learn([different[i] for i in new])
    numbers = places[found.indices.to_numpy()]
    ends = lists.offsets.to_numpy()
    full = numbers >= 0  # cutting leaves empty words at blank ends
    kept = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]
    return np.split(numbers[full], kept[1:-1])


def _chunks(column: pa.Array, words: Words) -> Iterator[list[np.ndarray]]:
    """The texts' word numbers, about CHUNK_BYTES at a time; before a chunk `words` may forget."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
        yield _numbers(column.slice(start, stop - start), words)
        start = stop


def _classes(chunk: list[np.ndarray], words: Words) -> list[np.ndarray]:
    classes = np.array(words.classes, np.int16)
    return [classes[numbers] for numbers in chunk]


def _forget(words: Words, *given) -> None:
    if len(words) > KEPT_WORDS:
        words.clear()
        words.__init__(*given)


class Trainer:
    def __init__(self, weights: np.ndarray, rate: float = RATE):
        self.weights, self.rate = weights.copy(), rate
        self.squares = np.full(len(weights), 1e-6, np.float32)
        self.tokens = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        contexts, targets, _ = windows(texts)
        w = views(self.weights)
        for start in range(0, len(targets), STEP_TOKENS):
            own = slice(start, start + STEP_TOKENS)
            g = gradient(w, contexts[:, own], targets[own])
            self.squares += g * g
            self.weights -= self.rate * g / np.sqrt(self.squares)
        self.tokens += len(targets)


def _averaged(rows: DataFrame) -> np.ndarray | None:
    """Mean of (tokens, weights), by tokens, in a tree of tasks."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            for tokens, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = total + np.frombuffer(weights, np.float32).astype(np.float64) * tokens
                n += tokens
        if n:
            yield pa.RecordBatch.from_pydict({"tokens": [n], "weights": [(total / n).astype(np.float32).tobytes()]})

    n = rows.count()
    while n > FAN_IN:
        rows = checkpoint(rows.repartition(-(-n // FAN_IN)).mapInArrow(mean, rows.schema))
        n = rows.count()
    found = rows.orderBy("tokens", "weights").collect()
    if not found:
        return None
    total = sum(r["tokens"] for r in found)
    mixed = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["tokens"] / total) for r in found)
    return mixed.astype(np.float32)


def read_words(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One pass over all rows: (classes binary) of the words of every text, as 16-bit integers, and
    (id, class, n) with the occurrences of every word, which grows with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(0, np.int64)
        names = ["classes", "id", "class", "n"]

        def counted(counts):
            for start in range(0, len(counts), CHUNK_TOKENS):
                own = slice(start, start + CHUNK_TOKENS)
                arrays = [np.array(words.ids[own]), np.array(words.classes[own], np.int32), counts[own]]
                texts = pa.nulls(len(arrays[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([texts, *[pa.array(x) for x in arrays]], names)

        for batch in batches:
            for chunk in _chunks(batch.column(0), words):
                found = np.bincount(np.concatenate(chunk), minlength=len(words))
                found[: len(counts)] += counts
                counts = found
                texts = pa.array([x.tobytes() for x in _classes(chunk, words)], pa.binary())
                empty = [pa.nulls(len(chunk), kind) for kind in (pa.int64(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([texts, *empty], names)
                if len(words) > KEPT_WORDS:
                    yield from counted(counts)
                    counts = np.zeros(0, np.int64)
                    _forget(words)
        yield from counted(counts)

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "classes binary, id long, class int, n long")
    rows = checkpoint(rows)
    counts = rows.filter("id is not null").groupBy("id", "class").agg(F.sum("n").alias("n"))
    return rows.filter("classes is not null").select("classes"), checkpoint(counts)


def train_classes(texts: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights trained on all texts of `read_words`. Without tokens: the first, random weights."""
    weights = new_weights()
    for _ in range(rounds):
        given = texts.sparkSession.sparkContext.broadcast(weights)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(given.value)
            for batch in batches:
                chunk, size = [], 0
                for value in batch.column(0):
                    chunk.append(np.frombuffer(value.as_py(), np.int16))
                    size += len(chunk[-1])
                    if size >= CHUNK_TOKENS:
                        trainer.learn(chunk)
                        chunk, size = [], 0
                trainer.learn(chunk)
            if trainer.tokens:
                yield pa.RecordBatch.from_pydict({"tokens": [trainer.tokens], "weights": [trainer.weights.tobytes()]})

        found = _averaged(checkpoint(texts.mapInArrow(run, "tokens long, weights binary")))
        weights = weights if found is None else found
    return weights


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    return train_classes(read_words(docs, text)[0], rounds)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    return read_words(docs, text)[1]


class WordLogs:
    """What tasks add for words: log(count + UNSEEN) of hot words by id, and by class the log of what
    the counts are divided by."""

    def __init__(self, words: DataFrame):
        sums = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
        self.total = sum(r["n"] for r in sums)
        self.divisors = np.full(CLASSES, np.log(UNSEEN))
        for r in sums:
            self.divisors[r["class"]] = np.log(r["n"] + UNSEEN * (r["words"] + 1))
        hot = words.filter(F.col("n") > self.total / HOT_WORDS).select("id", "n").toArrow()  # at most HOT_WORDS
        ids, counts = hot["id"].to_numpy(), hot["n"].to_numpy()
        order = np.argsort(ids)
        self.ids, self.logs = ids[order], np.log(counts[order] + UNSEEN)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Logs of hot words, NaN for others."""
        if not len(self.ids):
            return np.full(len(ids), np.nan)
        place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[place] == ids, self.logs[place], np.nan)


def _class_logs(w: dict[str, np.ndarray], chunk: list[np.ndarray]) -> np.ndarray:
    """Log-probability of every text's classes."""
    contexts, targets, number = windows(chunk)
    total = np.zeros(len(chunk))
    for start in range(0, len(targets), STEP_TOKENS):
        own = slice(start, start + STEP_TOKENS)
        logs = forward(w, contexts[:, own], targets[own])
        total += np.bincount(number[own], logs.astype(np.float64), len(chunk))
    return total


class KnownWords(Words):
    """Words with what tasks know of log P(word | class), and whether the rest has to be looked up."""

    def __init__(self, known: WordLogs | None) -> None:
        super().__init__()
        self.known, self.logs, self.rare = known, np.zeros(0), np.zeros(0, bool)

    def grow(self) -> None:
        ids, classes = (np.array(x[len(self.logs) :]) for x in (self.ids, self.classes))
        logs = self.known.of(ids)
        self.logs = np.append(self.logs, np.nan_to_num(logs) - self.known.divisors[classes])
        self.rare = np.append(self.rare, np.isnan(logs))


def _word_logs(chunk: list[np.ndarray], words: KnownWords):
    """For every text the sum of what tasks know, and the ids and counts of words to be looked up."""
    words.grow()
    numbers = np.concatenate(chunk)
    text = np.repeat(np.arange(len(chunk)), [len(x) for x in chunk])
    sums = np.bincount(text, words.logs[numbers], len(chunk))
    asked = words.rare[numbers]
    size = max(len(words.logs), 1)
    pairs, counts = np.unique(text[asked] * size + numbers[asked], return_counts=True)
    borders = np.searchsorted(pairs, np.arange(len(chunk) + 1) * size).astype(np.int32)
    ids = np.array(words.ids)[pairs % size] if len(pairs) else np.zeros(0, np.int64)
    return sums, [pa.ListArray.from_arrays(pa.array(borders), pa.array(x)) for x in (ids, counts)]


def score(
    docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text", words: DataFrame | None = None
) -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token), one row per row of `docs`: of the words, with the
    table of `count_words`; without it of their classes only.

    Null, empty and blank texts have no tokens, log_prob 0 and a null mean. Rows with null or
    repeated ids are scored like others. An empty table gives no rows.
    """
    known = None if words is None else WordLogs(words)
    given = docs.sparkSession.sparkContext.broadcast((weights, known))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = given.value
        w, own = views(weights.copy()), KnownWords(known)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column(1), own):
                sums = _class_logs(w, _classes(chunk, own))
                lists = [pa.nulls(len(chunk), pa.list_(pa.int64()))] * 2
                if known is not None:
                    more, lists = _word_logs(chunk, own)
                    sums = sums + more
                arrays = [
                    pa.array(np.arange(row, row + len(chunk))),
                    batch.column(0).slice(done, len(chunk)),
                    pa.array([len(x) for x in chunk], pa.int64()),
                    pa.array(sums),
                    *lists,
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_tokens", "log_prob", "ids", "counts"])
                row, done = row + len(chunk), done + len(chunk)
                _forget(own, known)

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, log_prob double, ids array<long>, counts array<long>"
    found = source.mapInArrow(run, schema)
    if words is None:
        found = found.select("doc_id", "n_tokens", "log_prob")
    else:
        found = _with_rare_words(found, words)
    return found.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def _with_rare_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds log(count + UNSEEN) of the listed words: one row for each text and word is joined by
    word (none of them hot, as hot ones are not listed) and added up by text. Texts that list
    none have a key of their own."""
    listed = found.select("row", "doc_id", "n_tokens", "log_prob", F.posexplode_outer(F.arrays_zip("ids", "counts")).alias("pos", "x"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    once = [F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_tokens", "log_prob")]
    pairs = listed.select("row", *once, F.coalesce("x.ids", "row").alias("id"), F.col("x.counts").alias("times"))
    joined = pairs.join(words.select("id", "n"), "id", "left")
    more = F.coalesce(F.col("times") * F.ln(F.coalesce("n", F.lit(0)) + UNSEEN), F.lit(0.0))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("log_prob", F.lit(0.0)) + more).alias("log_prob"),
        )
        .drop("row")
    )


def pseudo_likelihood(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train and count on all of `docs`, then score all of it; see `score` for the columns."""
    texts, words = read_words(docs, text)
    return score(docs, train_classes(texts), id, text, words)
