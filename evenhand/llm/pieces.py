"""Exact encoding and decoding with merge-type (BPE) SentencePiece models.

The model's rule merges the neighbours whose union has the best score, leftmost first, until no
union is a piece. A sequence of pieces is its result exactly where every two neighbours, merged
again from their characters, come out as the same two pieces: as long as no merge crosses a
border, the merges on both sides of it happen in the order in which they happen in the two pieces
alone. So a text is covered from the left by the longest pieces that an Aho-Corasick automaton
finds, a piece is kept if it suits its left neighbour, shorter pieces are tried otherwise, and
where none is left the place is marked as failed and the last piece is taken back. No place is
entered again once it has failed, so work and memory grow with the length of the text.

Texts are cut where no piece can cross (before a space that follows another character, where no
piece piece holds such a place, between words and punctuation marks that share no piece, and at control
characters), so that words met before come from a bounded dictionary. Characters outside the
vocabulary become their UTF-8 bytes.
"""

from __future__ import annotations

import codecs
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model's file
KEPT_WORDS, KEPT_CHARS = 800_000, 48  # words a worker remembers, and their longest length
KEPT_PAIRS = 500_000
NONE = float("-inf")
BATCH_BYTES = 8 << 20


def merge_steps(text: str, scores: dict[str, float]) -> Iterator[tuple[float, str, str]]:
    """What the model's rule does to a short text, ties of the score from the left: for every merge
    its score and the first and the last part after it."""
    parts = list(text)
    links = [scores.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while links and (best := max(links)) > NONE:
        at = links.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del links[at]
        if at:
            links[at - 1] = scores.get(parts[at - 1] + parts[at], NONE)
        if at < len(links):
            links[at] = scores.get(parts[at] + parts[at + 1], NONE)
        yield best, parts[0], parts[-1]


def stays(piece: str, scores: dict[str, float]) -> bool:
    """Whether the characters of a piece are merged to it."""
    last = (0.0, piece[0], "")
    for last in merge_steps(piece, scores):
        pass
    return last[1] == piece


@dataclass
class Model:
    """What tasks need of a model, a few values for each piece: it is bounded by the vocabulary."""

    scores: dict[str, float]  # of all pieces that merges can make
    ids: dict[str, int]
    shorter: list[int]  # for an id the id of the longest piece that is a proper prefix of it, or -1
    reached: frozenset[int]  # ids of pieces that their own text is merged to
    bytes: tuple[int, ...]  # ids of the 256 bytes
    surfaces: tuple[bytes, ...]  # what an id stands for
    bound: frozenset[int]  # ids that begin with a space sign
    marks: tuple[int, ...]  # ids that stand for no text
    begin: int
    end: int
    prefix: bool  # a space is put before a text

    @cached_property
    def encoder(self) -> Encoder:
        """Lives as long as the Python worker keeps the broadcast, so tasks share its words."""
        return Encoder(self)


def read_model(path: str) -> Model:
    """Read on the driver. Only models of the merge type with the identity normaliser, white space
    kept, all bytes, and no pieces of other kinds are supported; others raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules, spec = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
    alphabet = {c for c in scores if len(c) == 1}
    n_bytes = kinds.count(BYTE)
    if (
        spec.model_type != spec.BPE
        or rules.precompiled_charsmap
        or rules.remove_extra_whitespaces
        or not rules.escape_whitespaces
        or spec.treat_whitespace_as_suffix
        or n_bytes != 256
        or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        or any(not alphabet.issuperset(p) for p in scores)
    ):
        raise ValueError(f"{path} is no merge-type model with identity normaliser and byte pieces")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    reached = frozenset(i for piece, i in ids.items() if stays(piece, scores))
    shorter = [-1] * len(kinds)
    for piece, i in ids.items():
        for n in range(len(piece) - 1, 0, -1):
            if (found := ids.get(piece[:n])) in reached:
                shorter[i] = found
                break
    byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
    values = {i: bytes([b]) for b, i in byte_ids.items()}
    surfaces = []
    for i, p in enumerate(proto.pieces):
        plain = {CONTROL: "", UNKNOWN: spec.unk_surface}.get(p.type, p.piece.replace(SPACE, " "))
        surfaces.append(values.get(i, plain.encode()))
    return Model(
        scores,
        ids,
        shorter,
        reached,
        tuple(byte_ids[b] for b in range(256)),
        tuple(surfaces),
        frozenset(i for piece, i in ids.items() if piece.startswith(SPACE)),
        tuple(i for i, kind in enumerate(kinds) if kind == CONTROL),
        spec.bos_id,
        spec.eos_id,
        rules.add_dummy_prefix,
    )


class Encoder(dict):
    """From a word to its ids as little-endian unsigned 32-bit integers; filled as words are met."""

    def __init__(self, model: Model):
        import ahocorasick

        super().__init__()
        self.model = model
        self.pairs: dict[int, bool] = {}
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        self.pieces = {i: piece for piece, i in model.ids.items()}
        self.lengths = [len(self.pieces.get(i, "")) for i in range(len(model.surfaces))]
        self.alphabet = frozenset(c for c in model.scores if len(c) == 1)
        self.automaton = ahocorasick.Automaton()
        for i in model.reached:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.words = re.compile(self.word_pattern()).findall

    def word_pattern(self) -> str:
        """Cuts a text only between characters that are neighbours in no piece."""
        neighbours = {pair for piece in self.model.scores for pair in zip(piece, piece[1:])}
        hard = "".join(c for c in "\t\n\r" if c not in self.alphabet)
        if any(b == SPACE != a for a, b in neighbours):
            return f"[^{hard}]+|[{hard}]" if hard else "(?s:.+)"
        marks = set(string.punctuation)
        # Characters that share a piece with a mark; neither marks nor others are cut from them.
        near = {c for a, b in neighbours if (a in marks) != (b in marks) for c in (a, b)} - marks - {SPACE}
        mark, close = (re.escape("".join(sorted(x))) for x in (marks, near))
        rest = f"{SPACE}{hard}"
        return (
            f"{SPACE}*+[^{mark}{close}{rest}]++(?=[{mark}{rest}]|\\Z)|{SPACE}*+[{mark}]++(?![{close}])"
            f"|{SPACE}*+[^{rest}]++|{SPACE}++" + (f"|[{hard}]" if hard else "")
        )

    def history(self, piece: int) -> list[tuple[float, str, str]]:
        """The merges that make a piece: (score, first part after it, last part after it)."""
        found = self.merges.get(piece)
        if found is None:
            found = self.merges[piece] = list(merge_steps(self.pieces[piece], self.model.scores))
        return found

    def suits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged again; kept."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.remerge(left, right)
        return found

    def remerge(self, left: int, right: int) -> bool:
        """Both pieces' own merges are replayed in the order in which the model's rule takes them;
        the parts at the border must not be merged before the last of them, nor after it."""
        scores, a, b = self.model.scores, self.pieces[left][-1], self.pieces[right][0]
        of_left, of_right = iter(self.history(left)), iter(self.history(right))
        end = (NONE, "", "")
        x, y = next(of_left, end), next(of_right, end)
        across = scores.get(a + b, NONE)
        while True:
            if across > x[0] and across >= y[0]:  # of equal scores the left one comes first
                return False
            if x[0] == NONE and y[0] == NONE:
                return True
            if x[0] >= y[0]:
                changed, a = a != x[2], x[2]
                x = next(of_left, end)
            else:
                changed, b = b != y[1], y[1]
                y = next(of_right, end)
            if changed:
                across = scores.get(a + b, NONE)

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        lengths, shorter, known = self.lengths, self.model.shorter, self.pairs.get
        longest = [-1] * len(text)
        for last, piece in self.automaton.iter(text):  # of one start, longer ones come later
            longest[last + 1 - lengths[piece]] = piece
        failed, size = bytearray(len(text) + 1), len(text)
        out: list[int] = []
        at, piece, left = 0, longest[0], -1
        while at < size:
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end]:
                    if left < 0:
                        break
                    good = known(left << 32 | piece)
                    if good or good is None and self.suits(left, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, left = end, piece
                if at < size:
                    piece = longest[at]
            else:
                failed[at] = 1
                piece = out.pop()  # tried again: its end has failed, so a shorter one follows
                at -= lengths[piece]
                left = out[-1] if out else -1
        return out

    def __missing__(self, word: str) -> bytes:
        ids: list[int] = []
        if self.alphabet.issuperset(word):
            ids = self.backtrack(word)
        else:
            start = 0
            for at, char in enumerate(word):
                if char not in self.alphabet:
                    if start < at:
                        ids += self.backtrack(word[start:at])
                    ids += [self.model.bytes[b] for b in char.encode()]
                    start = at + 1
            if start < len(word):
                ids += self.backtrack(word[start:])
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        words = self.words(SPACE + text if self.model.prefix else text)
        return b"".join(map(self.__getitem__, words))


def decoded(ids: np.ndarray, model: Model) -> str:
    """The text of ids; of a space sign that begins the text, one is taken away. Bytes that are no
    UTF-8, also because a mark parts them, become one U+FFFD each; ids outside the vocabulary raise
    IndexError."""
    text, fresh = "", model.prefix
    for run in np.split(ids, np.flatnonzero(np.isin(ids, model.marks))):
        listed = run[np.isin(run[:1], model.marks).sum() :].tolist()  # a run begins with its mark
        raw = b"".join(map(model.surfaces.__getitem__, listed))
        if fresh and listed:
            raw, fresh = raw[listed[0] in model.bound :], False
        text += text_of(raw)
    return text


def text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        codecs.register_error("each byte", lambda e: ("�", e.start + 1))
        return raw.decode("utf-8", "each byte")


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES from (bytes, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 32
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode(docs: DataFrame, model_path: str, marks: bool = True) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) of every row of (doc_id, text).

    ``ids`` holds little-endian unsigned 32-bit integers, with the begin and end ids if ``marks``.
    A null text counts as empty, an empty one has no ids but the marks; a null or repeated doc_id is
    kept as it is, each row on its own; other columns, of whatever name, are left out; an empty
    table gives no rows. Bytes that are no UTF-8 count as U+FFFD. Narrow: nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        model = sent.value
        encoder = model.encoder
        before, after = (np.array([i], "<u4").tobytes() if marks else b"" for i in (model.begin, model.end))

        def rows():
            for batch in batches:
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    packed = before + encoder.encode(text_of(raw.as_py() or b"")) + after
                    yield len(packed), (key, len(packed) // 4, packed)

        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        yield from _batches(rows(), schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded string) of rows as ``encode`` gives them. Null ids give a null
    text, no ids an empty one; ids outside the vocabulary or a broken last id fail the job."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        model = sent.value

        def rows():
            for batch in batches:
                for key, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    text = None if packed is None else decoded(np.frombuffer(packed, "<u4"), model)
                    yield len(packed or b"") * 2, (key, n, packed, text)

        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]
        yield from _batches(rows(), pa.schema(fields))

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
