import hashlib
import random
import time

import numpy as np
import pytest

from evenhand.llm import pieces, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def ids(model, text):
    return np.frombuffer(model.encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize(
    "alphabet",
    ["ab ▁\n", "  a", "the is to\n.,", "aaaab", "0123456789 .", "日本語のテ\U0001f600é \t", "'\"().-_= {};\n    ", "²x.,½a "],
)
def test_random_texts_against_the_library(model, library, alphabet):
    draw = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))
        assert ids(model, text) == library.encode(text), text


def test_texts_of_pieces_against_the_library(model, library):
    draw, every = random.Random(5), [p.replace("▁", " ") for p in model.ids]
    for _ in range(4000):
        text = "".join(draw.choice(every) for _ in range(draw.randrange(12)))
        assert ids(model, text) == library.encode(text), text


def test_pairs_that_stay_are_pairs_that_plain_merging_leaves(model):
    """Against the rule itself, carried out on the joined text."""
    draw, every = random.Random(6), sorted(model.ids.items())

    def merge(text):
        parts = list(text)
        while True:
            found = [(model.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.scores]
            if not found:
                return parts
            at = -max(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    for _ in range(3000):
        (a, i), (b, j) = draw.choice(every[:3000]), draw.choice(every[:3000])
        assert model.encoder.remerge(i, j) == (merge(a + b) == [a, b]), (a, b)


def test_decoding_of_any_ids_against_the_library(model, library):
    draw = random.Random(7)
    for _ in range(3000):
        some = [draw.choice([draw.randrange(32000), draw.randrange(259), draw.randrange(3), 28705]) for _ in range(draw.randrange(10))]
        assert pieces.decoded(np.array(some, "<u4"), model) == library.decode(some), some


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_000, "qxzjkvw" * 40_000, "\n" * 100_000, "é\U0001f600" * 50_000])
def test_long_unbroken_texts(model, library, text):
    start = time.perf_counter()
    assert ids(model, text) == library.encode(text)
    assert time.perf_counter() - start < 20


def test_rows(odd_docs, odd_rows, no_docs, library):
    found = pieces.decode(pieces.encode(odd_docs, PATH), PATH)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in found.collect())
    expected = []
    for key, text, _ in odd_rows:
        own = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((key is None, key or 0, len(own), np.array(own, "<u4").tobytes(), library.decode(own)))
    assert got == sorted(expected)
    assert pieces.decode(pieces.encode(no_docs, PATH), PATH).collect() == []


def test_broken_utf8_counts_as_replacement_characters(spark, library):
    docs = spark.sql("select 1L doc_id, cast(X'61E28162FF' as string) text")
    row = pieces.encode(docs, PATH, marks=False).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == library.encode("a��b�")


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "unigram.model"))


def test_query_on_whole_documents(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_backtracking_pieces(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(own).encode()).hexdigest()
