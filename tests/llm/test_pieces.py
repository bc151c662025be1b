"""The piece encoder against the public library, on odd texts and as a DataFrame operator."""

import os
import random

import pytest

from spanweave.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file here")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


def test_same_as_library(vocabulary):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    texts = ["", " ", None, "  a  b", "a" * 400, "▁x", "héllo 𝒳 日本語", "\t\r\n x  ", "x\x00y", "http://a.b/c?d=%20" * 30]
    texts += ["".join(rng.choice("ab eéthis  .,\n▁一zqü") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    ids, counts = pieces.Encoder(vocabulary).encode(texts)
    want = [library.encode(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert pieces.decode(vocabulary, ids, counts) == [(t or "").replace("▁", " ") for t in texts]


def test_operator(spark, vocabulary):
    df = spark.createDataFrame([(1, "the cat"), (2, None), (3, ""), (1, "the cat"), (None, "x  y")], "doc_id long, text string")
    rows = pieces.encode_texts(df, vocabulary).collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows) and [r.n_pieces for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert pieces.encode_texts(df.where("doc_id > 9"), vocabulary).count() == 0
