"""The Viterbi of unigram models, on the whole table, against the public library's."""

import random

import pyarrow.parquet as pq
import pytest

from tidemark.llm import pieces, queries

SF = "/root/testdata/sf0.01"


def unigram_model():
    """The vocabulary of the supplied merge model with scores of its own, as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, rng = pb.ModelProto(), random.Random(9)
    proto.ParseFromString(open(queries.PIECE_MODEL, "rb").read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -rng.uniform(4, 14) - (2 if len(p.piece) == 1 else 0)
    return proto.SerializeToString()


def test_whole_table_takes_the_best_sums(spark, tmp_path):
    import sentencepiece

    model = unigram_model()
    (tmp_path / "unigram.model").write_bytes(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    coder = pieces.PieceCoder(model)
    score = lambda ids: sum(coder.score[i] if i not in coder.bytes.values() else 0.0 for i in ids)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    equal = 0
    for r in pieces.encode_pieces(docs, str(tmp_path / "unigram.model")).collect():
        assert r.decoded_equal
        want = library.encode(texts[r.doc_id])
        equal += r.ids == want
        if r.ids != want:  # ties: &, && or &&, & have one sum
            assert score(r.ids) == pytest.approx(score(want), rel=1e-5)
    assert equal >= 0.5 * len(texts)
