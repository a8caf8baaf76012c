import random

import pytest

from rillflow.llm import sp_dropout as s
from tests.llm.helpers import LONG, documents, odd_rows, prose

TEXTS = ["", " ", "  two  spaces ", "line\nbreak\ttab\0null", "日本語 テスト é ß 😀", "▁ mark▁▁in text ▁", "a" * 500, " " * 90, prose(1), LONG[:5000], "x " * 50]


@pytest.fixture(scope="module")
def pieces():
    return s.Pieces.load()


def test_equals_the_library_without_a_skip(pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)
    e = s.Encoder(pieces, 0.0)
    for t in TEXTS:
        if s.SPACE not in t:
            assert e.encode(t) == library.encode(t)


@pytest.mark.parametrize("skip", [0.0, 1 / 16, 0.3, 0.9, 1.0])
def test_round_trip(pieces, skip):
    e = s.Encoder(pieces, skip, seed=5)
    for n, t in enumerate(TEXTS):
        ids = e.encode(t, n)
        assert s.decode(pieces, ids) == t
        assert ids == s.Encoder(pieces, skip, seed=5).encode(t, n)  # the same for the same seed


def test_segmentations_vary_and_more_with_more_skips(pieces):
    text = prose(3, 200)
    plain = len(s.Encoder(pieces, 0.0).encode(text, 1))
    sizes = [len(s.Encoder(pieces, k).encode(text, 1)) for k in (1 / 16, 0.3, 0.9)]
    assert plain < sizes[0] < sizes[1] < sizes[2]
    assert s.Encoder(pieces, 0.3).encode(text, 1) != s.Encoder(pieces, 0.3).encode(text, 2)
    assert s.Encoder(pieces, 0.3, 1).encode(text, 1) != s.Encoder(pieces, 0.3, 2).encode(text, 1)


def test_rounds_equal_the_heap(pieces):
    import numpy as np

    r = random.Random(2)
    e = s.Encoder(pieces, 0.3)
    for w in pieces.segment.findall(s.SPACE + " ".join(TEXTS).replace(" ", s.SPACE))[:400]:
        if len(w) <= e.SHORT:
            bits = r.getrandbits(64) & r.getrandbits(64)
            got, _ = e.merge_short(np.frombuffer(w.encode("utf-32-le"), np.int32), np.array([0]), np.array([len(w)]), np.array([bits], np.uint64))
            assert got.tolist() == e.merge_long(w, bits, lambda i: 0)


def test_batches_do_not_matter(pieces):
    texts = [prose(i) for i in range(20)] + TEXTS
    e = s.Encoder(pieces, 0.3)
    flat, sizes = e.encode_all(texts, list(range(len(texts))))
    assert flat.tolist() == [x for i, t in enumerate(texts) for x in s.Encoder(pieces, 0.3).encode(t, i)]
    assert sizes.sum() == len(flat)


def test_draws_have_the_probability():
    import numpy as np

    for threshold in (0, 16, 26, 128, 255):
        got = np.bitwise_count(s.draws(np.arange(20_000, dtype=np.uint64), threshold)).mean() / 64
        assert got == pytest.approx(threshold / 256, abs=0.004)
    assert (s.draws(np.arange(5, dtype=np.uint64), 0) == 0).all()


def test_rows(spark, pieces):
    docs = documents(spark, odd_rows())
    got = s.encode(docs).collect()
    assert len(got) == docs.count() and all(x["lossless"] and x["n_pieces"] == len(x["pieces"]) for x in got)
    texts = dict(odd_rows())
    for x in got:
        assert s.decode(pieces, x["pieces"]) == (texts[x["doc_id"]] or "")
    assert len({tuple(x["pieces"]) for x in got if x["doc_id"] == 5}) == 1
    assert s.encode(documents(spark, [])).count() == 0
