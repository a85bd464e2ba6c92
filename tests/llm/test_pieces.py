import random

import numpy as np
import pytest
import sentencepiece
from helpers import awkward, awkward_rows, empty

from tillroll.llm import pieces
from tillroll.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def texts(vocabulary):
    rng = random.Random(7)
    alphabet = "abcdefghij  \n\t▁éß漢字日本語テスト😀​<s>0123456789.,тестαβ"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(150))) for _ in range(300)]
    known = [p.replace(pieces.SPACE, " ") for p in vocabulary.pieces if not p.startswith("<0x")]
    out += ["".join(rng.choices(known, k=rng.randrange(1, 25))) for _ in range(600)]
    return [*out, "", " ", "  ", "\n", "a" * 700, " " * 90, "漢" * 200, "x" * 80 + "漢字" * 40]


def test_ids_equal_the_library(model):
    vocabulary = pieces.Vocabulary(model)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(vocabulary)
    sample = texts(vocabulary)
    assert [x.tolist() for x in own.encode(sample)] == library.encode(sample)
    assert [pieces.decode_ids(vocabulary, x) for x in library.encode(sample)] == library.decode(library.encode(sample))


def test_small_caches_change_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 50)
    vocabulary = pieces.Vocabulary(model)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(vocabulary)
    for i in range(3):
        part = texts(vocabulary)[i * 40:(i + 1) * 40]
        assert [x.tolist() for x in own.encode(part)] == library.encode(part)


def as_unigram(model):
    """The same pieces as a unigram model: ``trainer_spec.model_type`` 2 -> 1."""
    at = model.rindex(b"\x18\x02")
    for i in (j for j in range(len(model)) if model[j:j + 2] == b"\x18\x02"):
        changed = model[:i] + b"\x18\x01" + model[i + 2:]
        if pieces._model_type(changed) == 1:
            return changed
    raise AssertionError(at)


def test_unigram_paths_have_the_best_score(model):
    """Against a plain Viterbi, word by word."""
    vocabulary = pieces.Vocabulary(as_unigram(model))
    assert not vocabulary.bpe
    index = {vocabulary.pieces[i]: i for i in vocabulary.ids.tolist()}
    rng = random.Random(1)
    words = ["".join(rng.choices("etaonrish▁", k=rng.randrange(1, 12))) for _ in range(200)]
    own = pieces.Encoder(vocabulary)
    for size in {len(w) for w in words}:
        group = sorted({w for w in words if len(w) == size})
        for w, raw in zip(group, own._same_length(group, size)):
            best = [0.0] + [-1e300] * size
            for end in range(1, size + 1):
                for start in range(max(0, end - vocabulary.longest), end):
                    if w[start:end] in index:
                        best[end] = max(best[end], best[start] + vocabulary.scores[index[w[start:end]]])
            ids = np.frombuffer(raw, np.int32)
            assert "".join(vocabulary.pieces[i] for i in ids) == w
            assert vocabulary.scores[ids].sum() == pytest.approx(best[size])


def test_frames(spark, model):
    rows = awkward(spark)
    coded = pieces.encode(rows, model)
    assert coded.columns == [*rows.columns, "ids"]
    back = {(r["doc_id"], r["text"]): (r["ids"], r["decoded"]) for r in pieces.decode(coded, model).collect()}
    assert len(back) == len({(r[0], r[1]) for r in awkward_rows()})
    for (_, text), (ids, decoded) in back.items():
        assert decoded == text
        assert (ids is None) == (text is None) and (text != "" or ids == [])
    assert pieces.encode(empty(spark), model).count() == 0
