"""The agendas of many chunks in arrays against one agenda after the other."""

import random

import numpy as np

from lotwise.llm import piece_codec


def of(codec, chunks):
    return dict(codec._new(chunks))


def test_arrays_are_as_the_list():
    """Made-up vocabularies with equal scores, halves that are no pieces and characters that are in none."""
    codec = piece_codec.PieceCodec(piece_codec.model_path())
    rng = random.Random(5)
    for round in range(30):
        most = rng.choice([2, 5, 10**6])
        pieces = sorted({"".join(rng.choices("abcdé", k=rng.choice([1, 2, 2, 2, 3, 3, 4, 6]))) for _ in range(60)})
        codec.score = {p: -float(rng.randrange(most)) for p in pieces}
        codec.id = {p: 1000 + i for i, p in enumerate(pieces)}
        codec.__dict__.pop("agendas", None)
        chunks = sorted({"".join(rng.choices("abcdéx😀" if round % 2 else "ab", k=rng.randrange(1, piece_codec.SHORT + 1))) for _ in range(80)})
        assert of(codec, chunks) == {c: codec._part(c) for c in chunks}


def test_new_words_share_rounds(monkeypatch):
    """Words that a worker has not met are merged together, none by an agenda of its own; long ones keep theirs."""
    codec, rng, alone = piece_codec.PieceCodec(piece_codec.model_path()), random.Random(7), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda part: alone.append(part) or merge(part))
    rows = [" ".join("".join(rng.choices("aeinrstéß%.,\n", k=rng.randrange(1, 16))) for _ in range(50)) for _ in range(9)]
    rows += ["", " ", "a  b", " lead", "▁x ▁", "aaaaaaaaa bbbb", "x\n\n y\n", "\n", "ᚠᚢ ok ᚠx", "一丁 丂x", "      ten"]
    ids = codec.encode_all(rows)
    assert not any(alone) and [np.frombuffer(x, "<i4").tolist() for x in ids] == [codec.library.encode(t, add_eos=True) for t in rows]
    rows = ["z" * (piece_codec.SHORT + 1), "a" * 40 + " " + "ab" * 300]
    assert [x.tobytes() for x in codec.library.encode(rows, add_eos=True, return_type="numpy")] == codec.encode_all(rows) and alone
    codec.chunks.most = 2
    rows = [f"w{i} q{i}. w{i}" for i in range(20)]
    assert [x.tobytes() for x in codec.library.encode(rows, add_eos=True, return_type="numpy")] == codec.encode_all(rows) == codec.encode_all(rows)


def test_slices_of_what_is_taken_at_once(monkeypatch):
    """The bounds on memory change nothing: rows, new chunks and ids in slices of two or three."""
    monkeypatch.setattr(piece_codec, "AT_ONCE", 2 * piece_codec.SHORT)
    codec = piece_codec.PieceCodec(piece_codec.model_path())
    rows = ["", "one two three four", "x" * 300, "", "fünf ᚠ sechs\n" * 20, " é", ""]
    ids, back, wrong = codec.checked(rows)
    assert wrong == [] and back == [codec.library.decode(x) for x in codec.library.encode(rows)]
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == codec.library.encode(rows, add_eos=True)
