"""Models that the piece encoder's argument doesn't hold for are refused."""

import struct

import pytest
import sentencepiece

from wareknit.llm import pieces
from wareknit.llm.common import default_tokenizer


def changed(tmp_path, test, change):
    """A copy of the model with one piece's message changed."""
    library = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    proto = library.serialized_model_proto()
    piece = next(p for n, p in pieces.fields(proto) if n == pieces.PIECE_FIELD and test(dict(pieces.fields(p))))
    new = change(piece)
    assert len(new) < 128
    path = tmp_path / "changed.model"
    path.write_bytes(proto.replace(b"\n" + bytes([len(piece)]) + piece, b"\n" + bytes([len(new)]) + new, 1))
    return str(path)


def test_user_defined_pieces(tmp_path):
    path = changed(tmp_path, lambda f: len(f[1]) > 5 and f[1].isalpha(), lambda p: p + b"\x18\x04")
    with pytest.raises(ValueError, match="user-defined"):
        pieces.PieceModel(path)


def test_marks_of_different_scores(tmp_path):
    marks = lambda f: len(f[1]) == 4 * len(pieces.MARK.encode()) and not f[1].decode().strip(pieces.MARK)
    path = changed(tmp_path, marks, lambda p: p[:-4] + struct.pack("<f", -12345.0))
    with pytest.raises(ValueError, match="different scores"):
        pieces.PieceModel(path)
