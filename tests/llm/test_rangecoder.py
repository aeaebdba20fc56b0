"""The coder of token ids: how far streams advance together, and sizes at its bounds."""

import numpy as np
import pytest

from quernstone.llm import rangecoder
from quernstone.llm.rangecoder import decode_segment, encode_segment


@pytest.mark.parametrize("names", [3_000, 40_000])
def test_ids_advance_by_hundreds_at_a_position(monkeypatch, names):
    positions = 0
    predict = rangecoder._Model.predict

    def counted(self):
        nonlocal positions
        positions += 1
        return predict(self)

    monkeypatch.setattr(rangecoder._Model, "predict", counted)
    ids = np.random.default_rng(names).permutation(np.arange(300_000, dtype=np.int32) % names)
    data = encode_segment(ids)
    assert positions <= len(ids) // 250
    assert (decode_segment(data) == ids).all()
    assert positions <= len(ids) // 125


@pytest.mark.parametrize("n", [2, 1023, 1024, 2047, 2049, 16_383, 16_385, 49_157])
def test_streams_of_any_length(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 700, n), np.repeat(r.integers(0, 9, n), 50)[:n], np.r_[np.zeros(n - 1), 5_000_000]):
        ids = ids.astype(np.int32)
        assert (decode_segment(encode_segment(ids)) == ids).all()


def test_more_distinct_ids_than_16_bits():
    ids = np.random.default_rng(1).permutation(np.r_[np.arange(70_000), np.zeros(9_000)]).astype(np.int32)
    assert (decode_segment(encode_segment(ids)) == ids).all()


def test_a_stream_with_more_words_than_16_bits_count(monkeypatch):
    monkeypatch.setattr(rangecoder, "STREAMS", 1)
    monkeypatch.setattr(rangecoder, "LANES", 1)
    ids = np.random.default_rng(2).integers(0, 50_000, 40_000).astype(np.int32)
    assert (decode_segment(encode_segment(ids)) == ids).all()


def test_changed_bytes_are_noticed():
    whole = encode_segment((np.arange(5_000) ** 2 % 300).astype(np.int32))
    block = whole.index(b"QRC2")
    for at in (0, 4, 12, 16, 20, 24, 28, 40, block, block + 4, block + 8, block + 12, block + 16, block + 30, (block + len(whole)) // 2):
        data = bytearray(whole)
        data[at] ^= 4
        with pytest.raises(ValueError):
            decode_segment(bytes(data))
