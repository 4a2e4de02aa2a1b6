import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, no_documents, rows
from tokenizers import Tokenizer

from casemesh.llm import id_coder as C
from casemesh.llm import library_ids

TEXT = library_ids.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("high", [1, 2, 40, 50_257, C.MAX_ID + 1])
@pytest.mark.parametrize("count", [0, 1, 2, C.BLOCK - 1, C.BLOCK, C.BLOCK + 1, 3 * C.BLOCK + 7])
def test_round_trip(count, high):
    ids = np.random.default_rng(count).integers(0, high, count)
    assert (C.decode_ids(C.encode_ids(ids)) == ids).all()


def test_repeats_shrink_and_even_ids_hardly_grow():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 40), 300)
    assert len(C.encode_ids(ids)) < 0.6 * 2 * len(ids)
    even = np.random.default_rng(1).integers(0, C.MAX_ID + 1, 9_000)
    assert len(C.encode_ids(even)) < 1.1 * 2 * len(even)


def test_ids_out_of_range():
    for bad in ([-1], [C.MAX_ID + 1]):
        with pytest.raises(ValueError):
            C.encode_ids(np.array(bad))


def test_damage_is_noticed():
    raw = bytearray(C.encode_ids(np.arange(5_000)))
    for at in (0, 5, 9, 40, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            C.decode_ids(bytes(bad))
    with pytest.raises(ValueError):
        C.decode_ids(bytes(raw[:-1]))


def test_blocks_stand_alone():
    ids = np.random.default_rng(2).integers(0, 300, 2 * C.BLOCK)
    second = C.encode_ids(ids[C.BLOCK:])
    assert C.encode_ids(ids).endswith(second) and (C.decode_ids(second) == ids[C.BLOCK:]).all()


@pytest.mark.parametrize("frame", [50, C.FRAME])
def test_files(spark, tmp_path, frame):
    library = Tokenizer.from_str(TEXT)
    C.write_ids(documents(spark), TEXT, str(tmp_path / "ids"), frame=frame)
    got = C.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect()
    want, at = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got), key=lambda r: r[1]) == want


def test_no_documents(spark, tmp_path):
    C.write_ids(no_documents(spark), TEXT, str(tmp_path / "ids"))
    assert C.read_ids(spark, str(tmp_path / "ids")).collect() == []
