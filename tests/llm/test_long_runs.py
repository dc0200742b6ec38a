import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bomspark.llm import packing


@pytest.mark.parametrize("run", [" ", "\n", " ", "a", "7", "!", "é"])
def test_one_very_long_run(run):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "x " + run * 1_200_000 + "a"
    plain = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.tokenizer(path)([text])[0].tolist() == plain


def test_checksums_of_pieces(docs):
    """Ids of ``tokenizers``, end id, cut and checksum of every piece."""
    texts = ["short", "", None, " " * 60_000 + "b", "word " * 3_000]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.pack(docs(texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(got[i], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
