"""Packing: exact round trip, gapless sequences, few of them."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cartolith.llm import packing
from cartolith.llm.queries import tokenizer_path


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_pack_holds_every_document(which, request):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    packed = packing.pack(df, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    got = packed.collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // 2048) * 1.02 + 1
    assert packing.sequences(packed).count() == len(held)


def test_encoder_libraries_agree():
    plain, fast = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    for text in ["", " ", "a  b\n\n c\t", "It's l'été — ½ ²³", "x<|endoftext|>y", "ﬁ漢字\u00a0z\u0085", "\x1c\x1d a", "naïve ÀÉ 1234", "don't  stop\r\n ", " " * 1_200_000 + "x", "\n\t" * 600_000 + "x"]:
        assert list(plain.encode(text)) == list(fast.encode(text)), text[:20]


def test_added_tokens_have_their_ids(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "漢 <|endoftext|>", "<|endoftext|" + " " * 2000 + "<|endoftext|>", "<|ENDOFTEXT|> <| endoftext|>"]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids[0] == [64, 220, 50256, 275, 0]
    for ranks in (None, tokenizer_path("byte_bpe_50k.tiktoken")):
        encoder = packing.Encoder(tokenizer_path(), ranks)
        assert [list(encoder.encode(t)) for t in texts] == ids
        packed = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer_path(), ranks)
        want = {(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}
        assert {(r.doc_id, r.length, r.ids_crc32) for r in packed.collect()} == want


def _covered(used):
    covered = np.zeros(2049, np.int64)
    for config, times in used.items():
        assert sum(n * k for n, k in config) <= 2048 and times > 0
        for n, k in config:
            covered[n] += k * times
    return covered


@pytest.mark.parametrize("pieces", [0, 1, 40, 60_000])
def test_configurations_cover_exactly(pieces):
    rng = np.random.default_rng(pieces)
    need = np.bincount(np.minimum(2048, rng.gamma(2, 300, pieces).astype(int) + 1), minlength=2049)
    used = packing.configurations(need)
    assert (_covered(used) == need).all()
    assert sum(used.values()) <= -(-int(need @ np.arange(2049)) // 2048) * 1.01 + 1


def test_work_goes_by_lengths_and_not_by_pieces(monkeypatch):
    """A histogram like that of the documents, once and 10,000 times: priced steps, configurations, sequences."""
    rng, steps = np.random.default_rng(5), []
    own = packing.Cover.step
    monkeypatch.setattr(packing.Cover, "step", lambda self: steps.append(1) or own(self))
    need = np.bincount(np.minimum(2048, rng.lognormal(6, 1.1, 6000).astype(int) + 1), minlength=2049)
    found = []
    for times in (1, 10_000):
        steps.clear()
        used = packing.configurations(need * times)
        assert (_covered(used) == need * times).all() and len(used) <= len(steps) + 1
        found.append((len(steps), sum(used.values()) / (int(need @ np.arange(2049)) * times / 2048)))
    assert found[1][0] < 2.5 * found[0][0] and found[1][0] < 2 * np.count_nonzero(need)
    assert all(ratio < 1.01 for _, ratio in found)
