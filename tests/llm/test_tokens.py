"""BPE, unigram counts and packing against the public libraries and exact round trips."""

import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from handbill.llm import byte_bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b", "a \n b", "\x1cx y", "a\x85 b", "x" * 5000, "abab" * 700, "don't  stop", "é" * 900 + " b", "😀 😀😀", "²½ xª º1 µ", "a　 b", "\n\n a b\t c"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x400, 0x450), rng.randrange(0x3000), 32, 10]))
    return ODD + ["".join(alphabet() for _ in range(rng.randrange(1, 90))) for _ in range(3000)] + ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(500)]


def test_bpe_equals_the_library(texts):
    ranks = byte_bpe.read_ranks(RANKS)
    ours, decoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), byte_bpe.Decoder(ranks)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_bpe_where_a_merge_makes_a_pair_of_a_lower_rank():
    """An early vocabulary: 'aba' ranks below 'ab', so order matters within a pre-token."""
    ranks = {bytes([k]): 10 + k for k in range(256)} | {b"ba": 0, b"aba": 1, b"ab": 5, b"abab": 2, b"cc": 3, b"bc": 6}
    theirs = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    ours = byte_bpe.Encoder(ranks, r"\p{L}+")
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)


def test_bpe_tables(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = sorted(bytes(r.bytes) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert back == [b"", b"", b"hello world", b"hello world"]
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def unigram():
    vocabulary = token_counts.read_vocabulary(MODEL)
    known = [("<unk>", 0.0), ("filler", vocabulary.lowest), *vocabulary.pieces.items()]
    theirs = Tokenizer(models.Unigram(known, 0, False))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return token_counts.Counter(vocabulary), theirs


def test_counts_equal_the_library(unigram, texts):
    ours, theirs = unigram
    ids = {text: theirs.encode(text) for text in texts if text and token_counts.BLANK not in text}
    for text, encoded in ids.items():
        unknown = [s for s, k in zip(encoded.offsets, encoded.ids, strict=True) if k == 0]
        normal = token_counts.BLANK + text.replace(" ", token_counts.BLANK) if not text.startswith(" ") else None
        if normal is None:
            continue  # the library leaves a leading blank as it is
        count = len(encoded.ids) - len(unknown) + sum(len(text[a:b].encode()) for a, b in unknown)
        assert ours.count(text)[0] == count, text


def test_counts_equal_the_model_library(unigram, texts):
    """The same pieces as a unigram model of the public library, with the file's own normaliser: none."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    assert model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces
    model.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    theirs, (ours, _) = SentencePieceProcessor(model_proto=model.SerializeToString()), unigram
    for text in texts:
        if token_counts.BLANK not in text and "\0" not in text:
            assert ours.count(text)[0] == len(theirs.encode(text)), text


def test_parts_add_up(unigram, texts):
    ours, _ = unigram
    for text in texts[:400]:
        whole = ours.part(token_counts.BLANK + text.replace(" ", token_counts.BLANK)) if text else 0j
        assert ours.count(text) == (int(whole.real), whole.imag)


def test_count_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n_tokens string, score string")
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0
    found = token_counts.token_counts(docs, MODEL).collect()
    assert sorted((r.n_tokens, r.n_chars) for r in found) == [(0, 0), (0, 0), (2, 3), (2, 3)]


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([1, 7, 64, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(40))]
        rows, left = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [room for room in left if room >= lengths[k]]
            if fits:
                at = left.index(min(fits))
                rows[at].append(k)
                left[at] -= lengths[k]
            else:
                rows.append([k])
                left.append(capacity - lengths[k])
        ours = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for row in ours for k in row) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[k] for k in row) for row in ours) == sorted(left)


def test_packing_is_lossless(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 50000, n).astype("<u4").tobytes(), "x") for k, n in enumerate([0, 1, 5, 16, 17, 100, 3, 3, 9])] + [(3, b"", "x"), (None, b"\1\0\0\0", "x"), (5, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, ids binary, shard string")
    packed = packing.pack(table, capacity=16, pad_id=9, end_id=50256, shard_tokens=60).collect()
    docs = {}
    for r in packed:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 16 and r.n_tokens + r.pad == 16 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == 9).all() and r.resets == r.cu_seqlens[:-1] == np.flatnonzero(positions[: r.n_tokens] == 0).tolist()
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            docs.setdefault(doc, []).append((part, ids[a:b].tobytes()))
            assert positions[a:b].tolist() == list(range(b - a))
    end = np.uint32(50256).astype("<u4").tobytes()
    for doc in {r[0] for r in rows}:
        want = sorted((r[1] or b"") + end for r in rows if r[0] == doc)
        if len(want) == 1:
            assert b"".join(x for _, x in sorted(docs[doc])) == want[0]
        else:
            assert sum(len(x) for _, x in docs[doc]) == sum(map(len, want))
    assert packing.pack(table.limit(0)).count() == 0


def test_repeated_rows_spread_over_shards(spark):
    one = np.arange(50, dtype="<u4").tobytes()
    table = spark.createDataFrame([(7, one)] * 400 + [(None, one)] * 400, "doc_id long, ids binary").repartition(3)
    packed = packing.pack(table, capacity=64, shard_tokens=2000).collect()
    sizes = {}
    for r in packed:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_tokens
    assert sum(sizes.values()) == 800 * 50 and max(sizes.values()) < 4 * 2000
    assert all(np.frombuffer(r.ids, "<u4")[a:b].tobytes() == one for r in packed for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
