import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspan.llm.bpe_codec import Vocabulary, codec, digest_documents, encode_documents
from reelspan.llm.packing import cuts, encoder, pack_documents

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TRICKY = ["", " ", "\n", " x", "x ", "a  b", "don't we'll it's", "a\rb c\r\n", " a　b", "<|endoftext|>", "x <|endoftext|> y", "é" * 300, "a" * 3000, "ab" * 700, "12345 ...!!!\t\t", "🙂 é́"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(library):
    rng = random.Random(0)
    texts = TRICKY + ["".join(rng.choice("ab cé\n\t'st1.🙂") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    own = codec(RANKS, P.PATTERN)
    for text, (n, ids_sha, decoded_sha) in zip(texts, own.digests(texts)):
        ids = library.encode_ordinary(text)
        assert own.encode(text) == ids and n == len(ids)
        assert ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    own = codec(RANKS, P.PATTERN)
    assert own.vocabulary.decode(own.encode(text)) == text.encode()


def test_tree_alone_equals_trees_in_step():
    v, rng = Vocabulary(RANKS), random.Random(3)
    pieces = [bytes(rng.choice(b"abcdefth \xc3\xa9") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert v.merge_in_step(pieces, 64) == [v.merge_alone(p) for p in pieces]


def test_codec_on_odd_rows(odd):
    out = {(r.doc_id, r.n_tokens) for r in digest_documents(odd, RANKS, P.PATTERN).collect()}
    assert (0, 0) in out and (1, 0) in out and any(d is None for d, _ in out)
    assert digest_documents(odd, RANKS, P.PATTERN).count() == odd.count()
    full = encode_documents(odd.filter("doc_id = 3"), RANKS, P.PATTERN).first()
    assert bytes(full.decoded) == b"one" and len(full.ids) == full.n_tokens
    assert digest_documents(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_ids_equal_the_tokenizers_library():
    rng, t = random.Random(1), Tokenizer.from_file(JSON)
    texts = TRICKY + ["".join(rng.choice("ab cé\n\r\t'st1.🙂") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text, ids in zip(texts, encoder(JSON, P.PATTERN).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_cuts_cover_each_token_once():
    for capacity in (8, 100, 1024):
        for n in [*range(1, 300), 1023, 1024, 1025, 5000]:
            at = 0
            for s, m in cuts(n, capacity):
                assert s == at and 0 < m <= capacity
                at += m
            assert at == n


def check_packed(packed, texts, capacity=1024):
    """Ids, checksums, gapless offsets and little padding, against the library."""
    t = Tokenizer.from_file(JSON)
    whole = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in texts.items()}
    seqs = {}
    for r in packed:
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(whole[r.doc_id]), zlib.crc32(ids.tobytes()))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_packing(documents):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["tion", "there", "schreib", "12"]) for _ in range(rng.choice([0, 1, 5, 200, 900, 4000]))) for _ in range(300)] + [None]
    packed = pack_documents(documents(texts), JSON, P.PATTERN).collect()
    seqs = check_packed(packed, dict(enumerate(texts)))
    tokens = sum(r.length for r in packed)
    assert tokens == sum(r.doc_tokens for r in packed if r.start == 0)
    assert len(seqs) * 1024 < 1.15 * tokens  # a small corpus has an unfilled sequence in every class


def test_packing_odd_rows(odd):
    packed = pack_documents(odd, JSON, P.PATTERN)
    assert rows(packed.filter("doc_id = 1"), "start", "length", "doc_tokens") == [(0, 1, 1)]
    assert packed.filter("doc_id = 4 and start = 0").count() == 2 and packed.filter("doc_id is null").count() == 1
    assert pack_documents(odd.limit(0), JSON, P.PATTERN).count() == 0


def test_pieces_of_one_id_fall_into_all_buckets(spark):
    from reelspan.llm.packing import fill_sequences

    pieces = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0L AS start", "100L AS length", "id AS _row")
    out = fill_sequences(pieces, 1024).selectExpr("(sequence_id >> 20) & 2147483647 AS bucket", "sequence_id", "offset").cache()
    per = [r[1] for r in out.groupBy("bucket").count().collect()]
    assert len(per) >= 20 and max(per) < 3 * 20_000 / len(per)
    assert out.groupBy("sequence_id").agg({"offset": "max"}).filter("`max(offset)` > 900").count() == 0
    out.unpersist()
