"""Token-id files: the code's round trip, tokenizing by word, the files, checksums and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import idfiles

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(docs, end=2):
    """[(doc_id, start, n_tokens, crc)] of documents given in order, and the whole stream."""
    tokenizer, out, stream = Tokenizer.from_file(PATH), [], []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    return out, stream


@pytest.mark.parametrize("seed", range(4))
def test_code_round_trip(seed):
    rng = np.random.default_rng(seed)
    block = 1000
    n = np.array([block, 1, 31, 32, 33, block, 777])
    ids = (rng.pareto(0.6, (7, block)) * 3).astype(np.int64) % [60_000, 3, 1, 500][seed]
    symbols, f, bits = idfiles.scaled(dict(Counter(np.concatenate([x[:k] for x, k in zip(ids, n)]).tolist())), 14)
    assert f.sum() == 1 << bits and f.min() >= 1
    rank = np.minimum(np.searchsorted(symbols, ids), len(symbols) - 1)
    payload = idfiles.compress(rank, n, f, bits)
    back = idfiles.decompress(payload, n, f, bits)
    assert all((back[b, :k] == rank[b, :k]).all() for b, k in enumerate(n))
    one = idfiles.decompress(payload[2:3], n[2:3], f, bits)  # any block by itself
    assert (one[0, :31] == rank[2, :31]).all()


def test_code_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.02, (8, 16384)), 999)
    symbols, f, bits = idfiles.scaled(dict(Counter(ids.ravel().tolist())))
    p = np.unique(ids, return_counts=True)[1] / ids.size
    size = sum(map(len, idfiles.compress(np.searchsorted(symbols, ids), np.full(8, 16384), f, bits)))
    assert size < 1.03 * ids.size * -(p * np.log2(p)).sum() / 8


def test_scaled_tables():
    for counts in ({}, {5: 1}, {i: 1 for i in range(5000)}, {1: 10**15, 2: 1, 3: 1}, {i: 10 ** (i % 12) for i in range(3000)}):
        symbols, f, bits = idfiles.scaled(counts, 12)
        assert symbols.tolist() == sorted(counts) and (not counts or f.sum() == 1 << bits and f.min() >= 1)


def test_checksum_of_parts():
    rng = random.Random(3)
    data = rng.randbytes(5000)
    cuts = sorted({0, 5000, *rng.sample(range(5000), 9)})
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        total ^= idfiles.moved(zlib.crc32(data[a:b]), 5000 - b)
    assert total == zlib.crc32(data)


def test_words_are_encoded_as_in_the_text():
    import pyarrow as pa

    texts = ["don't STOP  the\tcafé\n\nstop", "", " lead and trail ", "<|endoftext|>x <|startoftext|>", "éa ́b  nbsp em 　wide", "ΣΑΣ ǅ İstanbul ﬁ 東京 1234 한글", "a" * 300 + " !!?? ...", "Stop. stop, STOP?! stop.' it's. a.b x1. (end)."]
    tokenizer = Tokenizer.from_file(PATH)
    ids, length = idfiles._Words(tokenizer).ids(pa.array(texts))
    assert idfiles._Words(tokenizer).plain
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and length.tolist() == [len(w) for w in want]


def test_a_tokenizer_that_joins_over_spaces_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words with spaces")], "doc_id long, text string")
    other = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(Exception, match="word by word"):
        idfiles.write_ids(docs, f"{tmp_path}/a", other, 50256)
    idfiles.write_ids(docs, f"{tmp_path}/b", other, 50256, by_word=False)
    [r] = idfiles.read_documents(spark, f"{tmp_path}/b").collect()
    ids = [*Tokenizer.from_file(other).encode("some words with spaces", add_special_tokens=False).ids, 50256]
    assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_files_of_the_given_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want, stream = brute(sorted(map(tuple, docs.collect())))
    path = f"{tmp_path}/ids"
    idfiles.write_ids(docs.repartition(7), path, PATH, 2, block=256, shard_ids=20_000)
    assert sorted(map(tuple, idfiles.read_documents(spark, path).collect())) == want
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert len({b.shard for b in blocks}) > 3 and max(b.n for b in blocks) == 256
    a, b = len(stream) // 3, len(stream) // 3 + 1000
    assert [r.id for r in idfiles.read_range(spark, path, a, b).orderBy("place").collect()] == stream[a:b]


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"words of text {i} " * 40) for i in range(9)], "doc_id long, text string")
    path = f"{tmp_path}/ids"
    idfiles.write_ids(docs, path, PATH, 2, block=256)
    blocks = spark.read.parquet(f"{path}/blocks")
    bad = spark.createDataFrame([r.asDict(True) | {"payload": bytes(r.payload[:-3]) + b"abc"} if r.block == 1 else r.asDict(True) for r in blocks.collect()], blocks.schema)
    with pytest.raises(Exception, match="checksum"):
        idfiles.read_segments(spark, path, bad).collect()


def test_odd_rows(spark, odd, nothing, tmp_path):
    idfiles.write_ids(odd, f"{tmp_path}/odd", PATH, 2, block=128, shard_ids=1000)
    got = sorted(map(tuple, idfiles.read_documents(spark, f"{tmp_path}/odd").collect()), key=lambda r: r[1])
    rows = [tuple(r) for r in odd.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert got == brute([r[:2] for r in rows])[0]
    assert [r[2] for r in got if r[0] in (2, 3, 4)] == [1, 1, 1]
    idfiles.write_ids(nothing, f"{tmp_path}/none", PATH, 2)
    assert idfiles.read_documents(spark, f"{tmp_path}/none").collect() == []
