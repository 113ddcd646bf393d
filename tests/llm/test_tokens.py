"""The token store against texts encoded one by one, and its index against every key."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_fixtures import DIR, edge_docs, edge_rows, no_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsmart.llm import tokens as K
from newsmart.sources.versions import work_dir

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(WORD)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def new_path(spark):
    import uuid

    return f"{work_dir(spark)}/tokens/{uuid.uuid4().hex}"


def ids_of(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def test_words_one_by_one_make_the_whole(plain):
    odd = ["é́ x", "áb ́c", "ΑΣ ΣΑΣ. Σ", "İI ﬁ ﬃ　x", "<|endoftext|> a<|startoftext|>b <|end oftext|>", "x\x00y \x1c\x85z", "don't'll 'S 12 3",
           "A1b22,c-- D'S it'll x<y <|ENDOFTEXT|> a.b.c 3.14e10 _x_ ABC", "👩‍👩‍👧 क्षि กำ 한국 한", "", " \t\n\x0b\x0c\r ", "﻿a ​b c", "##  # !\"", "a" * 3000]
    rng = np.random.default_rng(4)
    signs = [*" \t\ṇ́ΣσİiſẞAa'sé😀<|>#.0 하"]
    odd += ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(300)]
    ids, n = K.Encoder(WORD, 2, True)(pa.array([*odd, None]))
    ends = np.cumsum(n)
    for text, lo, hi in zip([*odd, None], ends - n, ends, strict=True):
        assert ids[lo:hi].tolist() == plain(text), text


def test_tokenizers_that_need_whole_texts_are_refused():
    with pytest.raises(ValueError, match="piece by piece"):
        K.Encoder(BYTE, 0, True)


def test_pieces_are_forgotten_beyond_the_bound(monkeypatch, plain):
    monkeypatch.setattr(K, "KNOWN_PIECES", 3)
    encode = K.Encoder(WORD, 2, True)
    for text in ("one two three four", "two five", "", "one six"):
        assert encode(pa.array([text]))[0].tolist() == plain(text)


def test_query(spark, plain):
    got = {r.doc_id: r for r in K.op12_token_store(spark, DIR).collect()}
    start = 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(plain(r.text), "<u4")
        o = got.pop(r.doc_id)
        assert (o.start, o.n_tokens, o.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("levels", [0, 2, K.LEVELS])
@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_index_gives_every_key_a_number_of_its_own(n, levels):
    rng = np.random.default_rng(n)
    n = min(n, 200) if levels == 0 else n
    a, b = rng.integers(0, 2**64, (2, n), np.uint64)
    a[: n // 2] = 7  # alike in one of the two hashes
    offset = np.arange(n) * 3
    index = K.HashIndex.from_bytes(K.HashIndex.build(a, b, np.full(n, 5), offset, offset + 1, levels).to_bytes())
    assert sorted(index.numbers(a, b).tolist()) == list(range(n))
    there, slots = index.find(a, b)
    assert there.all() and (slots["offset"] == offset).all() and (slots["n"] == offset + 1).all() and (slots["shard"] == 5).all()
    other = rng.integers(0, 2**64, (2, 1000), np.uint64)
    assert not index.find(*other)[0].any()


def test_edges(spark, edge_docs, no_docs, plain):  # noqa: F811
    path = new_path(spark)
    K.write_tokens(edge_docs, path, WORD, 2, by_piece=True, bucket=3)
    rows = K.read_tokens(path, K.all_keys(edge_docs)).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), r.text is not None, (r.text or "").encode()) for r in edge_docs.collect())
    rows.sort(key=lambda r: r.start)
    texts = [t.decode() for _, _, t in want]
    assert [r.key for r in rows] == [k[1] if k[0] else None for k, _, _ in want]
    assert [ids_of(r) for r in rows] == [plain(t) for t in texts]
    assert [r.start for r in rows] == np.cumsum([0, *(len(plain(t)) for t in texts)])[:-1].tolist()
    assert [r.occurrence for r in rows if r.key == 0] == [0, 1]
    other = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (99, 0), (None, 0), (None, 1)], "key long, occurrence long")
    assert sorted((r.key if r.key is not None else -1, r.occurrence) for r in K.look_up(path, other).collect()) == [(-1, 0), (0, 1), (0, 1)]
    path = new_path(spark)
    K.write_tokens(no_docs, path, WORD, 2)
    assert K.read_tokens(path, other).count() == 0


def test_other_keys_and_tokenizers(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(F.concat(F.lit("k"), "doc_id").alias("name"), "text").limit(30)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    path, tokenizer = new_path(spark), Tokenizer.from_file(BYTE)
    K.write_tokens(docs, path, BYTE, 50256, id_col="name", vocabulary=1 << 17)
    texts = {r.name: r.text for r in docs.collect()}
    rows = K.read_tokens(path, K.all_keys(docs, "name")).collect()
    assert len(rows) == 30
    for r in rows:
        assert ids_of(r) == [*tokenizer.encode(texts[r.key] or "", add_special_tokens=False).ids, 50256]
