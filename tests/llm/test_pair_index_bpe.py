import hashlib
import random

import numpy as np
import public_tokenizers
from edge_rows import EDGE
from tokenizers import Tokenizer

import netweir.llm.pair_index_bpe as pb
from netweir.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(5)
    letters = "aAbB éÉß ñ0123٣½ \n\t\x1c\x85\xa0 'stre.,!?-_İΣσςǅ中文😀éͅⅧ²_ªº‍﻿"
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    return odd + [t for _, t in EDGE if t] + ["<|startoftext|>hi <|endoftext|>there<|endoftext|>", "aaaaaaa aaaa aa", "it's they'll WE'VE", "ΑΣ ΟΔΟΣ", "banana bananas BANANA", "a" * 3000]


def test_same_as_the_library(monkeypatch):
    code, whole = pb.PairIndexBpe(PATH), Tokenizer.from_file(PATH)
    for cache in (500_000, 50):  # with room for all chunks, and for few
        monkeypatch.setattr(pb, "CACHE", cache)
        code.prepare(texts())
        for t in texts():
            ids, shown = code.encode(t)
            want = whole.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, t
            assert shown == code.decode(ids) == whole.decode(want, skip_special_tokens=False)
        code = pb.PairIndexBpe(PATH)


def test_operators(spark, edge_docs, no_docs):
    whole = Tokenizer.from_file(PATH)
    encoded = pb.encode_texts(edge_docs, PATH)
    rows = encoded.collect()
    assert len(rows) == len(EDGE)
    want = sorted((str(i), whole.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    decoded = sorted((str(r.doc_id), r.text) for r in pb.decode_ids(encoded, PATH).collect())
    assert decoded == sorted((i, whole.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert pb.digests(no_docs, PATH).collect() == []


def test_query(spark, sf_dir):
    whole = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op7_pair_index_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
