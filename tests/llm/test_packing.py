import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from edge_rows import EDGE
from tokenizers import Tokenizer

from netweir.llm.common import stored
from netweir.llm.packing import ByteLevelEncoder, patterns, place, sequences, slots, token_pieces
from netweir.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity, crc):
    """Every document's ids once, every sequence gapless and no longer than the capacity."""
    whole, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, found in by_doc.items():
        ids = whole.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert crc(r) == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / capacity / len(by_seq)


def test_encoder_equals_the_library():
    code, whole = ByteLevelEncoder(PATH), Tokenizer.from_file(PATH)
    for text in [t for _, t in EDGE if t] + [" lead", "trail ", "a \n b", "a\n\n  b", "tab\tx", "it's I'LL", "１２ ½", "a<|endoftext|>b  c", "\x85x\xa0 y"]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_patterns_use_every_length():
    counts = {7: 3, 5: 4, 3: 10, 1: 2, 10: 6}
    packs = patterns(counts, 10)
    used = Counter()
    for pack, n in packs:
        assert sum(pack) <= 10
        for length in pack:
            used[length] += n
    assert used == counts
    for length, (start, first, offset) in slots(packs).items():
        assert start[0] == 0 and (np.diff(start) > 0).all()
    assert patterns({}, 10) == []


@pytest.mark.parametrize("capacity", [16, 1024])
def test_edges(spark, edge_docs, capacity):
    docs = edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = stored(token_pieces(docs, PATH, capacity).withColumnRenamed("doc_tokens", "doc_tokens"), "pieces")
    placed = place(pieces, ["doc_id", "start"], capacity)
    check(placed.collect(), dict(t for t in EDGE if t[0] is not None), capacity, lambda r: zlib.crc32(r.ids))
    rows = sequences(placed).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert sum(len(r.ids) for r in rows) == 4 * sum(r.length for r in pieces.collect())


def test_repeated_rows_and_empty(spark, edge_docs, no_docs):
    pieces = stored(token_pieces(edge_docs, PATH), "pieces")
    got = place(pieces, ["doc_id", "start"]).collect()
    assert len(got) == pieces.count() and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert place(stored(token_pieces(no_docs, PATH), "pieces"), ["doc_id"]).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(QUERIES["op4_packing"](spark, sf_dir).collect(), texts, 1024, lambda r: r.ids_crc32) > 0.95
