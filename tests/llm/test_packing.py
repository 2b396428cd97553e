import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casegrain.llm import packing, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def expected_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [packing.END]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abIt's re'll 12²½é ÀßŸ<|endoftext|>,.!ſıİ\t\n\x1c\x85\xa0ΣάȺﬁ"),
                                  st.characters(exclude_categories=("Cs",))), max_size=40))
def test_ids_equal_the_tokenizer(text):
    ids = np.frombuffer(tokens.word_ids().encode(text), "<u4").tolist()
    assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    """``texts``: (doc_id, text) of every row; ids unique or texts equal per id."""
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(expected_ids(text))
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= pieces[0]["tier"] <= 4096
    assert set(by_doc) == set(wanted)
    for doc_id, pieces in by_doc.items():
        ids = wanted[doc_id][0]
        covered = defaultdict(int)
        for r in pieces:
            part = ids[r["start"]: r["start"] + r["length"]]
            assert len(part) == r["length"] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            if "ids" in r.asDict():
                assert list(r["ids"]) == part
            for i in range(r["start"], r["start"] + r["length"]):
                covered[i] += 1
        assert covered == dict.fromkeys(range(len(ids)), len(wanted[doc_id]))
    return sequences


def padding(sequences):
    open_, filled = 0, 0
    for pieces in sequences.values():
        n = sum(r["length"] for r in pieces)
        filled += n
        open_ += 0 if n & (n - 1) == 0 else 4096 - n
    return open_ / (open_ + filled)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sequences = check(packing.packed(docs).collect(), texts)
    assert padding(sequences) < 0.03


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "one two", 9), (3, "same words here " * 4, 9),
            (3, "same words here " * 4, 9), (4, "long " * 20_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    check(packing.packed(docs).collect(), [r[:2] for r in rows])
    assert packing.packed(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4095), max_size=60))
def test_only_the_last_window_is_open(lengths):
    pool = [packing.Piece(n, i, 0, i, b"") for i, n in enumerate(lengths)]
    windows, rest = packing.pack(pool, packing.TIERS)
    assert all(sum(p.length for p in w.pieces) == w.tier for w in windows)
    last = packing.cut_down(list(rest), packing.TIERS)
    assert sum(sum(p.length for p in w.pieces) == w.tier for w in last) >= len(last) - 1
    assert sum(p.length for w in windows + last for p in w.pieces) == sum(lengths)


def test_step_groups_are_balanced():
    windows = [packing.Window(t, []) for t in packing.TIERS for _ in range(40)]
    groups = packing.step_groups(windows, 1 << 14)
    loads = defaultdict(int)
    for w, g in zip(windows, groups):
        loads[g] += w.tier
    assert max(loads.values()) - min(loads.values()) <= 64


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4096, 4097])
def test_cut_down_keeps_every_token(n):
    parts = packing.cut_down([packing.Piece(n, 0, 0, 0, b"")], packing.TIERS)
    assert sum(p.length for w in parts for p in w.pieces) == n
