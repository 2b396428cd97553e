import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import mixing


def expected_targets(sizes):
    """The excess is shared out again until nobody is above; ``sizes`` by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@settings(max_examples=15, deadline=None)
@given(sizes=st.dictionaries(st.one_of(st.none(), st.text("abcé😀", max_size=2)), st.integers(0, 1000), max_size=8))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def check(rows, mix, options=()):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    target = expected_targets(sizes)
    for r in mix:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        draw = int(hashlib.md5(f"42|{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["copies"] == math.floor(rate) + (draw < rate - math.floor(rate))
        assert r["copies"] * r["size"] <= 2 * r["size"]


def test_whole_table_comes_near_its_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mix = mixing.mixture(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], mix)
    taken = sum(r["copies"] * r["size"] for r in mix)
    assert taken == pytest.approx(1.5 * sum(r["size"] for r in mix), rel=0.1)


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", "empty"), (None, "c " * 9000, None), (4, "q\x0bw e", "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    mix = mixing.mixture(docs).collect()
    assert len(mix) == len(rows)
    check(rows, mix)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(
        {i: n for i, n in Counter(r["doc_id"] for r in mix for _ in range(r["copies"])).items()})
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, out.collect()))
