import random

import numpy as np
import pytest
import xxhash

from casegrain.llm import simhash
from casegrain.llm.components import connected_components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            parent[root(i)] = root(int(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(doc_id, low.get(root(i), doc_id))
    return sorted(((d, f"{p:016x}", low.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == expected(rows)
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in expected(rows)})


def near_texts(n, seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(900)]
    out = []
    for _ in range(n):
        copy = list(words)
        copy[rng.randrange(900)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, "É"), (7, "é"),
            (8, "w " * 30_000), (9, "w " * 30_001), (9, "w " * 30_001), (10, "a b c"), (11, "a b c d")]
    rows += [(100 + i, t) for i, t in enumerate(near_texts(60, 1) + near_texts(60, 2))]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, value int")
    assert result(simhash.near_duplicates(docs)) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.without_near_copies(docs).collect()]
    classes = {c for _, _, c in expected(rows)}
    assert sorted(i for i in kept if i is not None) == sorted(c for c in classes if c is not None)


@pytest.mark.parametrize("piece", [4096, 40])
def test_crowded_bands_lose_no_link(spark, monkeypatch, piece):
    """Thousands of values that agree in three bands; cut into pieces when ``piece`` is small."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(7)
    low = rng.choice(1 << 16, 1500, replace=False).astype(np.int64)
    other = rng.integers(-(2**62), 2**62, 500)
    values = np.concatenate([low + (0x0123 << 16), other, other ^ (1 << 40) ^ 5, other[:20] ^ 0xF])
    df = spark.createDataFrame([(int(v),) for v in values], "value long")
    got = {r["value"]: r["component"] for r in simhash.near_classes(df).collect()}
    bits = values.view(np.uint64)
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3):
            parent[root(int(values[i]))] = root(int(values[j]))
    classes = {}
    for v in parent:
        classes.setdefault(root(v), set()).add(v)
    found = {}
    for v, c in got.items():
        found.setdefault(c, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 500)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(500)}, 900: 900, 901: 900}
    assert connected_components(df.limit(0)).count() == 0
