import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import phrase_parsing as parsing


def plain_sketch(text):
    return parsing.sketches([text])[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é😀", max_size=60), min_size=1, max_size=6))
def test_a_text_is_parsed_alike_alone_and_among_others(texts):
    together = parsing.sketches(texts)
    for i, text in enumerate(texts):
        assert (together[i] == plain_sketch(text)).all()


def names_at(text, level):
    """Phrase names of one text with the code points each covers."""
    names = parsing.mix(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + parsing._ODD)
    spans = [(i, i + 1) for i in range(len(text))]
    for _ in range(level):
        runs = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        sizes = np.diff(np.append(runs, len(names))).astype(np.uint64)
        merged = np.where(sizes > 1, parsing.mix(names[runs] + parsing._ODD * sizes), names[runs])
        ends = [*runs[1:], len(names)]
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(runs, ends)]
        first = np.zeros(len(merged), bool)
        first[0] = True
        starts = np.flatnonzero(parsing.phrase_starts(merged, first))
        names = parsing.names_of(merged, starts)
        ends = [*starts[1:], len(merged)]
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(starts, ends)]
    return list(zip(names.tolist(), spans))


def test_names_hash_the_substring_and_interiors_do_not_depend_on_the_offset():
    rng = random.Random(1)
    words = ["the", "ration", "of", "aaaa", "bleeding", "xyzzy", "mentation", "on"]
    shared = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(400))
    one = "A quite different beginning. " + shared + " end"
    other = "short " + shared + " something else follows here"
    for level in (1, 2, 3):
        a, b = names_at(one, level), names_at(other, level)
        substring = {}
        for text, found in ((one, a), (other, b)):
            for name, (start, end) in found:
                assert substring.setdefault(name, text[start:end]) == text[start:end]
        margin = 200
        inside = lambda text, found: {
            (n, s - text.index(shared)) for n, (s, e) in found
            if text.index(shared) + margin < s and e < text.index(shared) + len(shared) - margin}
        assert inside(one, a) == inside(other, b) and len(inside(one, a)) > 20


def test_phrases_are_short_and_not_single():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    first = np.zeros(len(names), bool)
    first[0] = True
    sizes = np.diff(np.flatnonzero(parsing.phrase_starts(names, first)))
    assert sizes.min() >= 2 and sizes.max() <= 16 and sizes.mean() < 5


def test_likeness_follows_the_shared_part():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    near = parsing.likeness(plain_sketch(text), plain_sketch(parsing.edited(text, other)))
    assert 0.3 < near < 0.75
    assert parsing.likeness(plain_sketch(text), plain_sketch(other)) < 0.1
    assert parsing.likeness(plain_sketch(text), plain_sketch(text)) == 1.0
    assert parsing.likeness(plain_sketch(""), plain_sketch("")) == 1.0
    assert parsing.likeness(plain_sketch(""), plain_sketch(text)) == 0.0


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        sketch, other, following = plain_sketch(text), plain_sketch(changed), plain_sketch(following)
        out[doc_id] = (
            len(text), hashlib.sha256(changed.encode()).hexdigest(), *parsing.as_text(np.stack([sketch, other])),
            float(parsing.likeness(sketch, other)), float(parsing.likeness(sketch, following)))
    return out


def as_dict(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(parsing.compared_with_edits(docs)) == expected(rows)
    alone = {r["doc_id"]: r["fingerprint"] for r in parsing.fingerprints(docs).collect()}
    assert alone == {k: v[2] for k, v in expected(rows).items()}


def test_odd_rows(spark):
    rows = [(5, None), (9, ""), (2, "😀😀é"), (7, "x" * 30_000), (1, "ab" * 50), (3, "ab" * 50)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string")
    assert as_dict(parsing.compared_with_edits(docs)) == expected(rows)
    assert parsing.compared_with_edits(docs.limit(0)).count() == 0
    one = parsing.compared_with_edits(docs.where("doc_id = 1"))
    assert as_dict(one) == expected([rows[4]])
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert parsing.compared_with_edits(repeated).count() == 3


M64 = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_level(names):
    """One level on whole numbers: runs, coin tosses, phrases between local minima."""
    runs = []
    for name in names:
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1])
    names = [plain_mix(name + ODD * n & M64) if n > 1 else name for name, n in runs]
    small = names
    for _ in range(4):
        tossed = [small[0] & 1]
        for left, own in zip(small, small[1:]):
            differing = left ^ own
            bit = (differing & -differing).bit_length() - 1 if differing else 64
            tossed.append(2 * bit + (own >> min(bit, 63) & 1))
        small = tossed
    phrases = [[names[0]]]
    for i in range(1, len(names)):
        lowest = small[i] < small[i - 1] and (i + 1 == len(names) or small[i] < small[i + 1])
        if lowest and i > 1:
            phrases.append([])
        phrases[-1].append(names[i])
    return [
        plain_mix(sum(plain_mix(n + ODD * (i + 1) & M64) for i, n in enumerate(p)) + len(p) & M64) for p in phrases]


def sketch_by_hand(text):
    out = [0xFFFF] * 64
    names = [plain_mix(ord(c) + ODD & M64) for c in text]
    for level in range(1, 4):
        names = plain_level(names) if names else []
        for name in names if level > 1 else ():
            name = plain_mix(name + level & M64)
            value = min(plain_mix(name + 1 & M64) >> 48, 0xFFFE)
            out[name % 64] = min(out[name % 64], value)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aab cé😀.", max_size=200))
def test_sketch_equals_plain_whole_numbers(text):
    assert plain_sketch(text).tolist() == sketch_by_hand(text)


def test_sketches_of_the_given_texts(spark, data):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for text, sketch in zip(texts[:60], parsing.sketches(texts[:60])):
        assert sketch.tolist() == sketch_by_hand(text)
