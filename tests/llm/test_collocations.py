import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from casegrain.llm import collocations as co


def expected(rows, least, most=2000):
    """The contract word by word, on ``(lang, text)``."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i: i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for phrase, a in candidates.items():
            if any(len(other) > len(phrase) and 100 * b >= 80 * a
                   and any(other[i: i + len(phrase)] == phrase for i in range(len(other)))
                   for other, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((" ".join(phrase), a, f[phrase[:k]], f[phrase[k:]], totals[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:most])]
    return sorted(out)


def mined(docs, **options):
    rows = co.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(map(tuple, rows))


def made(seed, n, words=8):
    rng = random.Random(seed)
    vocabulary = ["of", "The", "new", "york", "city", "Éire", "b-c", "x"][:words]
    lines = ["new york city hall", "the new york times"]
    out = []
    for _ in range(n):
        parts = [rng.choice(lines) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        marks = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in parts]
        out.append((rng.choice(["en", "de", None]), "".join(map("".join, zip(parts, marks)))))
    return out


def test_small_shards_equal_brute_force(spark):
    """Many shards, unions of unions and a filter that lets most through."""
    rows = made(3, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(docs, least=5, shard_words=60, held_counts=40, filter_bits=64) == expected(rows, 5)
    assert mined(docs, least=5, most=3) == expected(rows, 5, 3)


def test_odd_rows(spark):
    """Null text and language, empty and long texts, repeated rows, columns named like the operator's own."""
    rows = [(None, None), ("en", ""), ("en", " , "), (None, "a b"), ("und", "a b"), ("en", "p q r s t " * 5000)]
    rows += [("en", "Same Same")] * 4
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "lang string, text string, range int, phrase string")
    assert mined(docs, least=2) == expected(rows, 2)
    assert mined(docs.limit(0)) == []


def counted(seed, n):
    rng = random.Random(seed)
    return Counter(tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 4))) for _ in range(n))


def automaton(f):
    return co.CountTransducer.of(co.Counted.of(f.items()))


def test_transducer_keeps_phrases_and_counts():
    f = counted(1, 200)
    transducer = automaton(f)
    assert transducer.counted().items() == sorted(f.items())
    # Minimal: no two states have the same finality and arcs.
    arcs = [tuple(zip(transducer.labels[a:b], transducer.targets[a:b]))
            for a, b in zip(transducer.starts, transducer.starts[1:])]
    assert len(set(zip(transducer.final, arcs))) == len(arcs)
    assert automaton({(b"x", b"z"): 1, (b"y", b"z"): 9}).final.tolist() == [True, False, False]


def test_union_and_composition():
    parts = [counted(i, 60) for i in range(5)]
    transducers = [automaton(p) for p in parts]
    total = sum(parts, Counter())
    assert co.united(transducers).items() == sorted(total.items())
    assert co.united(transducers, 3).items() == sorted((p, n) for p, n in total.items() if n >= 3)
    known = co.CountTransducer.of(co.united(transducers))
    asked = sorted({*counted(9, 40), (b"a", b"z"), (b"zz",)})
    acceptor = automaton(dict.fromkeys(asked, 0))
    assert sorted(acceptor.composed(known)) == [(p, total[p]) for p in asked if p in total]
    empty = automaton({})
    assert empty.counted().items() == list(acceptor.composed(empty)) == list(empty.composed(known)) == []
    only_empty_phrase = automaton({(): 5})
    assert only_empty_phrase.counted().items() == [((), 5)]


def test_union_sorts_phrases_that_need_several_keys():
    """With 500 words seven places fill a key of 63 bits; phrases of eight words take two."""
    rng = random.Random(7)
    words = [b"%d" % i for i in range(500)]
    phrases = [tuple(rng.choices(words, k=rng.randint(0, 8))) for _ in range(400)]
    parts = [Counter(rng.choices(phrases, k=300)) for _ in range(3)]
    total = sum(parts, Counter())
    assert co.united([automaton(p) for p in parts], 2).items() == sorted((p, n) for p, n in total.items() if n >= 2)


def test_union_holds_a_few_bytes_per_count():
    """It held some 40 bytes per symbol and count, several times over."""
    words = [b"%06d" % i for i in range(1000)]
    found = [[(b"en", words[i], words[j]) for i in range(k, 1000, 2) for j in range(0, 1000, 5)] for k in (0, 1, 0)]
    transducers = [automaton(dict.fromkeys(f, 1)) for f in found]
    tracemalloc.start()
    kept = co.united(transducers, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept.counts) == 100_000 and kept.counts.tolist() == [2] * 100_000
    assert peak < 80 * 300_000


def test_transducers_travel_as_bytes():
    transducer = automaton(counted(2, 100))
    batch = co._packed(5, transducer)
    assert batch.schema.types[0] == pa.int32() and set(batch.schema.types[1:]) == {pa.binary()}
    ((range_, again),) = co._transducers(batch)
    assert range_ == 5 and again.counted().items() == transducer.counted().items()
    ((_, empty),) = co._transducers(co._packed(0, automaton({})))
    assert empty.counted().items() == []


def test_bits_come_from_the_transducers_in_one_step():
    """Two Python steps in a row took two workers per task."""
    f = {(b"en",): 9, (b"en", b"a"): 5, (b"en", b"a", b"b"): 3, (b"fr", b"a", b"b"): 2}
    (out,) = co._bit_places(1 << 20)(iter([co._packed(0, automaton(f))]))
    of = co._Frequent.hashes
    expected = [of(b"en", [b"a"])] + [co._Frequent.of_pair(of(x, [b"a"]), of(x, [b"b"])) for x in (b"en", b"fr")]
    assert out.column("at").to_pylist() == [int(h[0]) % (1 << 20) for h in expected]


def test_each_range_has_a_task_of_its_own(spark):
    """Ranges dealt by hash met in some tasks, which then held several ranges."""
    words = [f"w{i:03d}" for i in range(200)]
    rows = [("en", " ".join(words[i % 200:] + words[: i % 200])) for i in range(800)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found, bounds = co.frequent_phrases(docs, least=5)
    by_file = found.select(F.input_file_name().alias("file"), "range").distinct().groupBy("file").count()
    assert len(bounds) > 1 and {r["count"] for r in by_file.collect()} == {1}


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert mined(docs, least=60) == expected(rows, 60)


def test_a_shard_keeps_texts_and_places_their_words_like_tokens():
    texts = [(b"en", b"The cat,the  Cat\tsat"), (b"fr", b""), (b"en", b"\n!cat"), (b"en", "café en".encode())]
    shard = co._Shard()
    for lang, text in texts:
        shard.add(lang, text)
    assert shard.texts[b"fr"] == [b""] and shard.size == sum(len(co.tokens(t)) + 1 for _, t in texts)
    for lang, symbols, places in shard.ranked():
        words = [w for one, t in texts if one == lang for w in [*co.tokens(t), b"\n"] if w]
        assert symbols == sorted({lang, *words} - {b"\n"})
        assert [symbols[p] if p >= 0 else b"\n" for p in places.tolist()] == words
