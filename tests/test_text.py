import re

import pytest
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators.terms import exploded, with_term_counts


def apply(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("text"))).collect()]


CLEANED = [
    (None, ""),
    ("", ""),
    ("   \t\n", ""),
    ("call +1-555-123-4567 now", "call +<PHONE> now"),
    ("(555) 123-4567", "(<PHONE>"),
    ("4111 1111 1111 1111", "<CARD_NUMBER>"),
    ("4111111111111", "<PHONE>"),
    ("0x" + "aB" * 20, "<CRYPTO_WALLET>"),
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "<CRYPTO_WALLET>"),
    ("see http://x.org/a?m=bob@mail.com end", "see <URL> end"),
    ("from 999.1.2.3 on", "from <IP_ADDRESS> on"),
    ("a\t b c \nd\x1ce", "a b c d e"),
    ("http://x.org tail", "<URL> tail"),
    ("write to jane.doe+x@mail.example.com.", "write to <EMAIL>."),
    ("plain words only", "plain words only"),
]


def test_cleaner(spark):
    assert apply(spark, text.clean, [raw for raw, _ in CLEANED]) == [c for _, c in CLEANED]


def test_cleaner_agrees_with_the_patterns_in_python(spark):
    raw = [
        "café5551234567 x", "٥٥٥١٢٣٤٥٦٧", "www.a.b　c", "é@x.org a@é.org b@x.org",
        "12-34-56-78-90-12-34", "1.2.3.4.5", "a  b", " x ", "0x12 3abc",
    ]
    order = [
        (fixed.EMAIL_PATTERN, fixed.EMAIL_TOKEN), (fixed.PHONE_PATTERN, fixed.PHONE_TOKEN),
        (fixed.CARD_PATTERN, fixed.CARD_TOKEN), (fixed.WALLET_PATTERN, fixed.WALLET_TOKEN),
        (fixed.URL_PATTERN, fixed.URL_TOKEN), (fixed.IP_PATTERN, fixed.IP_TOKEN),
    ]

    def expected(value):
        for pattern, token in order:
            value = re.sub(pattern, token, value)
        return " ".join(value.split())

    assert apply(spark, text.clean, raw) == [expected(v) for v in raw]


def test_cleaner_options(spark):
    raw = ["a@b.org http://x.org"]
    assert apply(spark, lambda c: text.clean(c, mask_pii=False), raw) == ["a@b.org <URL>"]
    assert apply(spark, lambda c: text.clean(c, preserve_urls_domains=True), raw) == [
        "<EMAIL> http://x.org"
    ]


def test_every_kind_of_whitespace_is_collapsed(spark):
    blanks = [chr(i) for i in range(0x10000) if re.fullmatch(r"\s", chr(i))]
    assert sorted(blanks) == sorted(fixed.WHITESPACE_CHARACTERS)
    assert apply(spark, text.collapse_whitespace, [f"a{b}b" for b in blanks]) == ["a b"] * len(blanks)


def test_word_count(spark):
    assert apply(spark, lambda c: text.word_count(text.clean(c)), [None, "", "a", " a  b "]) == [0, 0, 1, 2]


def test_tokens_are_unicode_words(spark):
    raw = ["Él vio a b2_c, l'été; x²", "", "...", "ÀÉ"]
    expected = [re.findall(r"\b\w+\b", r.lower()) for r in raw]
    assert apply(spark, text.tokens, raw) == expected


def test_analyzer_builds_pairs_after_stop_words(spark):
    terms = apply(spark, lambda c: text.with_bigrams(text.content_words(c)), ["The cat and a big dog", "the", "Cat"])
    assert terms == [["cat", "big", "dog", "cat big", "big dog"], [], ["cat"]]


def test_term_counts_inside_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id int, t array<string>")
    counted = with_term_counts(df, F.col("t"))
    rows = exploded(counted, ["id"], "terms", "x").select("id", "x.*").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (1, "b", 2)]
    assert counted.where("id = 2").first()["terms"] == []


RULE_TEXTS = [
    ("lost money in a crypto scam", "online_financial_fraud"),
    ("Please VERIFY your card", "phishing_smishing"),
    ("they were doxxing me", "cyber_harassment_blackmail"),
    ("CVE-2024-1234 exploited", "cyber_threat_intelligence"),
    ("item never delivered", "ecommerce_fraud"),
    ("they recorded you", "sextortion"),
    ("opened without consent", "identity_threat"),
    ("phishing and a data breach", "phishing_smishing"),
    ("nothing of note", "online_financial_fraud"),
    ("", "online_financial_fraud"),
    (None, "online_financial_fraud"),
    ("threatens", "online_financial_fraud"),
]


def test_keyword_rules(spark):
    assert apply(spark, text.taxonomy, [t for t, _ in RULE_TEXTS]) == [c for _, c in RULE_TEXTS]


def test_default_category_is_a_parameter(spark):
    assert apply(spark, lambda c: text.taxonomy(c, default="x"), ["none"]) == ["x"]


def test_pattern_predicate_reads_null_as_no(spark):
    assert apply(spark, lambda c: text.matches(c, "Money transfer|virtual"), [None, "MONEY TRANSFER", "x"]) == [
        False, True, False
    ]


def test_formats(spark):
    row = spark.range(1).select(
        text.pretty_label(F.lit("online_financial_fraud")),
        text.thousands(F.lit(1234567)),
        text.two_decimals(F.lit(3.5)),
        text.prefix(F.lit("sextortion")),
        text.occurrences(F.lit("<URL> a <URL>"), "<URL>"),
        text.case_line(F.lit(1), F.lit(2.5), F.lit("d1"), F.lit(None), F.lit("s")),
    ).first()
    assert list(row) == [
        "Online Financial Fraud", "1,234,567", "3.50", "sext", 2,
        "#1 [Score: 2.5000] - ID: d1 | Category: unknown | Source: s",
    ]


@pytest.mark.parametrize("text_in,flags", [("a@b.org", (1, 0, 0)), ("<EMAIL>", (0, 0, 0))])
def test_residual_pii(spark, text_in, flags):
    row = spark.createDataFrame([(text_in,)], "t string").select(
        text.has_email(F.col("t")), text.has_phone(F.col("t")), text.has_card(F.col("t"))
    ).first()
    assert tuple(map(int, row)) == flags


def test_a_mask_of_ones_own_is_always_tried(spark):
    df = spark.createDataFrame([("meet Bob",), ("a@b.org and Bob",), (None,)], "t string")
    mine = lambda c: F.regexp_replace(c, "Bob", "<NAME>")
    out = df.select(text.masked_by(F.col("t"), [text.mask_email, mine]).alias("t")).collect()
    assert [r.t for r in out] == ["meet <NAME>", "<EMAIL> and <NAME>", None]
    plain = df.select(text.masked_by(F.col("t"), [text.mask_email]).alias("t")).collect()
    assert [r.t for r in plain] == ["meet Bob", "<EMAIL> and Bob", None]


def test_route_cap_binds_on_the_smallest_tables(spark, data):
    """The registered query's rules with a cap below what they hit: the first ids of each route."""
    from casegrain.operators import records
    from casegrain.plans.text_queries import ROUTES

    docs = spark.read.parquet(f"{data}/documents.parquet")
    hits = [(r["route"], r["doc_id"]) for r in records.routed(docs, ROUTES, ["doc_id"]).collect()]
    kept = [(r["route"], r["doc_id"]) for r in records.routed(docs, ROUTES, ["doc_id"], cap=100).collect()]
    expected = [(route, i) for route in range(3) for i in sorted(d for r, d in hits if r == route)[:100]]
    assert sorted(kept) == expected and len(kept) < len(hits)
