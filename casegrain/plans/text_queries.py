"""Registered queries: filters, projections and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators import records
from casegrain.operators.corpus import ingest_agency
from casegrain.plans import sql as q
from casegrain.plans.catalog import registered
from casegrain.plans.standins import corpus, documents, texts
from casegrain.sources.readers import require_columns
from casegrain.workspace import read_table

# --- Filters and projections ------------------------------------------------------


@registered("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def filter_equal(spark, sf):
    return records.with_value(documents(spark, sf), "lang", "en").select("doc_id", "source", "n_chars")


@registered("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def filter_in(spark, sf):
    return records.with_any_value(documents(spark, sf), "lang", ["fr", "de"]).select("doc_id", "lang")


@registered("""
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL""")
def drop_nulls(spark, sf):
    joined = read_table(spark, sf, "documents").select("doc_id").join(
        read_table(spark, sf, "labels"), "doc_id", "left"
    )
    return records.without_nulls(joined, ["quality"]).select("doc_id", "quality")


@registered("""
SELECT doc_id, coalesce(regexp_matches(text, '(?i)license|copyright'), false) AS hit
FROM documents""")
def pattern_predicate(spark, sf):
    return documents(spark, sf).select("doc_id", text.matches(F.col("text"), "license|copyright").alias("hit"))


@registered("""
SELECT doc_id FROM documents
WHERE regexp_matches(source, '(?i)SRC1') OR regexp_matches(text, '(?i)password|key')""")
def pattern_or(spark, sf):
    wanted = records.any_match([("source", "SRC1"), ("text", "password|key")])
    return documents(spark, sf).where(wanted).select("doc_id")


@registered(f"WITH {q.CORPUS} SELECT complaint_id, word_count FROM corpus WHERE word_count >= 5")
def min_words(spark, sf):
    return records.with_min_words(corpus(spark, sf)).select("complaint_id", "word_count")


@registered(f"""
WITH {q.CORPUS}
SELECT complaint_id, source, primary_category, raw_text, cleaned_text, word_count FROM corpus""")
def standard_projection(spark, sf):
    rows = documents(spark, sf, "doc_id", "text", "source", "lang")
    return records.corpus_records(
        rows, F.col("text"), F.col("source"), F.col("lang"), "doc_", id_column="doc_id"
    )


@registered("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality,
       CAST(toxic AS VARCHAR) AS toxic FROM labels""")
def cast_to_string(spark, sf):
    table = read_table(spark, sf, "labels")
    return table.select(*[F.col(c).cast("string").alias(c) for c in ("doc_id", "quality", "toxic")])


@registered("""
SELECT doc_id, CAST(doc_id AS VARCHAR) AS kept_id,
       CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS generated_id
FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || doc_id), doc_id) AS k
      FROM (SELECT doc_id, 'custom_' || md5(source || '|' || text) AS id FROM documents))""")
def assign_ids(spark, sf):
    rows = documents(spark, sf, "doc_id", "source", "text")
    source = F.col("source")
    named = rows.select(
        "doc_id",
        records.record_id(rows, "doc_id", "custom_", source, F.col("text")).alias("kept_id"),
        records.record_id(rows, "absent", "custom_", source, F.col("text")).alias("generated_id"),
    )
    return records.numbered_ids(named, "generated_id", order="doc_id")


ROUTES = [
    records.Route("a_", "Rule A", "first", [("source", "src1"), ("lang", "fr|de")]),
    records.Route("b_", "Rule B", "second", [("text", "license")]),
    records.Route("c_", "Rule C", "third", [("lang", "EN")]),
]


@registered(f"""
WITH hits AS (
  SELECT 0 AS route, doc_id, text FROM documents
  WHERE regexp_matches(source, '(?i)src1') OR regexp_matches(lang, '(?i)fr|de')
  UNION ALL
  SELECT 1, doc_id, text FROM documents WHERE regexp_matches(text, '(?i)license')
  UNION ALL
  SELECT 2, doc_id, text FROM documents WHERE regexp_matches(lang, '(?i)EN'))
SELECT ['Rule A', 'Rule B', 'Rule C'][route + 1] AS source,
       ['first', 'second', 'third'][route + 1] AS primary_category, doc_id
FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY doc_id) AS r FROM hits)
WHERE r <= {fixed.REGULATOR_CAP}""")
def route_labels(spark, sf):
    copies = records.routed(documents(spark, sf), ROUTES, ["doc_id"], cap=fixed.REGULATOR_CAP)
    return copies.select("source", "primary_category", "doc_id")


@registered("SELECT count(*) AS n FROM documents WHERE text IS NOT NULL")
def require_columns_then_count(spark, sf):
    checked = require_columns(read_table(spark, sf, "documents"), ["doc_id", "text", "lang"])
    return records.without_nulls(checked, ["text"]).agg(F.count(F.lit(1)).alias("n"))


# --- Masks and cleaning -----------------------------------------------------------


def _register_mask(name, mask):
    def query(spark, sf):
        return documents(spark, sf, "doc_id", "text").select("doc_id", mask(F.col("text")).alias("masked"))

    query.__name__ = f"mask_{name}"
    registered(f"SELECT doc_id, {q.masked('text', name)} AS masked FROM documents")(query)


_register_mask("email", text.mask_email)
_register_mask("phone", text.mask_phone)
_register_mask("card", text.mask_card)
_register_mask("wallet", text.mask_wallet)
_register_mask("url", text.mask_url)
_register_mask("ip", text.mask_ip)


@registered(f"SELECT page_id, {q.collapsed('html')} AS collapsed FROM pages")
def collapse_whitespace(spark, sf):
    pages = texts(spark, sf, "pages")
    return pages.select("page_id", text.collapse_whitespace(F.col("html")).alias("collapsed"))


@registered(f"""
SELECT doc_id, {q.cleaned('text')} AS cleaned,
       {q.collapsed(q.masked('text', 'url', 'ip'))} AS unmasked,
       {q.collapsed(q.masked('text', 'email', 'phone', 'card', 'wallet'))} AS with_links
FROM documents""")
def clean_text(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        text.clean(F.col("text")).alias("cleaned"),
        text.clean(F.col("text"), mask_pii=False).alias("unmasked"),
        text.clean(F.col("text"), preserve_urls_domains=True).alias("with_links"),
    )


@registered(f"SELECT page_id, {q.cleaned('html')} AS cleaned FROM pages")
def clean_pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.clean(F.col("html")).alias("cleaned"))


@registered(f"""
SELECT conv_id, turn, {q.words('c')} AS words
FROM (SELECT conv_id, turn, {q.cleaned('text')} AS c FROM conversations)""")
def word_count(spark, sf):
    turns = texts(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.word_count(text.clean(F.col("text"))).alias("words"))


@registered(f"""
SELECT doc_id, array_to_string(toks, ' ') AS words, len(toks) AS n
FROM (SELECT doc_id, {q.tokens('text')} AS toks FROM documents)""")
def retrieval_tokens(spark, sf):
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", text.tokens(F.col("text")).alias("toks"))
    return rows.select(
        "doc_id", F.array_join("toks", " ").alias("words"), F.size("toks").cast("bigint").alias("n")
    )


@registered(f"""
SELECT doc_id, array_to_string({q.terms()}, '|') AS terms
FROM (SELECT doc_id, {q.content('text')} AS w FROM documents)""")
def analyzer_terms(spark, sf):
    rows = documents(spark, sf, "doc_id", "text").select(
        "doc_id", text.content_words(F.col("text")).alias("w")
    )
    return rows.select("doc_id", F.array_join(text.with_bigrams(F.col("w")), "|").alias("terms"))


# --- Labels ---------------------------------------------------------------------


def _bounded(pattern: str) -> str:
    # \\b knows ASCII only in the checking engine; spell the boundary out.
    edge = r"[^\p{L}\p{N}_]"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{edge})" + pattern[2:]
    return pattern[:-2] + f"(?:$|{edge})" if pattern.endswith(r"\b") else pattern


def rules_sql(x: str, rules=fixed.KEYWORD_RULES, default=fixed.DEFAULT_CLASS) -> str:
    spell = _bounded if rules is not fixed.KEYWORD_RULES else str
    cases = " ".join(
        f"WHEN regexp_matches(lower({x}), '{'|'.join(map(spell, patterns))}') THEN '{category}'"
        for category, patterns in rules
    )
    return f"CASE {cases} ELSE '{default}' END"


# Rules that do hit the given texts.
SAMPLE_RULES = [
    ("legal", [r"\blicense\b", r"\bcopyright\b"]),
    ("contact", [r"\bemail\b", r"@"]),
    ("spanish", [r"\blos\b", r"\bque\b"]),
    ("german", [r"\bund\b", r"\bnicht\b"]),
]


@registered(f"""
SELECT doc_id, {rules_sql('text')} AS category,
       {rules_sql('text', SAMPLE_RULES, 'other')} AS sample_category FROM documents""")
def keyword_category(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        text.taxonomy(F.col("text")).alias("category"),
        text.taxonomy(F.col("text"), SAMPLE_RULES, "other").alias("sample_category"),
    )


@registered(f"""
SELECT doc_id, {rules_sql("source || ' ' || c", [("early", ["src1"])] + SAMPLE_RULES, 'other')} AS category
FROM (SELECT doc_id, source, {q.cleaned('text')} AS c FROM documents)""")
def label_guided_category(spark, sf):
    rules = [("early", ["src1"])] + SAMPLE_RULES
    return documents(spark, sf, "doc_id", "source", "text").select(
        "doc_id",
        text.guided_taxonomy(F.col("source"), text.clean(F.col("text")), rules=rules, default="other")
        .alias("category"),
    )


@registered(f"""
SELECT doc_id, regexp_matches(text, '{fixed.EMAIL_PATTERN}') AS email,
       regexp_matches(text, '{fixed.PHONE_PATTERN}') AS phone,
       regexp_matches(text, '{fixed.CARD_PATTERN}') AS card FROM documents""")
def residual_pii_predicate(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        text.has_email(F.col("text")).alias("email"),
        text.has_phone(F.col("text")).alias("phone"),
        text.has_card(F.col("text")).alias("card"),
    )


@registered(f"""
SELECT doc_id, {', '.join(
    f"CAST((length(c) - length(replace(c, '{t}', ''))) / {len(t)} AS BIGINT) AS n_{n}"
    for n, (_, t) in q.MASKS.items())}
FROM (SELECT doc_id, {q.cleaned('text')} AS c FROM documents)""")
def token_occurrences(spark, sf):
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", text.clean(F.col("text")).alias("c"))
    return rows.select(
        "doc_id",
        *[
            text.occurrences(F.col("c"), token).alias(f"n_{name}")
            for name, (_, token) in q.MASKS.items()
        ],
    )


@registered("""
SELECT doc_id, upper(lang[1]) || lang[2:] || ' Of ' || upper(source[1]) || source[2:] AS pretty
FROM documents""")
def pretty_labels(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", text.pretty_label(F.concat_ws("_", "lang", F.lit("of"), "source")).alias("pretty")
    )


@registered("""
SELECT doc_id, format('{:,}', n_chars) AS thousands,
       printf('%.2f', round(n_chars / 7 + 1e-9, 2)) AS decimals FROM documents""")
def number_formats(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id",
        text.thousands(F.col("n_chars")).alias("thousands"),
        text.two_decimals(F.round(F.col("n_chars") / 7 + 1e-9, 2)).alias("decimals"),
    )


@registered("SELECT doc_id, substr(source, 1, 4) AS prefix FROM documents")
def label_prefix(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", text.prefix(F.col("source")).alias("prefix")
    )


@registered("""
SELECT d.doc_id, round(ln(n_chars + 1), 4) AS ln, round(log2(n_chars + 1), 4) AS log2,
       pow(2e0, quality) - 1 AS gain, round(n_chars / (n_chars + 1.5e0), 4) AS quotient
FROM documents d JOIN labels USING (doc_id)""")
def math_functions(spark, sf):
    n = F.col("n_chars")
    joined = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    return joined.select(
        "doc_id",
        F.round(F.ln(n + 1), 4).alias("ln"),
        F.round(F.log2(n + 1), 4).alias("log2"),
        (F.pow(F.lit(2.0), F.col("quality")) - 1).alias("gain"),
        F.round(n / (n + 1.5), 4).alias("quotient"),
    )


@registered(f"""
SELECT CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS complaint_id,
       '{fixed.AGENCY_SOURCE}' AS source, DATE '{fixed.AGENCY_DATE}' AS date_received,
       '{fixed.AGENCY_PRODUCT}' AS product, text AS raw_text, c AS cleaned_text,
       {rules_sql('c')} AS primary_category, '{fixed.AGENCY_ISSUE}' AS original_issue
FROM (SELECT *, row_number() OVER (PARTITION BY id) AS k FROM (
  SELECT text, {q.cleaned('text')} AS c,
         '{fixed.AGENCY_ID_PREFIX}' || md5('{fixed.AGENCY_SOURCE}|' || text) AS id FROM documents))""")
def ingest_unlabelled_agency(spark, sf):
    """No label and no id column: keyword rules and generated ids."""
    return ingest_agency(documents(spark, sf, "text"), "text")
