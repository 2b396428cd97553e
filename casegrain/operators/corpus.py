"""Building a corpus: adapters, loaders, harmonising, balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators import records
from casegrain.operators.ranking import keep_first, ranked_in_group, sample_rows
from casegrain.operators.terms import computed_once
from casegrain.sources import readers
from casegrain.sources.mails import read_mails
from casegrain.workspace import written

COPIES_PER_BLOCK = 1000


def ingest_agency(
    df: DataFrame, text_column: str, label_column: str | None = None,
    id_column: str | None = None, source: str = fixed.AGENCY_SOURCE,
    product: str = fixed.AGENCY_PRODUCT, date_received: str = fixed.AGENCY_DATE,
    issue: str = fixed.AGENCY_ISSUE, prefix: str = fixed.AGENCY_ID_PREFIX, **rules,
) -> DataFrame:
    """Any table with a text column as eight-column records.

    A label column guides the keyword rules and is kept as the original issue.
    """
    readers.require_columns(df, [text_column])
    raw = F.col(f"`{text_column}`").cast("string")
    labelled = bool(label_column) and label_column in df.columns
    label = F.col(f"`{label_column}`").cast("string") if labelled else F.lit(None).cast("string")
    given = id_column if id_column and id_column in df.columns else None
    named = records.without_nulls(df, [text_column]).select(
        *([F.col(f"`{given}`").cast("string").alias("_id")] if given else []),
        F.lit(source).alias("source"),
        F.to_date(F.lit(date_received)).alias("date_received"),
        F.lit(product).alias("product"),
        raw.alias("raw_text"),
        label.alias("_label"),
    )
    named = records.with_record_ids(
        named, "_id" if given else None,
        records.generated_id(prefix, F.col("source"), F.col("raw_text")), "complaint_id",
    )
    named = computed_once(named, "cleaned_text", text.clean(F.col("raw_text")))
    guide = (
        text.guided_taxonomy(F.col("_label"), F.col("cleaned_text"), **rules)
        if labelled
        else text.taxonomy(F.col("cleaned_text"), **rules)
    )
    labelled_rows = computed_once(named, "primary_category", guide).withColumn(
        "original_issue", F.coalesce("_label", F.lit(issue))
    )
    return labelled_rows.select(*fixed.AGENCY_COLUMNS)


def ingest_source(
    df: DataFrame, source: str, text_column: str | None = None,
    words: Sequence[str] = (), first_as_default: bool = False, **options,
) -> DataFrame:
    """A local dump of reports: find the text column, then the adapter.

    Rows without text are dropped, as in the adapter.
    """
    column = text_column if text_column in df.columns else readers.find_text_column(
        df.columns, words, first_as_default
    )
    return ingest_agency(df, column, source=source, prefix=f"{source}_", **options)


# --- Labelled loaders ---------------------------------------------------------


def load_sms_spam(messages: DataFrame) -> DataFrame:
    prefix, source, category = fixed.SMS_SPAM
    spam = records.with_value(messages, "label", "spam")
    stripped = F.regexp_replace("text", _EDGE_BLANKS, "")
    return records.corpus_records(spam, stripped, source, category, prefix)


def load_hate_speech(tweets: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of the wanted classes; ``n`` takes a seeded sample of at most so many, before cleaning."""
    prefix, source, category = fixed.HATE_SPEECH
    wanted = records.with_any_value(
        tweets.select(F.col("class").cast("int").alias("class"), "tweet"),
        "class", fixed.HATE_SPEECH_CLASSES,
    )
    stripped = wanted.select(F.regexp_replace("tweet", _EDGE_BLANKS, "").alias("tweet"))
    if n is not None:
        hashed = stripped.withColumn("_hash", F.md5("tweet"))
        stripped = sample_rows(hashed, "_hash", n).drop("_hash")
    return records.corpus_records(stripped, F.col("tweet"), source, category, prefix)


def load_fraud_mail(mails: DataFrame) -> DataFrame:
    prefix, source, category = fixed.FRAUD_MAIL
    column = readers.find_text_column(mails.columns, fixed.TEXT_COLUMN_WORDS["fraud_mail"])
    return records.corpus_records(mails, F.col(f"`{column}`"), source, category, prefix)


def load_regulator(
    complaints: DataFrame, routes: Sequence[records.Route] = tuple(records.REGULATOR_ROUTES),
    text_column: str = fixed.REGULATOR_TEXT, cap: int | None = None,
) -> DataFrame:
    """Complaints with a narrative, a labelled copy per matching route."""
    told = records.without_nulls(complaints, [text_column])
    raw = F.col(f"`{text_column}`")
    order = [F.md5(raw.cast("string"))]
    copies = records.routed(told, routes, order, cap)
    return records.corpus_records(
        copies, raw, F.col("source"), F.col("primary_category"), F.col("prefix")
    )


def _read_mails(spark: SparkSession, path: str) -> DataFrame:
    """A mailbox (``.txt``) or a table of mails."""
    return read_mails(spark, path) if path.lower().endswith(".txt") else readers.read_csv(spark, path)


def load_labelled(
    spark: SparkSession, sms: str | None = None, hate_speech: str | None = None,
    fraud_mail: str | None = None, regulator: str | None = None,
) -> DataFrame:
    """All labelled sources; one that is missing gives no rows."""
    plans = [
        (sms, readers.read_sms, load_sms_spam),
        (hate_speech, readers.read_csv, load_hate_speech),
        (fraud_mail, _read_mails, load_fraud_mail),
        (regulator, readers.read_csv, load_regulator),
    ]
    tables = [
        load(raw)
        for path, reader, load in plans
        if path and (raw := readers.read_if_present(spark, path, reader)) is not None
    ]
    if not tables:
        raise FileNotFoundError("no labelled source found")
    return readers.concatenate(tables)


_BLANK_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in fixed.WHITESPACE_CHARACTERS) + "]"
_EDGE_BLANKS = rf"\A{_BLANK_CLASS}+|{_BLANK_CLASS}+\z"


# --- Corpora ------------------------------------------------------------------


def source_order(sources: Sequence[DataFrame]) -> list[DataFrame]:
    """Number the sources, so that "first" has a meaning after the union."""
    return [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]


def deduplicated(df: DataFrame) -> DataFrame:
    """One record per cleaned text: the first source, then the lowest id."""
    return keep_first(df, "cleaned_text", ["source_rank", "complaint_id"]).drop("source_rank")


def harmonize(sources: Sequence[DataFrame], min_words: int = fixed.MIN_WORDS) -> DataFrame:
    """Union, drop nulls, drop short texts, keep the first of equal texts."""
    merged = readers.concatenate(source_order(sources))
    whole = records.without_nulls(merged, ["cleaned_text", "primary_category"])
    return deduplicated(records.with_min_words(whole, min_words))


def deficits(
    df: DataFrame, categories: Sequence[str], target: int, class_column: str = "primary_category",
) -> DataFrame:
    """Rows each category lacks to reach the target; none when it is above."""
    spark = df.sparkSession
    targets = spark.createDataFrame([(c,) for c in categories], f"{class_column} string")
    counts = df.groupBy(class_column).agg(F.count(F.lit(1)).alias("existing"))
    return targets.join(counts, class_column, "left").select(
        class_column,
        F.coalesce("existing", F.lit(0)).alias("existing"),
        F.greatest(F.lit(0), F.lit(target) - F.coalesce("existing", F.lit(0)))
        .cast("bigint").alias("needed"),
    )


def top_up(
    df: DataFrame, pool: DataFrame, categories: Sequence[str],
    target: int = fixed.TARGET_PER_CLASS, seed: int = fixed.SEED,
) -> DataFrame:
    """Rows that fill each category's deficit, taken from a pool table.

    The pool rows of a category are repeated in hash order until the deficit is
    filled. A category without pool rows gets none: :func:`deficits` of the result
    says what is left. The rows carry their own id and source, so they stay recognisable.
    Copies are made in blocks spread over the cluster, so that one pool row
    repeated very often does not keep a single task busy.
    """
    needs = deficits(df, categories, target).where("needed > 0").select(
        "primary_category", "needed"
    )
    ranked = ranked_in_group(
        pool.select("complaint_id", "primary_category", "raw_text", "cleaned_text"),
        "primary_category", "complaint_id", seed, rank="_rank", size="_pool",
    )
    copies = F.ceil((F.col("needed") - F.col("_rank") + 1) / F.col("_pool"))
    blocks = (
        ranked.join(F.broadcast(needs), "primary_category")  # one row per listed category
        .where("_rank <= needed")
        .withColumn("_copies", copies)
        .withColumn(
            "_block",
            F.explode(F.expr(f"sequence(0, (_copies - 1) div {COPIES_PER_BLOCK})")),
        )
        .repartition("primary_category", "_rank", "_block")
    )
    first = F.col("_block") * COPIES_PER_BLOCK
    last = F.least(first + COPIES_PER_BLOCK, F.col("_copies")) - 1
    numbered = blocks.withColumn("_copy", F.explode(F.sequence(first, last))).withColumn(
        "_number", F.col("_rank") - 1 + F.col("_copy") * F.col("_pool") + fixed.TOP_UP_START
    )
    return numbered.select(
        F.concat(
            F.lit(fixed.TOP_UP_PREFIX), text.prefix(F.col("primary_category")),
            F.lit("_"), F.col("_number").cast("string"),
        ).alias("complaint_id"),
        F.concat(
            F.lit(f"{fixed.TOP_UP_SOURCE} ("), text.pretty_label(F.col("primary_category")), F.lit(")")
        ).alias("source"),
        "primary_category",
        "raw_text",
        "cleaned_text",
        text.word_count(F.col("cleaned_text")).alias("word_count"),
    )


def build_corpus(
    sources: Sequence[DataFrame], pool: DataFrame | None = None,
    categories: Sequence[str] = tuple(fixed.SEVEN_CLASSES),
    target: int = fixed.TARGET_PER_CLASS, strict: bool = False,
) -> DataFrame:
    """Union of labelled sources, topped up, without nulls and equal texts.

    No minimum number of words here: an empty cleaned text is a text. A pool
    with too few different texts leaves a class below the target, as equal ones
    are dropped: ``strict`` raises then, and :func:`deficits` of the result has
    the numbers.
    """
    tables = [df.select(*fixed.CORPUS_COLUMNS) for df in sources]
    if pool is not None:
        tables.append(top_up(readers.concatenate(tables), pool, categories, target))
    merged = readers.concatenate(source_order(tables))
    built = deduplicated(records.without_nulls(merged, ["cleaned_text", "primary_category"]))
    if strict:
        built = written(built, "corpus")
        short = deficits(built, categories, target).where("needed > 0").collect()  # one row per category
        if short:
            raise ValueError("classes below the target: " + ", ".join(
                f"{r.primary_category} lacks {r.needed}" for r in short))
    return built
