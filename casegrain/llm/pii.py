"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose candidate spans in the whole text. Three labelers vote on each, or
abstain: a strict form of the pattern, a gazetteer, and the words before the span.
Expectation-maximisation over the vote patterns estimates how reliable each labeler is,
without any labelled data, and gives every pattern a probability. A naive Bayes span
classifier is trained on those probabilities, over the votes and the look of the span,
and decides about the candidates that the base rules leave out.

The texts are read once. Candidates stay in their document's row; what is gathered are
counts of vote patterns and of features, a few thousand rows at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import plain
from casegrain.operators.terms import computed_once
from casegrain.workspace import written


@dataclass(frozen=True)
class Kind:
    """How a kind of span is found. ``needs`` is a character every match holds, to skip texts early."""

    name: str
    pattern: str
    strict: Callable[[Column], Column]
    gazetteer: Callable[[Column], Column]
    base: bool = False
    needs: str | None = None


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string's Luhn sum ends in 0."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _ip(match: Column) -> Column:
    return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")


def _always(match: Column) -> Column:
    return F.lit(True)


def _listed(yes: str, no: str | None = None) -> Callable[[Column], Column]:
    """1 where the list of ``yes`` forms has the match, 0 for ``no`` forms, else null."""

    def vote(match: Column) -> Column:
        found = F.when(match.rlike(yes), 1)
        return found if no is None else found.when(match.rlike(no), 0)

    return vote


#: Kinds in their order, base ones first, with their patterns. A quantifier with a second
#: ``+`` never gives back, and the look behind starts a match only where a run starts (or a match has
#: ended): neither changes what matches, and both keep long runs of one class linear.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         _always, _listed(r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$", r"(?i)@\d|\.(?:png|jpg|js|css)$"),
         base=True, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip,
         _listed(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.[0-9]+\.[0-9]+\.[0-9]+$", r"^0|^(?:127|255)\."),
         base=True, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _card,
         _listed(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^0"), base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone,
         _listed(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]", r"^\+0"),
         base=True, needs="+"),
    # A base match that runs on into other digits fails whole; these find the number inside.
    Kind("card_part", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", _card,
         _listed(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^0")),
    Kind("phone_part", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
         _phone, _listed(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]", r"^\+0"), needs="+"),
    Kind("masked_email", r"(?i)(?<![\w.-])[\w.-]++\x20?[(\[]at[)\]]\x20?[a-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[a-z0-9]++)++",
         lambda m: m.rlike(r"(?i)[a-z]{2,}$"), _listed(r"(?i)(?:com|org|net|edu|de|fr|es)$")),
    Kind("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), _listed("^[0-7]", "^9"), needs="-"),
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
         lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34),
         _listed("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)")),
    Kind("secret", r"""(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?["']?[^\s"']{8,}+)""",
         lambda m: m.rlike("[0-9]"), _listed("^AKIA|[0-9a-f]{16}", r"(?i)x{4}|\*{4}")),
)
BASE = tuple(k.name for k in KINDS if k.base)
LABELERS = ("strict", "gazetteer", "context")
#: Words before a span that speak for or against personal data. A parameter of the context labeler.
SPEAKS_FOR = (r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|mobile|fax|card|visa|mastercard|credit|account|"
              r"ip|address|from|login|user|password|key|ssn|social security|iban|bank)\b[^\w]*$")
SPEAKS_AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|ticket|section|figure|page|no|nr|number)\b[^\w]*$"
BEFORE, AFTER = 40, 8
ROUNDS = 25
THRESHOLD = 0.9


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts: gap, match, gap, match, ... in code points."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.get(gaps, i))
        return F.struct((start + F.char_length(F.get(found, i))).alias("at"),
                        F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), state, step)["starts"]


def _votes(kind: Kind, match: Column, before: Column) -> Column:
    return F.struct(
        kind.strict(match).cast("int").alias("strict"),
        kind.gazetteer(match).cast("int").alias("gazetteer"),
        F.when(before.rlike(SPEAKS_FOR), 1).when(before.rlike(SPEAKS_AGAINST), 0).alias("context"),
    )


def _features(kind: Kind, match: Column, before: Column, after: Column, votes: Column) -> Column:
    """The look of a span, as a short list of names from a bounded set."""
    size, digits = F.char_length(match), F.length(_digits(match))
    shape = F.when(match.rlike("[A-Z]") & match.rlike("[a-z]"), "mixed").when(match.rlike("[A-Z]"), "upper").when(
        match.rlike("[a-z]"), "lower").otherwise("none")
    edge = lambda c: F.when(c == "", "end").when(c.rlike(r"\s"), "blank").when(
        c.rlike(r"\w"), "word").otherwise("mark")
    word = F.regexp_extract(F.lower(before), r"(\w+)\W*$", 1)
    parts = [F.concat(F.lit(f"{name}:"), F.coalesce(votes[name].cast("string"), F.lit("-"))) for name in LABELERS]
    parts += [
        F.concat(F.lit("size:"), F.least(F.floor(size / 4), F.lit(16)).cast("string")),
        F.concat(F.lit("digits:"), F.floor(F.lit(4) * digits / size).cast("string")),
        F.concat(F.lit("case:"), shape),
        F.concat(F.lit("left:"), edge(F.substring(before, -1, 1))),
        F.concat(F.lit("right:"), edge(F.substring(after, 1, 1))),
        F.concat(F.lit("word:"), F.pmod(F.xxhash64(word), F.lit(64)).cast("string")),
    ]
    return F.array(*[F.concat(F.lit(f"{kind.name} "), p) for p in parts])


def _candidates(kind: Kind, found: Column, gaps: Column) -> Column:
    def candidate(start: Column, i: Column) -> Column:
        match = F.get(found, i)
        before = F.substring(F.get(gaps, i), -BEFORE, BEFORE)
        after = F.substring(F.get(gaps, i + 1), 1, AFTER)
        return _let(_votes(kind, match, before), lambda votes: F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"),
            match.alias("text"), (F.lit(kind.base) & votes["strict"].cast("boolean")).alias("base"),
            votes.alias("votes"), _features(kind, match, before, after, votes).alias("features"),
        ))

    return F.when(F.size(found) > 0, F.transform(_starts(gaps, found), candidate)).otherwise(F.array())


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``candidates``, all spans that a kind's pattern finds, with votes and features."""
    rows = plain(docs, id_col, text_col)
    matches = []
    for kind in KINDS:
        found = F.regexp_extract_all(F.col("text"), F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            found = F.when(F.contains("text", F.lit(kind.needs)), found).otherwise(F.array())
        matches.append(found.alias(kind.name))
    rows = computed_once(rows, "found", F.struct(*matches))
    gaps = [
        F.when(F.size(F.col("found")[k.name]) > 0, F.split("text", k.pattern, -1)).alias(k.name) for k in KINDS
    ]
    rows = computed_once(rows, "gaps", F.struct(*gaps))
    spans = [_candidates(k, F.col("found")[k.name], F.col("gaps")[k.name]) for k in KINDS]
    return rows.select("doc_id", F.concat(*spans).alias("candidates"))


def _expectation(pattern: Column, state: Column) -> Column:
    """Probability that spans with this vote pattern are personal data."""
    share = F.element_at(state["share"], pattern["kind"])
    real, unreal = share, F.lit(1.0) - share
    for i, name in enumerate(LABELERS):
        vote = pattern[name]
        hit, slip = state["hit"][i], state["slip"][i]
        real = real * F.when(vote == 1, hit).when(vote == 0, 1 - hit).otherwise(1.0)
        unreal = unreal * F.when(vote == 1, slip).when(vote == 0, 1 - slip).otherwise(1.0)
    return real / (real + unreal)


def _total(patterns: Column, posts: Column, value: Callable[[Column, Column], Column]) -> Column:
    weighed = F.zip_with(patterns, posts, lambda p, y: value(p, y))
    return F.aggregate(weighed, F.lit(0.0), lambda total, x: total + x)


def _maximisation(patterns: Column, posts: Column) -> Column:
    """Shares per kind and each labeler's rates, with a little smoothing."""

    def rate(name: str, weight: Callable[[Column], Column], prior: float) -> Column:
        votes = _total(patterns, posts, lambda p, y: F.when(p[name] == 1, p["n"] * weight(y)).otherwise(0.0))
        all_ = _total(patterns, posts, lambda p, y: F.when(p[name].isNotNull(), p["n"] * weight(y)).otherwise(0.0))
        return (votes + 10 * prior) / (all_ + 10)

    share = F.map_from_entries(F.array(*[
        F.struct(F.lit(k.name), (
            _total(patterns, posts, lambda p, y, k=k: F.when(p["kind"] == k.name, p["n"] * y).otherwise(0.0)) + 1.0
        ) / (_total(patterns, posts, lambda p, y, k=k: F.when(p["kind"] == k.name, p["n"]).otherwise(0.0)) + 2.0))
        for k in KINDS
    ]))
    return F.struct(
        share.alias("share"),
        F.array(*[rate(name, lambda y: y, 0.8) for name in LABELERS]).alias("hit"),
        F.array(*[rate(name, lambda y: 1.0 - y, 0.2) for name in LABELERS]).alias("slip"),
    )


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: ``patterns`` (kind, votes, n), and EM's ``share`` per kind, ``hit`` and ``slip`` per labeler.

    ``votes`` has a row per candidate. Vote patterns are few (27 per kind), whatever the
    number of candidates, so one row holds them and the rounds are one expression.
    """
    counted = votes.groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n"))
    one = counted.agg(F.array_sort(F.collect_list(F.struct("kind", *LABELERS, "n"))).alias("patterns"))
    start = F.struct(
        F.map_from_entries(F.array(*[F.struct(F.lit(k.name), F.lit(0.5)) for k in KINDS])).alias("share"),
        F.array(*map(F.lit, (0.9, 0.8, 0.7))).alias("hit"),
        F.array(*map(F.lit, (0.1, 0.3, 0.2))).alias("slip"),
    )

    def step(state: Column, _: Column) -> Column:
        posts = F.transform("patterns", lambda p: _expectation(p, state))
        return _let(posts, lambda y: _maximisation(F.col("patterns"), y))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return one.select("patterns", fitted.alias("state")).select("patterns", "state.*")


def classifier(spans: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row, ``weights``: a map from feature (and kind) to its log odds.

    Naive Bayes over the candidates, each counted as personal data by its vote pattern's
    probability. Features are names from a bounded set, some hundreds per kind.
    """
    soft = fitted.select(F.explode("patterns").alias("p"), F.struct("share", "hit", "slip").alias("state")).select(
        F.col("p.kind").alias("kind"), *[F.coalesce(F.col(f"p.{n}"), F.lit(-1)).alias(n) for n in LABELERS],
        _expectation(F.col("p"), F.col("state")).alias("real"),
    )
    keyed = spans.select(
        "kind", "features", *[F.coalesce(F.col(f"votes.{n}"), F.lit(-1)).alias(n) for n in LABELERS])
    # At most 27 vote patterns per kind.
    weighed = keyed.join(F.broadcast(soft), ["kind", *LABELERS]).select("kind", "features", "real")
    counts = weighed.select("kind", F.explode("features").alias("feature"), "real").groupBy("kind", "feature").agg(
        F.sum("real").alias("real"), F.sum(1 - F.col("real")).alias("unreal"))
    kinds = weighed.groupBy("kind").agg(F.sum("real").alias("all_real"), F.sum(1 - F.col("real")).alias("all_unreal"))
    odds = counts.join(F.broadcast(kinds), "kind").select(
        "feature",
        (F.log((F.col("real") + 0.5) / (F.col("all_real") + 1))
         - F.log((F.col("unreal") + 0.5) / (F.col("all_unreal") + 1))).alias("weight"),
    )
    priors = kinds.select(
        F.col("kind").alias("feature"), F.log((F.col("all_real") + 1) / (F.col("all_unreal") + 1)).alias("weight"))
    return odds.unionByName(priors).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights"))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive), text, base, probability.

    Sorted by start, then kind. Base spans always stay; another candidate stays if it overlaps
    none of them and the classifier gives it at least ``threshold``. A null text is empty and has no spans;
    repeated rows get a row each; without any candidate nothing is learned or found.
    """
    rows = written(candidates(docs, id_col, text_col), "pii-candidates")
    spans = rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    fitted = written(reliabilities(spans.select("kind", "votes.*")), "pii-reliabilities")
    model = written(classifier(spans, fitted), "pii-classifier")
    rows = rows.withColumn("weights", model.select("weights").scalar())
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))])

    def decided(c: Column) -> Column:
        parts = F.transform(F.concat(c["features"], F.array(c["kind"])), lambda f: F.coalesce(
            F.element_at(F.col("weights"), f), F.lit(0.0)))
        odds = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
        return F.struct(
            c["start"].alias("start"), F.element_at(order, c["kind"]).alias("place"), c["end"].alias("end"),
            c["kind"].alias("kind"), c["text"].alias("text"), c["base"].alias("base"),
            (1 / (1 + F.exp(-odds))).alias("probability"))

    def free(s: Column) -> Column:
        return ~F.exists("candidates", lambda b: b["base"] & (b["start"] < s["end"]) & (b["end"] > s["start"]))

    kept = F.filter(
        F.transform("candidates", decided),
        lambda s: s["base"] | ((s["probability"] >= threshold) & free(s)),
    )
    return rows.select("doc_id", F.array_sort(kept).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as one string."""
    of = lambda name: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == name))).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[of(name).alias(f"n_{name}") for name in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
