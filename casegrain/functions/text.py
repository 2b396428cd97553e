"""Text functions: ``Column`` in, ``Column`` out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed


def _unicode(pattern: str) -> str:
    # Java needs the flag for \b, \d, \s and \S to see more than ASCII.
    return "(?U)" + pattern


def _mask(text: Column, pattern: str, token: str) -> Column:
    return F.regexp_replace(text, _unicode(pattern), token)


def mask_email(text: Column) -> Column:
    return _mask(text, fixed.EMAIL_PATTERN, fixed.EMAIL_TOKEN)


def mask_phone(text: Column) -> Column:
    return _mask(text, fixed.PHONE_PATTERN, fixed.PHONE_TOKEN)


def mask_card(text: Column) -> Column:
    return _mask(text, fixed.CARD_PATTERN, fixed.CARD_TOKEN)


def mask_wallet(text: Column) -> Column:
    return _mask(text, fixed.WALLET_PATTERN, fixed.WALLET_TOKEN)


def mask_url(text: Column) -> Column:
    return _mask(text, fixed.URL_PATTERN, fixed.URL_TOKEN)


def mask_ip(text: Column) -> Column:
    return _mask(text, fixed.IP_PATTERN, fixed.IP_TOKEN)


def collapse_whitespace(text: Column) -> Column:
    # Every kind of blank becomes a space first: much cheaper than a regex
    # over the whole class. trim() takes spaces only, so it comes last.
    blanks = fixed.WHITESPACE_CHARACTERS
    spaced = F.translate(text, blanks, " " * len(blanks))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def clean(text: Column, mask_pii: bool = True, preserve_urls_domains: bool = False) -> Column:
    """The full cleaner. Null and empty text give ``''``; mask order matters."""
    plain = F.coalesce(text, F.lit(""))
    masks = [mask_email, mask_phone, mask_card, mask_wallet] if mask_pii else []
    if not preserve_urls_domains:
        masks += [mask_url, mask_ip]
    return collapse_whitespace(masked_by(plain, masks))


DIGIT = r"\p{Nd}"
#: What every text that a mask changes holds, one of these; a mask that is not listed is always tried.
MASK_NEEDS = {
    mask_email: ("@",), mask_phone: (DIGIT,), mask_card: (DIGIT,), mask_wallet: (DIGIT,),
    mask_url: ("http", "www."), mask_ip: (DIGIT,),
}


def masked_by(text: Column, masks: Sequence[Callable[[Column], Column]]) -> Column:
    """The masks in order, on texts that hold what one of them needs."""
    masked = text
    for mask in masks:
        masked = mask(masked)
    if not masks or any(mask not in MASK_NEEDS for mask in masks):
        return masked
    needs = sorted({need for mask in masks for need in MASK_NEEDS[mask]})
    # One search each: an alternation tries all of them at every character.
    found = [text.rlike(need) if need == DIGIT else text.contains(need) for need in needs]
    return F.when(reduce(Column.__or__, found), masked).otherwise(text)


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text (single blanks, trimmed)."""
    words = F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))
    return words.cast("bigint")


def tokens(text: Column) -> Column:
    """Lowercased words, for ranking."""
    # Splitting at the gaps is faster than extracting the words.
    return F.array_remove(F.split(F.lower(text), f"[^{fixed.WORD}]+"), "")


def content_words(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Lowercased words of two or more characters without stop words."""
    return content_of(tokens(text), stop_words)


def content_of(words: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """The same from the words of :func:`tokens`."""
    stops = list(stop_words)
    return F.filter(
        words,
        lambda w: (F.length(w) > 1) & ~w.isin(stops) if stops else F.length(w) > 1,
    )


def with_bigrams(words: Column) -> Column:
    """A word array followed by its adjacent pairs."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(
        words,
        F.zip_with(
            F.slice(words, 1, pairs),
            F.slice(words, 2, pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )


def taxonomy(
    text: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = tuple(fixed.KEYWORD_RULES),
    default: str = fixed.DEFAULT_CLASS,
) -> Column:
    """The first category, in rule order, with a pattern found in the text."""
    lowered = F.lower(text)
    label = None
    for category, patterns in rules:
        hit = lowered.rlike(_unicode("|".join(patterns)))
        label = F.when(hit, category) if label is None else label.when(hit, category)
    return F.lit(default) if label is None else label.otherwise(default)


def guided_taxonomy(label: Column, cleaned: Column, **options) -> Column:
    """Keyword rules over the given label followed by the cleaned text."""
    return taxonomy(F.concat_ws(" ", label, cleaned), **options)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; null counts as no match."""
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def has_email(cleaned: Column) -> Column:
    return cleaned.rlike(_unicode(fixed.EMAIL_PATTERN))


def has_phone(cleaned: Column) -> Column:
    return cleaned.rlike(_unicode(fixed.PHONE_PATTERN))


def has_card(cleaned: Column) -> Column:
    return cleaned.rlike(_unicode(fixed.CARD_PATTERN))


def occurrences(text: Column, token: str) -> Column:
    """How often a literal token occurs in the text."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (removed / len(token)).cast("bigint")


def pretty_label(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def two_decimals(number: Column) -> Column:
    return F.format_string("%.2f", number)


def prefix(label: Column, length: int = 4) -> Column:
    return F.substring(label, 1, length)


def case_line(rank: Column, score: Column, doc_id: Column, category: Column, source: Column) -> Column:
    """One ranked case as a line of text."""
    return F.format_string(
        "#%d [Score: %.4f] - ID: %s | Category: %s | Source: %s",
        rank,
        score,
        doc_id,
        F.coalesce(category, F.lit("unknown")),
        F.coalesce(source, F.lit("N/A")),
    )
