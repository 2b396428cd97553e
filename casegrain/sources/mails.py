"""Mailbox files: many messages in one text, each after a line of its own."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the line before a message begins; a parameter.
ENVELOPE = "From r "
_FIELDS = "struct<sender: string, subject: string, sent: string, body: string>"


def _decoded(raw: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8"):
        try:
            return raw.decode(name or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _header(value: object) -> str | None:
    if value is None:
        return None
    try:
        return " ".join(str(make_header(decode_header(str(value)))).split())
    except (LookupError, UnicodeDecodeError, ValueError):
        return " ".join(str(value).split())


def message_fields(raw: bytes) -> tuple[str | None, str | None, str | None, str]:
    """Sender, subject, date and the plain text parts of a message, transfer and character codes undone."""
    message = message_from_bytes(raw)
    parts = [p for p in message.walk() if not p.is_multipart() and p.get_content_maintype() == "text"]
    plain = [p for p in parts if p.get_content_subtype() == "plain"] or parts
    body = "\n".join(_decoded(p.get_payload(decode=True) or b"", p.get_content_charset()) for p in plain)
    return _header(message["From"]), _header(message["Subject"]), _header(message["Date"]), body.strip()


def read_mails(spark: SparkSession, path: str, envelope: str = ENVELOPE) -> DataFrame:
    """``sender, subject, sent, body`` of each message in the files under ``path``.

    Messages are told apart by the line break and the beginning of the next envelope line, so
    Spark cuts a large file between them, at whatever byte a split ends. The envelope line
    itself is left out; a message without a header has only a body.
    """

    @F.arrow_udf(_FIELDS)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [message_fields(raw) for raw in batch.to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(4)]
            yield pa.StructArray.from_arrays(columns, names=["sender", "subject", "sent", "body"])

    text = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), f"^(?:{envelope})?[^\n]*\n", "")
    records = spark.read.option("lineSep", f"\n{envelope}").text(path).select(text.alias("text"))
    # The text stands for bytes, one character each, until its own character code is known.
    raw = F.encode("text", "ISO-8859-1")
    return records.where(F.trim("text") != "").select(parsed(raw).alias("mail")).select("mail.*")
