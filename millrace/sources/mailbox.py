"""Raw mails as rows. Decoding headers and bodies needs a mail parser, so it runs in batches on the executors."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.rounds import small_batches

#: Mails whose fields are in memory at once.
SLICE_ROWS = 500
SCHEMA = "message_id string, subject string, sender string, date timestamp, body string, html string"


def _decoded(raw: bytes | None) -> tuple:
    """The fields of one mail; a mail that can't be parsed has none."""
    try:
        mail = email.message_from_bytes(raw or b"", policy=email.policy.default)
        plain, html = mail.get_body(("plain",)), mail.get_body(("html",))
        when = mail["date"].datetime if mail["date"] else None
        stamp = pd.Timestamp(when).tz_convert("UTC").tz_localize(None) if when and when.tzinfo else pd.Timestamp(when) if when else None
        return mail["message-id"], mail["subject"], mail["from"], stamp, plain.get_content() if plain else None, html.get_content() if html else None
    except (LookupError, ValueError, AttributeError, TypeError):
        return None, None, None, None, None, None


def mails(raw: DataFrame, column: str = "content") -> DataFrame:
    """message_id, subject, sender, date, body, html of raw mails (bytes): the plain part is preferred, else the text of the HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for k in range(0, len(batch), SLICE_ROWS):
                rows = [_decoded(r) for r in batch[column].iloc[k : k + SLICE_ROWS]]
                out = pd.DataFrame([tuple(str(v) if v is not None and not isinstance(v, pd.Timestamp) else v for v in r) for r in rows], columns=names)
                out["date"] = pd.to_datetime(out["date"])
                yield out

    small_batches(raw.sparkSession)
    out = raw.select(column).mapInPandas(run, SCHEMA)
    body = F.coalesce(F.nullif(X.collapse(X.text("body")), F.lit("")), X.strip_html("html"))
    return out.withColumn("body", body)


def folder(spark, path: str) -> DataFrame:
    """The mails of a folder of .eml files."""
    return mails(spark.read.format("binaryFile").load(path).select("content"))
