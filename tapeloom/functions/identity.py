"""Identities derived from content."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) as an expression; null for a null name."""
    space = uuid.UUID(namespace).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    parts = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )
    return F.when(name.isNotNull(), parts)


CONTENT_POLICY = "tapeloom.content.v1"


def _lines(text: Column) -> Column:
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(unified, r"^[ \t\n]+|[ \t\n]+$", "")


def content_json(source: Column, headline: Column, body: Column, url: Column, event_time: Column, policy: str = CONTENT_POLICY) -> Column:
    """Canonical JSON of what makes a message: keys sorted, compact, nulls explicit, line ends unified."""
    stamp = F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(_lines(body).alias("body"), stamp.alias("event_time"), _lines(headline).alias("headline"), F.lit(policy).alias("policy"), _lines(source).alias("source"), _lines(url).alias("url")), {"ignoreNullFields": "false"})


def content_hash(source: Column, headline: Column, body: Column, url: Column, event_time: Column, policy: str = CONTENT_POLICY) -> Column:
    """SHA-256 of content_json. Text is taken as composed already (NFC); Spark has no composition of its own."""
    return F.sha2(content_json(source, headline, body, url, event_time, policy), 256)
