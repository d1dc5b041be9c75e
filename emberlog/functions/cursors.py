"""Page cursors: base64 of a small JSON object with the last row's timestamp and id."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.time import instant, iso_text


def encode_cursor(timestamp: Column, row_id: Column) -> Column:
    body = F.to_json(F.struct(iso_text(timestamp).alias("timestamp"), row_id.alias("id")))
    return F.translate(F.base64(F.encode(body, "UTF-8")), "\r\n", "")  # base64 breaks lines


def decode_cursor(token: str) -> tuple[datetime, str]:
    """(timestamp, id) of a token; ValueError when it is not one."""
    try:
        body = json.loads(base64.b64decode(token, validate=True))
        when, row_id = instant(body["timestamp"]), body["id"]
    except (binascii.Error, ValueError, TypeError, KeyError, AttributeError):
        raise ValueError("invalid or malformed cursor") from None
    if not isinstance(row_id, str) or not row_id:
        raise ValueError("invalid or malformed cursor")
    return when, row_id
