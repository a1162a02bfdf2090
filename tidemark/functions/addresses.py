"""Account addresses: workchain and hash in raw form, or base64url with flags and a CRC-16 in friendly form."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RAW = re.compile(r"^(-?\d+):([0-9a-fA-F]{64})$")
#: Fixed values of the friendly form: the tags of accounts that bounce and that don't, and the flag of test networks.
BOUNCE, NO_BOUNCE, TEST = 0x11, 0x51, 0x80


def parse(address: str | None) -> tuple[int, bytes] | None:
    """Workchain and hash; None if the text is no address or its checksum is wrong."""
    if not address:
        return None
    if m := _RAW.match(address.strip()):
        return int(m[1]), bytes.fromhex(m[2])
    try:
        body = base64.urlsafe_b64decode(address.strip().replace("+", "-").replace("/", "_"))
    except (binascii.Error, ValueError):
        return None
    if len(body) != 36 or binascii.crc_hqx(body[:34], 0) != int.from_bytes(body[34:], "big") or body[0] & ~TEST not in (BOUNCE, NO_BOUNCE):
        return None
    return int.from_bytes(body[1:2], "big", signed=True), body[2:34]


def raw_form(address: str | None) -> str | None:
    found = parse(address)
    return f"{found[0]}:{found[1].hex()}" if found else None


def friendly_form(address: str | None, bounce: bool = True) -> str | None:
    found = parse(address)
    if not found:
        return None
    body = bytes([BOUNCE if bounce else NO_BOUNCE]) + found[0].to_bytes(1, "big", signed=True) + found[1]
    return base64.urlsafe_b64encode(body + binascii.crc_hqx(body, 0).to_bytes(2, "big")).decode("ascii")


def canonical(address: Column) -> Column:
    """Raw form; other text in lower case, blank as null. All spellings of an account are one key."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or not v.strip() else raw_form(v) or v.strip().lower())

    return convert(address)


def variants(address: Column) -> Column:
    """All spellings: as given, raw, friendly with and without bounce."""

    @F.pandas_udf("array<string>")
    def spell(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(dict.fromkeys(x for x in (v, raw_form(v), friendly_form(v), friendly_form(v, False)) if x)))

    return spell(address)
