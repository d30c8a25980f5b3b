"""Scalar functions as column expressions: digests, pseudonyms, channels, costs, token estimates, text rules."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequency_channel(mhz: Column) -> Column:
    """The channel number of a centre frequency in MHz; 0 if there is none."""
    low = F.when(mhz == 2484, 14).when(mhz.between(2412, 2472) & ((mhz - 2407) % 5 == 0), (mhz - 2407) / 5)
    five = low.when(mhz.between(4910, 4980) & (mhz % 5 == 0), (mhz - 4000) / 5).when(mhz.between(5000, 5895) & (mhz % 5 == 0), (mhz - 5000) / 5)
    six = five.when(mhz == 5935, 2).when(mhz.between(5955, 7115) & ((mhz - 5950) % 5 == 0), (mhz - 5950) / 5)
    return six.when((mhz >= 58320) & ((mhz - 56160) % 2160 == 0), (mhz - 56160) / 2160).otherwise(0).cast("int")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the keyed digest of a string or binary column, by two nested digests."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def hardware_pseudonym(digest: Column) -> Column:
    """A locally administered unicast address from a hex digest: its first twelve digits, with the two low bits of the first octet set to 10."""
    octet = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").bitwiseOR(F.lit(2)).bitwiseAND(F.lit(254))
    return F.concat_ws(":", F.lower(F.lpad(F.hex(octet), 2, "0")), *(F.substring(digest, 2 * k + 1, 2) for k in range(1, 6)))


def call_cost(prompt: Column, completion: Column, cached: Column, prompt_rate: Column, completion_rate: Column, cached_rate: Column) -> Column:
    """struct(cost, status) of a call at rates per million; the cost is null where a count or rate that it needs is unknown or counts don't add up."""
    hit = F.coalesce(cached, F.lit(0))
    unpriced = prompt_rate.isNull() | completion_rate.isNull() | ((hit > 0) & cached_rate.isNull())
    status = (
        F.when(~F.coalesce((prompt >= 0) & (completion >= 0), F.lit(False)), "missing_usage")
        .when((hit < 0) | (hit > prompt), "invalid_cached_usage")
        .when(unpriced, "missing_price")
        .otherwise("estimated_from_returned_usage")
    )
    cost = ((prompt - hit) * prompt_rate + completion * completion_rate + hit * F.coalesce(cached_rate, F.lit(0.0))) / 1e6
    return F.struct(F.when(status == "estimated_from_returned_usage", cost).alias("cost"), status.alias("status"))


def token_estimate(text: Column, messages: Column) -> Column:
    """An upper estimate of a request's tokens: a token a byte, and fixed shares for each message and the request."""
    return F.octet_length(text) + 32 * messages + 256


def squeezed(text: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clipped(text: Column, most: int = 2000) -> Column:
    """struct(text, truncated): the first `most` characters and whether there were more."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))
