"""Votes, decisions and response bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import constants as K


def fraud_score(frauds: Column) -> Column:
    """Frauds among the five neighbours, by five; missing neighbours count as legitimate."""
    return (F.coalesce(frauds, F.lit(0)) / F.lit(K.NEIGHBOURS)).cast("float")


def approved(frauds: Column) -> Column:
    """Score below 0.6, decided on the integer count."""
    return F.coalesce(frauds, F.lit(0)) < K.DENIED_FROM


def count_from_score(score: Column) -> Column:
    return F.round(score * K.NEIGHBOURS).cast("int")


def response_body(frauds: Column) -> Column:
    """One of six fixed bodies; null (a request that could not be read) has the first."""
    bodies = F.array(*map(F.lit, K.RESPONSES))
    return F.element_at(bodies, F.coalesce(frauds, F.lit(0)).cast("int") + 1)


def label_bit(bits: Column, position: Column) -> Column:
    """The label at a position of the bit set, given its byte (lowest bit first)."""
    return F.call_function("shiftright", bits.cast("int"), (position % 8).cast("int")).bitwiseAND(F.lit(1)).cast("tinyint")
