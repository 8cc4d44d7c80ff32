"""Identity rules: keys of concepts, relations and edges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs stripped from both ends of a concept's key.
KEY_SIGNS = " .,;:!?\"'`()[]{}<>*_#"


def node_key(label: Column) -> Column:
    return F.btrim(F.lower(F.btrim(F.regexp_replace(label, r"(?U)\s+", " "))), F.lit(KEY_SIGNS))


def relation_key(relation: Column) -> Column:
    """Lower case, blanks and hyphens to underscores, letters, digits and underscores only, 60 characters; null if nothing is left."""
    spaced = F.regexp_replace(F.btrim(F.replace(F.lower(relation), F.lit("-"), F.lit(" "))), r"(?U)\s+", "_")
    return F.nullif(F.substring(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", ""), 1, 60), F.lit(""))


def short_hash(prefix: str, *parts: Column, size: int = 12) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))


def edge_id(source, target, relation, description=None, source_id=None, chunk_id=None, agent=None, valid_from=None) -> Column:
    """What makes two assertions the same relation: these eight parts, nulls as empty."""
    parts = (source, target, relation, description, source_id, chunk_id, agent, valid_from)
    return short_hash("e-", *[F.lit("") if p is None else p for p in parts])


def truthy(value: Column, otherwise: float) -> Column:
    """The value, or another where it is null or 0: zero counts as missing."""
    return F.when(value.isNull() | (value == 0), F.lit(otherwise)).otherwise(value)


def confidence(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def parse_time(value: Column) -> Column:
    """ISO dates and date-times to UTC without a zone, whole seconds; null if it can't be read. A date is its midnight; a time without a zone is UTC, whatever the session's zone is."""
    text = F.btrim(value)
    zone = F.regexp_extract(text, r"(?:[zZ]|[+-]\d{2}:?\d{2})$", 0)
    zone = F.when(F.length(text) > 10, zone).otherwise("")
    local = F.substring(text, F.lit(1), F.length(text) - F.length(zone))
    stamp = F.try_to_timestamp(F.concat(F.replace(local, F.lit(" "), F.lit("T")), F.when(F.length(local) == 10, "T00:00:00").when(F.length(local) == 16, ":00").otherwise(""), F.when(F.lower(zone).isin("", "z"), "+00:00").otherwise(zone)))
    seconds = F.unix_seconds(stamp)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz")))
