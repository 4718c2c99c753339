"""Not-modified revisits of web archives: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, stash

#: Header fields that a not-modified answer may bring up to date (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, ``www.`` and default port, path without a closing slash, sorted query without tracking.

    A fragment is dropped, an empty path is ``/``; null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _tag(value: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(value), r'^W/', "")


def latest_responses(records: DataFrame) -> DataFrame:
    """(record_id, response_id): for each revisit, the latest full response of its canonical URL with an earlier date.

    ``records`` has record_id, canonical, date and is_response. Rows are dealt to ranges of (URL, date), so a URL with a
    third of all rows is many ranges; each range carries its last response along, and what the ranges before ended with
    comes from one small row per URL and range. Of responses of one instant the one with the largest id counts.
    """
    order = [F.col("date"), F.col("is_response"), F.col("record_id")]  # at one instant revisits come first: not earlier
    light = records.where(F.col("canonical").isNotNull() & F.col("date").isNotNull() & F.col("record_id").isNotNull())
    light = light.select("record_id", "canonical", "date", "is_response")
    ranged = stash(light.repartitionByRange("canonical", *order).withColumn("part", F.spark_partition_id()), "revisit-ranges")
    response = F.when(F.col("is_response"), F.col("record_id"))
    inside = F.last(response, ignorenulls=True).over(W.partitionBy("part", "canonical").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    ends = ranged.groupBy("canonical", "part").agg(F.max_by(response, F.when(F.col("is_response"), F.struct("date", "record_id"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("canonical").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("canonical", "part", before.alias("carried")).where("carried IS NOT NULL")
    found = ranged.select("record_id", "canonical", "part", "is_response", inside.alias("own")).where(~F.col("is_response"))
    return found.join(carried, ["canonical", "part"], "left").select("record_id", F.coalesce("own", "carried").alias("response_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record: record_id, canonical, date, is_response, response_id, status, headers.

    ``records`` has record_id (string), url, date (timestamp), is_response (a full response; else a not-modified
    revisit) and headers (a map with names in lower case). A revisit is ``resolved`` when its validators agree with the
    latest earlier full response of its canonical URL: the entity tags where both have one (weak comparison), else the
    last-modified dates where both have one. Then its headers are the response's, brought up to date with the permitted
    fields of its own; all other fields of it are dropped. Else the status is ``validator_mismatch``, ``no_validator`` or
    ``no_earlier_response``, and the headers are its own. Responses have status ``response`` and name themselves.

    A null URL, date or id finds no response; a null is_response counts as a revisit, null headers as none. An id names
    one record: rows that repeat it are repeats of one row and give one row each. Further columns are ignored; an empty
    input gives no row.
    """
    r = columns_of(records, "record_id", "url", "date", "is_response", "headers")
    empty = F.create_map().cast("map<string,string>")
    r = r.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "date", F.coalesce("is_response", F.lit(False)).alias("is_response"),
        F.coalesce("headers", empty).alias("headers"),
    )
    r = stash(r, "revisit-records")
    found = latest_responses(r.dropDuplicates(["record_id"]))
    told = r.where("is_response").groupBy(F.col("record_id").alias("response_id")).agg(F.max(_pairs("headers")).alias("_full"))
    joined = r.where(~F.col("is_response")).join(found.where("response_id IS NOT NULL"), "record_id", "left").join(told, "response_id", "left")
    full = F.map_from_entries("_full")
    own, tags, dates = F.col("headers"), [_tag(_header(c, "etag")) for c in (F.col("headers"), full)], [F.trim(_header(c, "last-modified")) for c in (F.col("headers"), full)]
    both_tags, both_dates = tags[0].isNotNull() & tags[1].isNotNull(), dates[0].isNotNull() & dates[1].isNotNull()
    status = (
        F.when(F.col("response_id").isNull(), "no_earlier_response").when(both_tags, F.when(tags[0] == tags[1], "resolved").otherwise("validator_mismatch"))
        .when(both_dates, F.when(dates[0] == dates[1], "resolved").otherwise("validator_mismatch")).otherwise("no_validator")
    )
    update = F.map_filter(own, lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(full, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(update), k), F.lit(False))), update)
    revisits = joined.withColumn("status", status).select(
        "record_id", "canonical", "date", "is_response", "response_id", "status", F.when(F.col("status") == "resolved", merged).otherwise(own).alias("headers"),
    )
    responses = r.where("is_response").select("record_id", "canonical", "date", "is_response", F.col("record_id").alias("response_id"), F.lit("response").alias("status"), "headers")
    return responses.unionByName(revisits)


def _pairs(headers: str) -> Column:
    """A map as sorted entries, which can be compared."""
    return F.array_sort(F.map_entries(headers))


def header_lines(headers: str) -> Column:
    return F.array_join(F.transform(_pairs(headers), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Add the ``payload`` of the full response to responses and resolved revisits; ``payloads`` has record_id and payload."""
    own = payloads.groupBy(F.col("record_id").alias("_of")).agg(F.max("payload").alias("payload"))
    wanted = F.when(F.col("status").isin("response", "resolved"), F.col("response_id"))
    return resolved.withColumn("_wanted", wanted).join(own, F.col("_wanted") == F.col("_of"), "left").drop("_wanted", "_of")
