"""Request/response correlation, reply cache, prefix purge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_us
from .scan import grouped_scan
from .sessions import TIMEOUT_REPLY


def correlate(
    requests: DataFrame,
    responses: DataFrame,
    keys: list[str],
    req_id: str,
    req_ts: str,
    resp_id: str,
    resp_ts: str,
    limit_seconds: int = 120,
    slices: int | None = None,
) -> DataFrame:
    """First response at or after each request, within ``limit_seconds``.

    An as-of join without pairs: requests and responses are unioned and
    scanned per key in *descending* time, carrying the running maximum of
    ``(-t, -id)`` over the responses seen so far, i.e. the earliest later
    response (a response at the same instant counts).  The scan is
    :func:`ferrule.operators.scan.grouped_scan`, so a hot key is split over
    many tasks.  Output: keys, request id/ts, response id/ts, latency_ms,
    status (matched / timeout), reply text for timeouts.  Ids are numeric.
    """
    lim = limit_seconds * 1_000_000
    rq = requests.select(
        *keys,
        F.col(req_id).alias("_id"),
        epoch_us(F.col(req_ts), requests.schema[req_ts].dataType).alias("_t"),
        F.col(req_ts).alias("_ts"),
        F.lit(0).alias("_kind"),
    )
    rs = responses.select(
        *keys,
        F.col(resp_id).alias("_id"),
        epoch_us(F.col(resp_ts), responses.schema[resp_ts].dataType).alias("_t"),
        F.col(resp_ts).alias("_ts"),
        F.lit(1).alias("_kind"),
    )
    u = rq.unionByName(rs)
    nxt = F.when(
        F.col("_kind") == 1,
        F.struct((-F.col("_t")).alias("nt"), (-F.col("_id")).alias("nid"), F.col("_ts").alias("ts")),
    )
    # descending time; at the same instant the response comes first (counts)
    scanned = grouped_scan(u, keys, [-F.col("_t"), -F.col("_kind"), -F.col("_id")], number=None, maxes={"_next": nxt},
                           slices=slices)
    req = scanned.where(F.col("_kind") == 0)
    ok = F.col("_next").isNotNull() & (-F.col("_next.nt") <= F.col("_t") + F.lit(lim))
    return req.select(
        *keys,
        F.col("_id").alias(req_id),
        F.col("_ts").alias(req_ts),
        F.when(ok, -F.col("_next.nid")).alias(resp_id),
        F.when(ok, F.col("_next.ts")).alias(resp_ts),
        F.when(ok, ((-F.col("_next.nt") - F.col("_t")) / 1000).cast("long")).alias("latency_ms"),
        F.when(ok, F.lit("matched")).otherwise(F.lit("timeout")).alias("status"),
        F.when(~ok, F.lit(TIMEOUT_REPLY)).alias("reply"),
    )


def reply_cache(replies: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Last write per reply key wins (partial aggregation, hot-key safe)."""
    cols = [c for c in replies.columns if c != key]
    return (
        replies.groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.struct(*seq)).alias("_l"))
        .select(key, "_l.*")
    )


def purge_prefix(cache: DataFrame, sessions: DataFrame, key: str, session: str, sep: str = "") -> DataFrame:
    """Drop cache entries whose key starts with ``<session><sep>`` of any session; ids may hold ``sep`` and be prefixes of others.

    Each distinct key meets the sessions by one equality per prefix length that the sessions have, so nothing is compared
    pairwise.  Null keys stay, null sessions purge nothing, an empty session with an empty ``sep`` purges every key."""
    s = sessions.select(F.concat(F.col(session).cast("string"), F.lit(sep)).alias("_s")).where("_s is not null").distinct()
    lengths = s.agg(F.sort_array(F.collect_set(F.length("_s")))).scalar()
    keys = cache.select(F.col(key).cast("string").alias("_k")).where("_k is not null").distinct()
    each = keys.select("_k", lengths.alias("_n")).select("_k", F.explode("_n").alias("_n")).where(F.col("_n") <= F.length("_k"))
    gone = each.select("_k", F.substring("_k", F.lit(1), F.col("_n")).alias("_s")).join(s, "_s", "left_semi").select("_k").distinct()
    return cache.join(gone, F.col(key).cast("string") == F.col("_k"), "left_anti")
