"""Per-session state as batch plans (the twins of the streaming processor).

An action is ``(session, seq..., mid)`` where ``mid`` is a control code:
null = logout, 0 = start (or page refresh), otherwise a message id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..functions.time import epoch_us, from_epoch_us
from .scan import grouped_scan

# -- fixed values: replies of the original back end -------------------------
ERROR_REPLY = "<span class='error_message'>Uh-oh! The back-end gears got jammed. Please try again in a bit</span>"
TIMEOUT_REPLY = "<span class='error_message'>Oops! I got lost in thought. Nudge me again?</span>"
NO_TOKENS = -1


def action_kind(mid: Column) -> Column:
    return F.when(mid.isNull(), F.lit("logout")).when(mid == 0, F.lit("start")).otherwise(F.lit("message"))


def classify_action(df: DataFrame, mid: str = "mid") -> DataFrame:
    return df.withColumn("action", action_kind(F.col(mid)))


def session_state(actions: DataFrame, session: str, order: list[str], ts: str, mid: str = "mid") -> DataFrame:
    """Per action: ``epoch`` (starts so far), ``started`` (the latest control
    is a start) and ``last_start_ts``.  Runs as a split grouped scan, so a hot
    session is spread over many tasks."""
    dtype = actions.schema[ts].dataType
    micros = epoch_us(F.col(ts), dtype)
    m = F.col(mid)
    at = F.struct(F.struct(*order).alias("at"), micros.alias("us"))
    s = grouped_scan(
        actions,
        [session],
        order,
        number="n_in_session",
        sums={"epoch": (m.isNotNull() & (m == 0)).cast("long")},
        maxes={
            "_start": F.when(m.isNotNull() & (m == 0), at),
            "_logout": F.when(m.isNull(), at),
        },
    )
    # the later of the two in the full order, so events of one instant count in their order
    started = F.col("_start").isNotNull() & (
        F.col("_logout").isNull() | (F.col("_start.at") > F.col("_logout.at"))
    )
    return s.withColumn("started", started).withColumn(
        "last_start_ts", from_epoch_us(F.col("_start.us"), dtype)
    ).drop("_start", "_logout")


def orphan_turns(state: DataFrame, mid: str = "mid") -> DataFrame:
    """Messages with no open session: error reply, tokens -1."""
    m = F.col(mid)
    return state.where(m.isNotNull() & (m != 0) & ~F.col("started")).withColumns(
        {"response": F.lit(ERROR_REPLY), "total_tokens": F.lit(NO_TOKENS)}
    )


def session_timeout(state: DataFrame, ts: str, ttl_seconds: int, mid: str = "mid") -> DataFrame:
    """Messages classified by session age: active / expired / orphan."""
    m = F.col(mid)
    dtype = state.schema[ts].dataType
    age = epoch_us(F.col(ts), dtype) - epoch_us(F.col("last_start_ts"), dtype)
    status = (
        F.when(~F.col("started"), F.lit("orphan"))
        .when(age > F.lit(ttl_seconds * 1_000_000), F.lit("expired"))
        .otherwise(F.lit("active"))
    )
    return state.where(m.isNotNull() & (m != 0)).withColumns(
        {"session_age_s": (age / 1_000_000).cast("double"), "status": status}
    )


def token_usage(turns: DataFrame, session: str, order: list[str], text: str) -> DataFrame:
    """Whitespace tokens per turn and the running history size (the whole
    history is re-sent every turn)."""
    t = turns.withColumn("tokens", whitespace_tokens(F.col(text)).cast("long"))
    return grouped_scan(t, [session], order, number=None, sums={"history_tokens": F.col("tokens")})


def history_chunks(turns: DataFrame, session: str, turn: str, role: str, text: str, chunk: int = 64) -> DataFrame:
    """Ordered ``role: text`` history per session, folded in chunks of
    ``chunk`` turns (a session never becomes one unbounded string)."""
    g = turns.withColumn("chunk", F.floor(F.col(turn) / chunk).cast("long")).groupBy(session, "chunk").agg(
        F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("_h"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    return g.select(
        session,
        "chunk",
        "n_turns",
        F.array_join(F.transform("_h", lambda x: F.concat(x[role], F.lit(": "), x[text])), "\n").alias("history"),
    )


def seen_titles(hits: DataFrame, session: list[str], title: str, chunk: int = 200) -> DataFrame:
    """Sorted distinct titles per session (epoch), in numbered pieces of ``chunk`` titles, so that a session
    with any number of titles is never one row."""
    own = grouped_scan(hits.select(*session, title).distinct(), session, [title], number="_n")
    piece = F.floor((F.col("_n") - 1) / chunk).cast("long").alias("chunk")
    return own.groupBy(*session, piece).agg(F.array_join(F.array_sort(F.collect_list(title)), ",").alias("titles"))
