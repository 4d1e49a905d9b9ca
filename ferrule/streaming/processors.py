"""Stateful per-key processors for ``applyInPandasWithState``.

Each processor sorts its rows by the event order inside a micro-batch and
carries the key's state across batches (RocksDB state store), so the result
does not depend on how the input is cut into batches as long as a key's rows
arrive in order.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql.streaming.state import GroupState

from ..operators.sessions import ERROR_REPLY, NO_TOKENS, TIMEOUT_REPLY

SESSION_OUT = (
    "user_id long, event_id long, mid long, action string, epoch long, started boolean, "
    "novel boolean, status string, response string, total_tokens int"
)
SESSION_STATE = "started boolean, epoch long, seen string"


def _controls(pdf: pd.DataFrame, started0: bool):
    """Vectorised control codes of a key's rows (sorted; ``mid`` without nulls, which ``logout``
    marks, so that ids stay 64-bit integers): start/logout masks and whether the session is open at each row (last control wins)."""
    logout = pdf["logout"].to_numpy()
    start = (pdf["mid"] == 0).to_numpy() & ~logout
    ctrl = pd.Series(np.where(start, 1.0, np.where(logout, 0.0, np.nan))).ffill()
    open_ = ctrl.fillna(1.0 if started0 else 0.0).to_numpy() == 1.0
    return start, logout, open_


def session_machine(key, pdfs, state: GroupState):
    """start: open, new epoch, reset the seen set; message: reply (error if
    not open), title novelty within the epoch; logout: close, clear the seen
    set (a 'closed' row, no reply).  Vectorised over the key's rows of the
    micro-batch; the state carries (open, epoch, titles seen this epoch)."""
    if state.exists:
        started0, epoch0, seen_json = state.get
        seen0 = set(json.loads(seen_json))
    else:
        started0, epoch0, seen0 = False, 0, set()
    pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"]).reset_index(drop=True)
    start, logout, open_ = _controls(pdf, bool(started0))
    msg = ~start & ~logout
    epoch = epoch0 + np.cumsum(start)
    ok_msg = msg & open_
    title = pdf["title"].to_numpy(dtype=object)
    # a title is new if not given earlier in the same epoch (this batch or, for the
    # epoch carried in from the state, an earlier batch)
    novel = np.zeros(len(pdf), dtype=bool)
    idx = np.flatnonzero(ok_msg)
    if len(idx):
        novel[idx] = ~pd.DataFrame({"e": epoch[idx], "t": title[idx]}).duplicated().to_numpy()
        if seen0:
            novel &= ~((epoch == epoch0) & pd.Series(title).isin(seen0).to_numpy())
    err = msg & ~open_
    n = len(pdf)
    none = np.full(n, None, dtype=object)
    mid_obj = none.copy()
    mid_obj[~logout] = pdf["mid"][~logout].astype("int64").tolist()
    novel_obj = none.copy()
    novel_obj[ok_msg] = novel[ok_msg].tolist()
    resp_obj = none.copy()
    resp_obj[err] = ERROR_REPLY
    tok_obj = none.copy()
    tok_obj[err] = NO_TOKENS
    out = pd.DataFrame({
        "user_id": np.full(n, key[0]),
        "event_id": pdf["event_id"].to_numpy(),
        "mid": mid_obj,
        "action": np.where(logout, "logout", np.where(start, "start", "message")),
        "epoch": epoch.astype("int64"),
        "started": open_,
        "novel": novel_obj,
        "status": np.where(logout, "closed", np.where(err, "error", "ok")),
        "response": resp_obj,
        "total_tokens": tok_obj,
    })
    started1 = bool(open_[-1]) if len(pdf) else bool(started0)
    epoch1 = int(epoch[-1]) if len(pdf) else int(epoch0)
    if started1:
        seen1 = {t for t in title[ok_msg & (epoch == epoch1)].tolist() if t is not None}
        if epoch1 == epoch0:
            seen1 |= seen0
    else:
        seen1 = set()
    state.update((started1, epoch1, json.dumps(sorted(seen1))))
    yield out


NONE, NEVER = -(2**63), 2**63 - 1  # instead of a null id and a null time
KEYS = 1024  # groups the users of a stream are dealt to; part of a checkpoint's state


def _packed(*columns) -> bytes:
    """Rows of 64-bit integers as bytes of state."""
    return np.stack([np.asarray(c, np.int64) for c in columns], 1).tobytes()


def _unpacked(state: GroupState, width: int) -> np.ndarray:
    """Columns of the rows a state holds (none without a state)."""
    return np.frombuffer(bytes(state.get[0]) if state.exists else b"", np.int64).reshape(-1, width).T


def _joined(held: np.ndarray, pdfs, columns: list[str]) -> list[np.ndarray]:
    """Columns of the held rows, then of the new ones (none on a timeout)."""
    new = [] if pdfs is None else [p[columns] for p in pdfs]
    return [np.concatenate([h, *(p[c].astype("int64").to_numpy() for p in new)]) for c, h in zip(columns, held)]


def _users(no_user: np.ndarray, user: np.ndarray):
    return pd.arrays.IntegerArray(user.copy(), no_user.astype(bool))


CORRELATE_OUT = "user_id long, event_id long, ts_us long, resp_event_id long, resp_us long, status string"
CORRELATE_STATE = "pending binary"


def make_correlator(limit_us: int):
    """As-of correlation per user without pairs: each request takes the first
    response at or after it (same instant counts) if it is within the limit.

    Only the watermark decides: a request is matched once the watermark has
    passed its response (no earlier one can come any more) and times out once
    it has passed its limit.  Until then requests and responses wait in state,
    so the order in which they arrive within the watermark's delay makes no
    difference.  The state holds the rows of the last ``limit`` + delay.
    A request without a time (``NEVER``) is matched at once with a response without
    one that came beside it, or times out.  A group holds many users (``no_user``, ``user_id``).  Vectorised: carried
    and new rows are sorted together and a reverse running minimum of response
    positions gives every request its user's next response."""
    columns = ["no_user", "user_id", "t", "kind", "id"]

    def run(key, pdfs, state: GroupState):
        no_user, user, t, kind, ids = _joined(_unpacked(state, 5), None if state.hasTimedOut else pdfs, columns)
        order = np.lexsort((ids, ids == NONE, kind, t, user, no_user))
        no_user, user, t, kind, ids = (x[order] for x in (no_user, user, t, kind, ids))
        n = len(t)
        if not n:
            return
        of = np.append(0, np.cumsum((user[1:] != user[:-1]) | (no_user[1:] != no_user[:-1])))
        # a request comes before a response of its instant, so the next response may be at the same instant
        nxt = np.minimum.accumulate(np.where(kind == 1, np.arange(n), n)[::-1])[::-1]
        there = np.minimum(nxt, n - 1)
        nt = t[there]
        req = kind == 0
        timed = t < NEVER
        found = req & (nxt < n) & (of[there] == of) & (timed == timed[there])
        found[found] = nt[found] - t[found] <= limit_us
        passed = (state.getCurrentWatermarkMs() or 0) * 1000  # rows at or after this instant can still come
        matched = found & (~timed | (nt < passed))
        timed_out = req & ~found & (~timed | (t < passed - limit_us))
        wait = req & ~matched & ~timed_out
        at = np.flatnonzero(matched | timed_out)
        if len(at):
            yield pd.DataFrame({
                "user_id": _users(no_user[at], user[at]),
                "event_id": ids[at],
                "ts_us": np.where(timed, t, NONE)[at],
                "resp_event_id": pd.arrays.IntegerArray(ids[there[at]], timed_out[at]),
                "resp_us": pd.arrays.IntegerArray(np.where(timed, nt, NONE)[at], timed_out[at]),
                "status": np.where(matched[at], "matched", "timeout").astype(object),
            })
        first = np.full(of[-1] + 1, passed)  # responses of a user before it serve no request
        np.minimum.at(first, of[wait], t[wait])
        keep = wait | ((kind == 1) & timed & (t >= first[of]))
        if not keep.any():
            if state.exists:
                state.remove()
            return
        state.update((_packed(no_user[keep], user[keep], t[keep], kind[keep], ids[keep]),))
        due = np.where(found, nt, t + limit_us)[wait]
        due = int(due.min()) if len(due) else int(t[keep].max())
        state.setTimeoutTimestamp(max(due // 1000 + 1, (state.getCurrentWatermarkMs() or 0) + 1))

    return run


CLOCK_OUT = "user_id long, event_id long, session_age_s double, status string"
CLOCK_STATE = "started boolean, last_start_us long"


def make_session_clock(ttl_us: int):
    """Login expiry per session: each message is active, expired (older than
    the TTL since the last start) or orphan (no open session).  Vectorised
    over the key's rows; the state carries (open, last start)."""

    def run(key, pdfs, state: GroupState):
        started0, last0 = state.get if state.exists else (False, None)
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"]).reset_index(drop=True)
        start, logout, open_ = _controls(pdf, bool(started0))
        t = pdf["t"].to_numpy(dtype=np.int64)
        last = pd.Series(np.where(start, t, np.nan)).ffill()
        if last0 is not None:
            last = last.fillna(float(last0))
        last = last.to_numpy()
        msg = ~start & ~logout
        age_us = t - last
        status = np.where(~open_, "orphan", np.where(age_us > ttl_us, "expired", "active"))
        out = pd.DataFrame({
            "user_id": key[0],
            "event_id": pdf["event_id"].to_numpy(),
            "session_age_s": age_us / 1_000_000,
            "status": status,
        })[msg]
        started1 = bool(open_[-1]) if len(pdf) else bool(started0)
        last1 = None if np.isnan(last[-1]) else int(last[-1]) if len(pdf) else last0
        state.update((started1, last1))
        yield out

    return run


ENDS_OUT = "user_id long, start_us long, end_us long, reason string"
ENDS_STATE = "open binary"


def make_session_ends(ttl_us: int):
    """One row per session when it ends: by logout, by the next start, or by a timer ``ttl_us`` after its start, whichever is
    first (a control at that very instant counts as one).  Rows are control codes only, in order across batches.  A group
    holds many users (``no_user``, ``user_id``): an open session is three numbers of state, an ended one none, and the
    group's timer is that of its oldest session."""
    columns = ["no_user", "user_id", "t", "event_id", "start"]

    def run(key, pdfs, state: GroupState):
        held = _unpacked(state, 3)
        none, one = np.zeros(held.shape[1], np.int64), np.ones(held.shape[1], np.int64)
        no_user, user, t, event, start = _joined([*held, none, one], None if state.hasTimedOut else pdfs, columns)
        n = len(t)
        if not n:
            return
        order = np.lexsort((event, t, np.arange(n) >= len(none), user, no_user))  # what a user holds comes first
        no_user, user, t, start = (x[order] for x in (no_user, user, t, start))
        begun = np.flatnonzero(start)
        nxt = np.minimum(begun + 1, n - 1)
        follows = (begun + 1 < n) & (user[nxt] == user[begun]) & (no_user[nxt] == no_user[begun])
        until = t[begun] + ttl_us
        in_time = follows & (t[nxt] <= until)
        reason = np.where(~in_time, "expired", np.where(start[nxt] == 1, "restart", "logout")).astype(object)
        done = follows | (until < (state.getCurrentWatermarkMs() or 0) * 1000)
        at = begun[done]
        if len(at):
            yield pd.DataFrame({"user_id": _users(no_user[at], user[at]), "start_us": t[at], "end_us": np.where(in_time, t[nxt], until)[done],
                                "reason": reason[done]})
        open_ = begun[~done]
        if len(open_):
            state.update((_packed(no_user[open_], user[open_], t[open_]),))
            state.setTimeoutTimestamp(max((int(t[open_].min()) + ttl_us) // 1000 + 1, (state.getCurrentWatermarkMs() or 0) + 1))
        elif state.exists:
            state.remove()

    return run
