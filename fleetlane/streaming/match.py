"""task/completion matching on streams (batch twin: O20), with per-key
state and one row per request, never pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from fleetlane.streaming.runner import END_TYPE


FIRST_SCHEMA = "req_id long, r_key long, r_us long, done_us long, status string"
FIRST_STATE = "req_ids array<long>, req_keys array<long>, req_us array<long>, comp_keys array<long>, comp_us array<long>"


def next_completions(r_key, r_us, c_key, c_us):
    """Per request, the first completion of its key at or after it, or -1;
    one sort of all rows together."""
    key, t = np.concatenate([r_key, c_key]), np.concatenate([r_us, c_us])
    done = np.concatenate([np.zeros(len(r_key), bool), np.ones(len(c_key), bool)])
    order = np.lexsort((done, t, key))
    key, t, done = key[order], t[order], done[order]
    n = len(order)
    at = np.minimum.accumulate(np.where(done, np.arange(n), n)[::-1])[::-1]
    near = np.minimum(at, max(n - 1, 0))
    found = np.where((at < n) & (key[near] == key), t[near], -1) if n else np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    out[order] = found
    return out[:len(r_key)]


def _first_fn(timeout_s: int):
    width = timeout_s * 1_000_000

    def fn(key, pdfs, state):
        wm_us = state.getCurrentWatermarkMs() * 1000
        r_id, r_key, r_us, c_key, c_us = ([np.asarray(x, np.int64)] for x in (state.get if state.exists else [()] * 5))
        if not state.hasTimedOut:
            for pdf in pdfs:
                # rows behind the watermark are late: dropped; the end marker has no key
                pdf = pdf[(pdf["t_us"] >= wm_us) & pdf["k"].notna()]
                req, done = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
                for held, new in ((r_id, req["event_id"]), (r_key, req["k"]), (r_us, req["t_us"]),
                                  (c_key, done["k"]), (c_us, done["t_us"])):
                    held.append(new.to_numpy(np.int64))
        r_id, r_key, r_us, c_key, c_us = (np.concatenate(x) for x in (r_id, r_key, r_us, c_key, c_us))
        near = next_completions(r_key, r_us, c_key, c_us)
        near = np.where(near <= r_us + width, near, -1)
        # final once the watermark has passed the answer (no earlier row can come)
        done = (near >= 0) & (near <= wm_us)
        lost = (near < 0) & (r_us + width < wm_us)
        keep, later = ~(done | lost), c_us >= wm_us  # older completions meet no new request
        if keep.any() or later.any():
            state.update(tuple(x.tolist() for x in (r_id[keep], r_key[keep], r_us[keep], c_key[later], c_us[later])))
            due = np.where(near[keep] >= 0, near[keep], r_us[keep] + width)
            due = int(due.min()) if len(due) else max(wm_us, int(c_us[later].max()))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done.any() or lost.any():
            out = pd.DataFrame({"req_id": r_id, "r_key": r_key, "r_us": r_us,
                                "done_us": pd.array(np.where(done, near, 0), "Int64"),
                                "status": np.where(done, "success", "timeout")})
            out.loc[lost, "done_us"] = pd.NA
            yield out[done | lost]
    return fn


def first_match_stream(events: DataFrame, key: str = "user_id", timeout_s: int = 3600,
                       delay: str = "1 hour", submit_type: str = "signup",
                       done_type: str = "purchase", buckets: int = 64) -> DataFrame:
    """T2 without pairs: per key, the open requests and the not-yet-final
    completions live in state; each request gets exactly one row - its
    first completion within ``timeout_s`` (success) or none (timeout).

    A result is emitted only when it is final: success once the watermark
    passed the completion's time (an earlier, late completion can no
    longer arrive), timeout once it passed ts + timeout.  Matching is a
    sorted search, so a busy key costs O((requests + completions) log n)
    per batch, never requests x completions.  Rows behind the watermark
    are dropped as late.

    State is kept in ``buckets`` groups by the hash of key and stretch of
    ``timeout_s``, so that a trigger makes few calls, each over many keys at
    once.  A request's answer lies in its own stretch or the next, so a
    completion is sent to the buckets of its own stretch and of the one
    before.  A key that holds a large share of the rows is thus spread over
    buckets by time; rows leave the state when they have passed.  Keys are
    integers; ``buckets`` must stay as it is over restarts."""
    t = F.col("event_type")
    stretch = F.floor(F.unix_micros("ts") / (timeout_s * 1_000_000))
    ev = (events.withWatermark("ts", delay)
                .where(t.isin(submit_type, done_type, END_TYPE))
                .select("event_id", F.col(key).alias("k"), "ts",
                        F.unix_micros("ts").alias("t_us"),
                        F.when(t == done_type, 1).otherwise(0).alias("kind"),
                        F.explode(F.when(t == done_type, F.array(stretch, stretch - 1))
                                  .otherwise(F.array(stretch))).alias("stretch")))
    bucket = F.pmod(F.xxhash64("k", "stretch"), F.lit(buckets)).alias("bucket")
    return (ev.select("event_id", "k", "ts", "t_us", "kind", bucket).groupBy("bucket")
              .applyInPandasWithState(_first_fn(timeout_s), FIRST_SCHEMA, FIRST_STATE, "append",
                                      GroupStateTimeout.EventTimeTimeout))
