"""A recurrent generator: one gated layer reads a session and tells the next token and the time until it.

The log is never collected.  Sessions are dealt to shards by hash; in each epoch
every shard makes its own Adam steps from the same weights, streaming through its
sessions in batches, and the weights of all shards are averaged by their tokens.
With one shard (up to SHARD_SESSIONS sessions) this is plain training.  The driver
sees the vocabulary, one average of the weights and one loss an epoch, all bounded
by MOST_TOKENS and the settings.  Samples are drawn in blocks of sessions, each with
a seed of its own, so they do not depend on partitions.

Defined results: gaps below a millisecond count as one; sessions are read up to
max_length events; equal times keep the order of event ids; without gaps all draws
are one second; without sessions fitting is an error; repeated event ids are events
of their own; columns that are not named here are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.randomness import derive_seed, uniform
from tidemark.functions.ranking import order_statistics
from tidemark.functions.scratch import stored
from tidemark.operators.sequences import in_session

#: Tokens of a vocabulary that has a column of weights each.
MOST_TOKENS = 20_000
#: Sessions of a shard, until there are MOST_SHARDS of them; a task streams through its shard.
SHARD_SESSIONS, MOST_SHARDS = 8192, 1024
#: Numbers of a tensor that one row carries while shards are averaged; a task of the average holds MOST_SHARDS rows.
PIECE = 1 << 14
#: Sessions that are drawn at once; kept gaps of a bin.
BLOCK, KEPT = 256, 64
LEAST_GAP = 1e-3
DECAY, EPSILON, MOST_NORM = (0.9, 0.999), 1e-8, 5.0
LOG_SPREAD = (-5.0, 3.0)

Weights = dict[str, np.ndarray]


def initial(tokens: int, outcomes: int, h: Mapping[str, Any]) -> Weights:
    """Seeded weights; row 0 of ``embed`` stands for the start."""
    rng, e, n = np.random.default_rng(h["seed"]), h["embedding_dim"], h["hidden_dim"]
    shapes = {"embed": (tokens + 1, e), "input": (e, 3 * n), "state": (n, 3 * n), "bias": (3 * n,), "token": (n, tokens), "token_bias": (tokens,), "gap": (n, outcomes), "gap_bias": (outcomes,)}
    scale = lambda name: 1.0 if name == "embed" else 1 / math.sqrt(n)
    return {k: (rng.standard_normal(s) if k == "embed" else rng.uniform(-scale(k), scale(k), s)).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def advance(w: Weights, before: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The state after inputs ``x``, with the gates that made it: update, reset, candidate."""
    n = before.shape[1]
    fed = x @ w["input"] + w["bias"]
    gates = _sigmoid(fed[:, : 2 * n] + before @ w["state"][:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    c = np.tanh(fed[:, 2 * n :] + (r * before) @ w["state"][:, 2 * n :])
    return z * before + (1 - z) * c, z, r, c


def _mixture(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights, means and clipped log spreads of the components."""
    k = out.shape[1] // 3
    top = out[:, :k].max(axis=1, keepdims=True)
    logs = out[:, :k] - top - np.log(np.exp(out[:, :k] - top).sum(axis=1, keepdims=True))
    return logs, out[:, k : 2 * k], np.clip(out[:, 2 * k :], *LOG_SPREAD)


def _gap_loss(out: np.ndarray, target: np.ndarray, binned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood of each row's bin or log gap, and its slope."""
    at = np.arange(len(out))
    if binned:
        slope = _softmax(out)
        loss = -np.log(np.maximum(slope[at, target.astype(int)], 1e-30))
        slope[at, target.astype(int)] -= 1
        return loss, slope
    logs, mean, spread = _mixture(out)
    z = (target[:, None] - mean) / np.exp(spread)
    each = logs - spread - 0.5 * z * z - 0.5 * math.log(2 * math.pi)
    top = each.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(each - top).sum(axis=1))
    share = np.exp(each - total[:, None])
    raw = out[:, 2 * mean.shape[1] :]
    free = (raw > LOG_SPREAD[0]) & (raw < LOG_SPREAD[1])
    return -total, np.hstack([np.exp(logs) - share, -share * z / np.exp(spread), share * (1 - z * z) * free])


def loss_and_slopes(w: Weights, batch: list[tuple[np.ndarray, np.ndarray]], binned: bool, slopes: bool = True) -> tuple[float, int, Weights]:
    """Summed loss, tokens, and the slopes of the mean loss a token, of sessions as (codes from 1, bins or log gaps).

    Step j reads token j, the start for j = 0, and tells token j + 1 and the gap between them.
    """
    kind, n = w["input"].dtype, w["state"].shape[0]
    rows, longest = len(batch), max(len(t) for t, _ in batch)
    codes = np.zeros((rows, longest + 1), dtype=np.int64)
    gaps = np.zeros((rows, longest), dtype=np.float64)
    for i, (t, g) in enumerate(batch):
        codes[i, 1 : len(t) + 1] = t
        gaps[i, 1 : len(g) + 1] = g
    count = int((codes > 0).sum())
    state, kept, total = np.zeros((rows, n), dtype=kind), [], 0.0
    made = {k: np.zeros_like(v) for k, v in w.items()} if slopes else {}
    for j in range(longest):
        x = w["embed"][codes[:, j]]
        after, z, r, c = advance(w, state, x)
        on = np.flatnonzero(codes[:, j + 1])
        live = after[on]
        share = _softmax(live @ w["token"] + w["token_bias"])
        at, wanted = np.arange(len(on)), codes[on, j + 1] - 1
        total -= float(np.log(np.maximum(share[at, wanted], 1e-30)).sum())
        share[at, wanted] -= 1
        told = None
        if j:
            loss, told = _gap_loss(live @ w["gap"] + w["gap_bias"], gaps[on, j], binned)
            total += float(loss.sum())
        if slopes:
            back = np.zeros_like(after)
            share = (share / count).astype(kind)
            made["token"] += live.T @ share
            made["token_bias"] += share.sum(axis=0)
            back[on] = share @ w["token"].T
            if told is not None:
                told = (told / count).astype(kind)
                made["gap"] += live.T @ told
                made["gap_bias"] += told.sum(axis=0)
                back[on] += told @ w["gap"].T
            kept.append((state, x, z, r, c, back))
        state = after
    later = np.zeros((rows, n), dtype=kind)
    for j in range(longest - 1, -1, -1) if slopes else ():
        before, x, z, r, c, back = kept[j]
        d = back + later
        inner = d * (1 - z) * (1 - c * c)
        through = inner @ w["state"][:, 2 * n :].T
        gates = np.hstack([d * (before - c) * z * (1 - z), through * before * r * (1 - r)])
        made["state"][:, : 2 * n] += before.T @ gates
        made["state"][:, 2 * n :] += (r * before).T @ inner
        whole = np.hstack([gates, inner])
        made["input"] += x.T @ whole
        made["bias"] += whole.sum(axis=0)
        np.add.at(made["embed"], codes[:, j], whole @ w["input"].T)
        later = d * z + through * r + gates @ w["state"][:, : 2 * n].T
    return total, count, made


def step(w: Weights, first: Weights, second: Weights, slopes: Weights, taken: int, rate: float) -> None:
    """One step of Adam in place, the slopes held to MOST_NORM."""
    norm = math.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
    hold = min(1.0, MOST_NORM / (norm + 1e-6))
    a, b = 1 - DECAY[0] ** taken, 1 - DECAY[1] ** taken
    for k, g in slopes.items():
        g = g * hold
        first[k] += (1 - DECAY[0]) * (g - first[k])
        second[k] += (1 - DECAY[1]) * (g * g - second[k])
        w[k] -= (rate * (first[k] / a) / (np.sqrt(second[k] / b) + EPSILON)).astype(w[k].dtype)


def _coded(batch: pa.RecordBatch, codes: Mapping[str, int], edges: np.ndarray | None) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Shard, and codes with bins or log gaps, of each session."""
    for shard, tokens, gaps in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), batch.column("gaps").to_pylist(), strict=True):
        logs = np.log(np.maximum(np.array(gaps, dtype=np.float64), LEAST_GAP))
        yield shard, (np.array([codes[t] for t in tokens]), logs if edges is None else np.searchsorted(edges, logs, side="left"))


def _batches(batches: Iterator[pa.RecordBatch], codes: Mapping[str, int], edges: np.ndarray | None, size: int) -> Iterator[tuple[int, list]]:
    """Mini-batches that never mix shards."""
    shard, held = None, []
    for batch in batches:
        for at, session in _coded(batch, codes, edges):
            if held and (at != shard or len(held) == size):
                yield shard, held
                held = []
            shard = at
            held.append(session)
    if held:
        yield shard, held


_MOVED = "shard int, tensor string, piece int, tokens bigint, steps bigint, body binary"


def _trained(shard: int, tensors: Mapping[str, Weights], tokens: int, steps: int) -> Iterator[pa.RecordBatch]:
    for role, weights in tensors.items():
        for name, v in weights.items():
            flat = v.astype("<f4").ravel()
            for piece in range(0, max(1, len(flat)), PIECE):
                body = flat[piece : piece + PIECE].tobytes()
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "tensor": [f"{role}/{name}"], "piece": pa.array([piece // PIECE], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "steps": pa.array([steps], pa.int64()), "body": pa.array([body], pa.binary())})


def _average(table: pa.Table) -> pa.Table:
    """The mean of one piece over the shards, by their tokens and in their order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    tokens = sum(r["tokens"] for r in rows)
    body = sum(np.frombuffer(r["body"], "<f4").astype(np.float64) * (r["tokens"] / tokens) for r in rows)
    first = rows[0]
    return pa.table({"tensor": [first["tensor"]], "piece": pa.array([first["piece"]], pa.int32()), "steps": pa.array([max(r["steps"] for r in rows)], pa.int64()), "body": pa.array([body.astype("<f4").tobytes()], pa.binary())})


def _epoch(train: DataFrame, shards: int, number: int, now: tuple[Weights, Weights, Weights, int], known: tuple[dict, np.ndarray | None], h: Mapping[str, Any]) -> tuple[Weights, Weights, Weights, int]:
    """One pass of every shard over its sessions, in an order of the epoch's own, and the average."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast((now, known))  # weights and vocabulary, bounded by MOST_TOKENS and the settings
    size, rate = h["batch_size"], h["learning_rate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (begun, codes_edges), at, own, tokens = sent.value, None, None, 0
        for shard, batch in _batches(batches, *codes_edges, size):
            if shard != at:
                if own is not None:
                    yield from _trained(at, dict(zip("wfs", own[:3], strict=True)), tokens, own[3])
                own, at, tokens = [*({k: v.copy() for k, v in part.items()} for part in begun[:3]), begun[3]], shard, 0
            _, count, slopes = loss_and_slopes(own[0], batch, codes_edges[1] is not None)
            own[3] += 1
            tokens += count
            step(*own[:3], slopes, own[3], rate)
        if own is not None:
            yield from _trained(at, dict(zip("wfs", own[:3], strict=True)), tokens, own[3])

    order = uniform(h["seed"], f"epoch {number}", F.col("session"))
    dealt = train.withColumn("__order", order).repartition(shards, "shard").sortWithinPartitions("shard", "__order", "session")
    moved = dealt.select("shard", "tokens", "gaps").mapInArrow(run, _MOVED)
    rows = moved.groupBy("tensor", "piece").applyInArrow(_average, "tensor string, piece int, steps bigint, body binary").collect()
    sent.unpersist()
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["tensor"], r["piece"])):
        parts.setdefault(r["tensor"], []).append(np.frombuffer(r["body"], "<f4"))
    whole = [{k: np.concatenate(parts[f"{role}/{k}"]).reshape(v.shape).astype(np.float32) for k, v in now[0].items()} for role in "wfs"]
    return whole[0], whole[1], whole[2], max(r["steps"] for r in rows)


def mean_loss(sessions: DataFrame, weights: Weights, known: tuple[dict, np.ndarray | None], size: int) -> float:
    """Loss a token over all ``sessions``, summed where they lie."""
    sent = sessions.sparkSession.sparkContext.broadcast((weights, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, codes_edges) = sent.value
        for _, batch in _batches(batches, *codes_edges, size):
            loss, count, _ = loss_and_slopes(w, batch, codes_edges[1] is not None, slopes=False)
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": pa.array([count], pa.int64())})

    r = sessions.select("shard", "tokens", "gaps").mapInArrow(run, "loss double, n bigint").agg(F.sum("loss"), F.sum("n")).first()
    sent.unpersist()
    return r[0] / r[1]


def gap_bins(gaps: DataFrame, most: int) -> list[tuple[float | None, list[float]]]:
    """(upper edge in log seconds, seconds to draw from) of each bin of ``gaps.x``.

    One bin for each value where there are no more than ``most``, else quantiles of
    evenly spaced order statistics; the last bin has no edge.
    """
    few = sorted(r[0] for r in gaps.select("x").distinct().limit(most + 1).collect())
    if not few:
        return [(None, [1.0])]
    if len(few) <= most:
        edges = [(math.log(a) + math.log(b)) / 2 for a, b in pairwise(few)]
        return [(e, [v]) for e, v in zip([*edges, None], few, strict=True)]
    points = order_statistics(gaps, F.col("x"), KEPT * most).first()["points"]
    logs = np.log(points)
    edges = np.unique(logs[[round(i * (len(logs) - 1) / most) for i in range(1, most)]])
    members = np.searchsorted(edges, logs, side="left")
    held = [[p for p, m in zip(points, members, strict=True) if m == i] for i in range(len(edges) + 1)]
    spaced = [[own[round(k * (len(own) - 1) / (min(KEPT, len(own)) - 1 or 1))] for k in range(min(KEPT, len(own)))] for own in held]
    return [(e, own) for e, own in zip([*map(float, edges), None], spaced, strict=True) if own]


def fit(seq: DataFrame, h: Mapping[str, Any]) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Tables (vocabulary, bins, weights) and what training tells about itself."""
    spark, w = seq.sparkSession, in_session(seq)
    at = F.unix_micros("timestamp")
    placed = seq.select(*(c for c in ("learner_id",) if c in seq.columns), "session_id", "token", F.row_number().over(w).alias("pos"), ((F.lead(at).over(w) - at) / 1e6).alias("x")).filter(F.col("pos") <= h["max_length"])
    read = placed.withColumn("x", F.when(F.col("x").isNotNull() & (F.col("pos") < h["max_length"]), F.greatest("x", F.lit(LEAST_GAP))))
    keys = [c for c in ("learner_id", "session_id") if c in placed.columns]
    rows = read.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "x"))).alias("e"))
    sessions = stored(rows.select(F.concat_ws("\x1f", *keys).alias("session"), F.transform("e", lambda e: e["token"]).alias("tokens"), F.filter(F.transform("e", lambda e: e["x"]), lambda x: x.isNotNull()).alias("gaps")))
    names = [r[0] for r in sessions.select(F.explode("tokens").alias("t")).distinct().limit(MOST_TOKENS + 1).collect()]
    if not names:
        raise ValueError("there are no sessions to learn from")
    if len(names) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens; take a coarser tokenization")
    names.sort()
    binned = h["timing"] == "binned"
    gaps = sessions.select(F.explode("gaps").alias("x"))
    bins = gap_bins(gaps, h["n_bins"]) if binned else []
    edges = np.array([e for e, _ in bins if e is not None]) if binned else None
    known = ({t: i + 1 for i, t in enumerate(names)}, edges)
    total = sessions.count()
    shards = min(MOST_SHARDS, math.ceil(total / SHARD_SESSIONS))
    dealt = sessions.withColumn("shard", F.floor(uniform(h["seed"], "shard", F.col("session")) * shards).cast("int"))
    held = uniform(h["seed"], "validation", F.col("session")) < h["validation_fraction"]
    tried = dealt.filter(held)
    if tried.limit(1).count() and dealt.filter(~held).limit(1).count():
        train = dealt.filter(~held)
    else:
        train = tried = dealt
    begun = initial(len(names), len(bins) if binned else 3 * h["n_mixtures"], h)
    zeros = lambda: {k: np.zeros_like(v) for k, v in begun.items()}
    now, best, kept, stale, history = (begun, zeros(), zeros(), 0), math.inf, begun, 0, []
    for number in range(h["epochs"]):
        now = _epoch(train, shards, number, now, known, h)
        history.append(mean_loss(tried, now[0], known, h["batch_size"]))
        if history[-1] < best - 1e-6:
            best, kept, stale = history[-1], now[0], 0
        else:
            stale += 1
            if stale >= h["patience"]:
                break
    low, high = gaps.agg(F.min("x"), F.max("x")).first()
    span = [0.0, 0.0] if low is None else [math.log(low), math.log(high)]
    tables = {
        "vocabulary": spark.createDataFrame([(i + 1, t) for i, t in enumerate(names)], "code int, token string"),
        "bins": spark.createDataFrame([(i, e, v) for i, (e, v) in enumerate(bins)], "bin int, edge double, seconds array<double>"),
        "weights": spark.createDataFrame([(k, list(v.shape), bytearray(v.astype("<f4").tobytes())) for k, v in sorted(kept.items())], "tensor string, shape array<int>, body binary"),
    }
    return tables, {"epochs_trained": len(history), "validation_loss": best, "history": history, "n_parameters": int(sum(v.size for v in kept.values())), "log_gap_range": span}


def _loaded(model: Mapping[str, DataFrame]) -> tuple[list[str], list[list[float]], Weights]:
    names = [r["token"] for r in model["vocabulary"].orderBy("code").collect()]
    bins = [r["seconds"] for r in model["bins"].orderBy("bin").collect()]
    weights = {r["tensor"]: np.frombuffer(bytes(r["body"]), "<f4").astype(np.float32).reshape(r["shape"]) for r in model["weights"].collect()}
    if set(weights) != {"embed", "input", "state", "bias", "token", "token_bias", "gap", "gap_bias"} or weights["token"].shape[1] != len(names):
        raise ValueError("the weights of this model are not those of its vocabulary")
    return names, bins, weights


def _chosen(share: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first outcome of each row whose cumulative share passes u."""
    up = np.cumsum(share, axis=1)
    return np.minimum((up <= (u * up[:, -1])[:, None]).sum(axis=1), share.shape[1] - 1)


def drawn(lengths: np.ndarray, rng: np.random.Generator, weights: Weights, bins: list[list[float]], span: tuple[float, float], dwell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and seconds since the start, a row for each session; what is past its length is not used.

    A gap is multiplied by the ``dwell`` of the token before it.
    """
    rows, longest = len(lengths), int(lengths.max())
    codes, at = np.zeros((rows, longest), dtype=np.int64), np.zeros((rows, longest))
    state, last = np.zeros((rows, weights["state"].shape[0]), dtype=np.float32), np.zeros(rows, dtype=np.int64)
    for j in range(longest):
        state = advance(weights, state, weights["embed"][last])[0]
        u = rng.random((4, rows))
        if j:
            out = state @ weights["gap"] + weights["gap_bias"]
            if bins:
                seconds = np.array([own[int(v * len(own))] for own, v in zip((bins[b] for b in _chosen(_softmax(out), u[0])), u[1], strict=True)])
            else:
                logs, mean, spread = _mixture(out)
                row, k = np.arange(rows), _chosen(np.exp(logs), u[0])
                normal = np.sqrt(-2 * np.log1p(-u[1])) * np.cos(2 * math.pi * u[2])
                seconds = np.exp(np.clip(mean[row, k] + np.exp(spread[row, k]) * normal, *span))
            at[:, j] = at[:, j - 1] + np.maximum(LEAST_GAP, seconds * dwell[last - 1])
        last = _chosen(_softmax(state @ weights["token"] + weights["token_bias"]), u[3]) + 1
        codes[:, j] = last
    return codes, at


def walk(model: Mapping[str, DataFrame], skeleton: DataFrame, span: tuple[float, float], seed: int = 0, scale: Mapping[str, float] | None = None) -> DataFrame:
    """(session_id, pos, token, at_s) for the sessions (i, len) of ``skeleton``; a task holds BLOCK sessions at once."""
    spark: SparkSession = skeleton.sparkSession
    sent = spark.sparkContext.broadcast(_loaded(model))  # bounded by MOST_TOKENS and the settings

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, bins, weights = sent.value
        rows = table.sort_by("i")
        lengths, ids = rows.column("len").to_numpy(), rows.column("i").to_pylist()
        rng = np.random.Generator(np.random.Philox(derive_seed(seed, "gru", str(key[0].as_py()))))
        factors = scale or {}
        dwell = np.array([factors.get("*", 1.0) * factors.get(t, 1.0) for t in names])
        codes, at = drawn(lengths, rng, weights, bins, span, dwell)
        pos = np.concatenate([np.arange(n) for n in lengths])
        row = np.repeat(np.arange(len(lengths)), lengths)
        tokens = pa.DictionaryArray.from_arrays(pa.array(codes[row, pos] - 1, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
        return pa.table({"session_id": pa.array([f"S{ids[r]:06d}" for r in row], pa.string()), "pos": pa.array(pos + 1, pa.int32()), "token": tokens, "at_s": np.round(at[row, pos], 3)})

    blocks = skeleton.select("i", F.col("len").cast("int").alias("len"), F.floor(F.col("i") / BLOCK).cast("bigint").alias("block"))
    return blocks.groupBy("block").applyInArrow(run, "session_id string, pos int, token string, at_s double")
