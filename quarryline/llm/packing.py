"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Token t of a queue gets the corpus position at which a fluid that
keeps the target proportions would deliver it; positions are cut into spans of ``windows`` sequences, and each span is
one task that receives its token ranges of every queue. A span starts with the deficits that rounding left at its border
(ideal less delivered tokens), so they carry over from span to span, and inside a span from window to window: each window
adds the queue's share to its deficit, queues are served largest deficit first once ``min_piece`` tokens are due, and the
window is always filled. Only a span's last window can be short. Default targets are the corpus's own proportions, so all
queues run dry together; with other targets a dry queue's share goes to the rest, in proportion.

A queue that ``targets`` doesn't name (all of them by default) has a linear schedule, which its own total and the whole's give, so
any number of sources is scheduled each by itself and the driver holds only the queues that ``targets`` names.

A null source is a queue of its own; null texts are empty and carry only the end id; repeated rows are packed each. The key keeps
its type, and null keys stay null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, prepare, stored
from .pretokens import library_encoder, rows_of, with_end

SMALL, EDGES = 100_000, 100_000
QUEUED = "doc_id {}, queue string, part int, in_part long, doc_tokens long, ids binary"
SLICE = "span long, queue string, at long, whole long, doc_id {}, start long, doc_tokens long, ids binary"
PIECE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _queued(path: str, end_id: int):
    """Encode; each row knows its place in its queue within the task. Ids are stored in two bytes where they fit."""

    def run(batches):
        claim("library", library_encoder.cache_clear)
        encode, part, queues = library_encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            ids = rows_of(*with_end(*encode(batch.column(2)), end_id))
            at = []
            for q, x in zip(names, ids, strict=True):
                at.append(queues.get(q, 0))
                queues[q] = at[-1] + len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([shrunk(x) for x in ids], pa.binary())], names=_names(QUEUED))

    return run


def shrunk(ids: np.ndarray) -> bytes:
    """b'2' and two bytes for each id, or b'4' and four."""
    return b"2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"4" + ids.astype("<u4").tobytes()


def grown(stored_ids: bytes) -> np.ndarray:
    return np.frombuffer(stored_ids, "<u2" if stored_ids[:1] == b"2" else "<u4", offset=1).astype("<u4")


def schedule(totals: dict, targets: dict | None) -> dict:
    """For each queue, points (token, corpus position) of the fluid schedule; linear in between."""
    left = {q: float(n) for q, n in totals.items() if n}
    if targets is None:
        targets = left
    given, at = dict.fromkeys(left, 0.0), 0.0
    points = {q: ([0.0], [0.0]) for q in left}
    while left:
        share = {q: max(float(targets.get(q, 0.0)), 0.0) for q in left}
        if not sum(share.values()):
            share = dict(left)
        whole = sum(share.values())
        span = min(left[q] * whole / share[q] for q in left if share[q])
        at += span
        for q in list(left):
            if share[q]:
                take = min(left[q], span * share[q] / whole)
                given[q] += take
                left[q] -= take
                if left[q] < 1e-6 * max(1.0, totals[q]) and left[q] < 0.5:
                    given[q] = float(totals[q])
                    del left[q]
            points[q][0].append(given[q])
            points[q][1].append(at)
    return points


class Curves:
    """Token of a queue <-> corpus position: by points for the queues of ``targets``, for the rest a line from where those end."""

    def __init__(self, points: dict, total: int):
        self.points = {q: (np.array(t), np.array(x)) for q, (t, x) in points.items()}
        self.begin, self.total = max((x[-1] for _, x in points.values()), default=0.0), float(total)

    def of(self, queue: str, whole: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.points.get(queue)
        return known if known is not None else (np.array([0.0, 0.0, whole]), np.array([0.0, self.begin, self.total]))


def _sliced(curves: Curves, span_tokens: int):
    """Cut each document where its queue crosses from one span into the next."""
    known: dict = {}

    def edge(q, whole, span):
        """The first token of queue q that goes to ``span`` or later."""
        if (q, span) not in known:
            if len(known) > EDGES:
                known.clear()
            t, x = curves.of(q, whole)
            at = span * span_tokens
            known[q, span] = int(t[-1]) if at >= x[np.searchsorted(t, t[-1])] else int(min(t[-1], np.ceil(np.interp(at, x, t) - 0.5)))
        return known[q, span]

    def run(batches):
        for batch in batches:
            out, rows = [[] for _ in range(7)], []
            for row, (q, at, whole, n, ids) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)):
                t, x = curves.of(q, whole)
                width, span = int(ids[:1]), max(0, int(np.interp(at + 0.5, t, x) // span_tokens) - 1)
                start = 0
                while start < n:
                    while edge(q, whole, span + 1) <= at + start and edge(q, whole, span + 1) < whole:
                        span += 1
                    stop = n if edge(q, whole, span + 1) >= whole else min(n, edge(q, whole, span + 1) - at)
                    rows.append(row)
                    for c, v in zip(out, (span, q, at + start, whole, start, n, ids[:1] + ids[1 + width * start : 1 + width * stop]), strict=True):
                        c.append(v)
                    start = stop
            made = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()), strict=True)]
            made.insert(4, batch.column(0).take(pa.array(rows, pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=_names(SLICE))

    return run


def serve(counts: np.ndarray, deficits: np.ndarray, size: int, min_piece: int):
    """Deficit round-robin: yields for each window the (queue, tokens) served; ends when all queues are empty."""
    left, deficit = counts.astype(np.int64), deficits.astype(float).copy()
    total = int(left.sum())
    while total > 0:
        room = min(size, total)
        deficit += left * (room / total)  # what is left keeps the target proportions, so shares follow it
        due_all = left > 0
        if (deficit[due_all] >= np.minimum(min_piece, left[due_all])).all():  # every queue is due: its deficit, and what rounding left to the largest rests
            take = np.minimum(left, np.maximum(deficit, 0).astype(np.int64))
            rest = room - int(take.sum())
            most = np.argsort(take - deficit, kind="stable")
            most = most[left[most] > take[most]][: max(rest, 0)]
            if rest == len(most):
                take[most] += 1
                left -= take
                deficit -= take
                total -= room
                yield [(q, n) for q, n in enumerate(take.tolist()) if n]
                continue
        served = []
        order = np.argsort(-deficit, kind="stable")
        for due in (True, False):  # first what is due, then whatever fills the window
            for q in order:
                if room <= 0:
                    break
                n = min(int(left[q]), room)
                if n and (due and deficit[q] >= min(min_piece, left[q]) or not due):
                    n = min(n, max(int(deficit[q]), min(min_piece, n))) if due else min(n, max(min_piece, int(deficit[q])))
                    served.append((int(q), n))
                    left[q] -= n
                    deficit[q] -= n
                    room -= n
                    total -= n
        while room > 0 and total > 0:
            q = int(np.argmax(left))
            n = min(int(left[q]), room)
            served.append((q, n))
            left[q] -= n
            deficit[q] -= n
            room -= n
            total -= n
        yield served


def _packed(curves: Curves, queues_in_all: int, size: int, windows: int, min_piece: int):
    stride = windows + queues_in_all // size + 2  # a border rounds each queue by less than a token

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("queue", "ascending"), ("at", "ascending"), ("doc_id", "ascending")])
        span = table["span"][0].as_py()
        names, ids = table["queue"].to_pylist(), [grown(x) for x in table["ids"].to_pylist()]
        sizes, starts = np.array([len(x) for x in ids], np.int64), table["start"].to_numpy()
        first = np.array([i for i, q in enumerate(names) if not i or names[i - 1] != q] + [len(names)], np.int64)
        queues = [names[i] for i in first[:-1]]
        counts = np.add.reduceat(sizes, first[:-1])
        places, ideal = table["at"].to_numpy()[first[:-1]], np.zeros(len(queues))
        wholes = table["whole"].to_numpy()
        for i, q in enumerate(queues):
            t, x = curves.of(q, int(wholes[first[i]]))
            ideal[i] = places[i] - np.interp(span * windows * size, x, t)
        runs: list[tuple[int, int, int, int]] = []  # queue, window, place in it, tokens
        for w, served in enumerate(serve(counts, -ideal, size, min_piece)):
            merged: dict[int, int] = {}
            for q, n in served:
                merged[q] = merged.get(q, 0) + n
            offset = 0
            for q, n in merged.items():
                runs.append((q, w, offset, n))
                offset += n
        by_run = np.array(runs, np.int64).reshape(-1, 4)
        out: list[list] = [[] for _ in range(6)]
        by_run = by_run[np.argsort(by_run[:, 0], kind="stable")]
        at_run = np.searchsorted(by_run[:, 0], np.arange(len(queues) + 1))
        for i in range(len(queues)):
            mine = by_run[at_run[i] : at_run[i + 1]]
            run_from = np.cumsum(mine[:, 3]) - mine[:, 3]
            doc_from = np.cumsum(sizes[first[i] : first[i + 1]]) - sizes[first[i] : first[i + 1]]
            cuts = np.union1d(run_from, doc_from)
            ends = np.r_[cuts[1:], counts[i]]
            doc, run_at = np.searchsorted(doc_from, cuts, "right") - 1, np.searchsorted(run_from, cuts, "right") - 1
            flat = np.concatenate(ids[first[i] : first[i + 1]]).tobytes()
            crc = [zlib.crc32(flat[4 * lo : 4 * hi]) for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True)]
            row = first[i] + doc
            for c, v in zip(out, (row, starts[row] + cuts - doc_from[doc], ends - cuts, np.array(crc, np.int64), span * stride + mine[run_at, 1], mine[run_at, 2] + cuts - run_from[run_at]), strict=True):
                c.append(v)
        row, start, length, crc, sequence, offset = (np.concatenate(c) for c in out)
        return pa.Table.from_arrays([table["doc_id"].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), table["doc_tokens"].take(pa.array(row)), pa.array(sequence), pa.array(offset)], names=_names(PIECE))

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, targets: dict | None = None, end_id: int = 0, windows: int = 1024, min_piece: int = 16, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Pieces (PIECE) of all documents of ``docs`` in sequences of at most ``size`` tokens.

    Tokens are encoded once and stored with their place in the task's part of the queue; sums for each part and queue
    give the global place. One shuffle moves the ids to their spans; a span holds about ``windows * size`` tokens however
    large a source is. Empty input gives no pieces.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[source].cast("string"), F.lit("\0null")).alias("queue"), docs[text].alias("text"))
    kept = stored(rows.mapInArrow(_queued(path, end_id), QUEUED.format(kind)), "queues", compression="zstd")
    sums = stored(kept.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n")), "sums")
    count, total = sums.agg(F.count_distinct("queue"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = {q: n for q, n in (targets or {}).items() if n > 0}
    totals = {r["queue"]: r["n"] for r in sums.where(F.col("queue").isin(list(named))).groupBy("queue").agg(F.sum("n").alias("n")).collect()} if named else {}
    curves = Curves(schedule(totals, named) if named else {}, total)
    of = Window.partitionBy("queue")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(of).alias("whole"))
    if sums.count() <= SMALL:
        base = F.broadcast(base)  # SMALL rows at most; else Spark shuffles both sides
    placed = kept.join(base, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("in_part")).alias("at"), "whole", "doc_tokens", "ids")
    slices = placed.mapInArrow(_sliced(curves, size * windows), SLICE.format(kind))
    return slices.groupBy("span").applyInArrow(_packed(curves, count, size, windows, min_piece), PIECE.format(kind))
