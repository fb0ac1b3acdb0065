"""Consensus from several annotators' labels by message passing on the item-annotator graph.

Every class is taken against the rest. On each edge (item i, annotator j) with the mark v = 1 if j chose the class, else
0, two messages go to and fro until they stand still::

    p[i->j] = sigmoid(prior + sum over the item's other annotators k of y[k->i])
    y[j->i] = log(hit / alarm) if v else log((1 - hit) / (1 - alarm))

where hit and alarm are how often j chose the class on other items that had it, and that had it not, counted with their
messages p (and a little in the annotator's favour where nothing is known). So an annotator's worth is two numbers: one
who inverts labels speaks against what they choose, one who always gives the same label or guesses says nothing. The
consensus is the class with the greatest sum of messages; nothing but the messages decides.

The messages stand still when no p moves by ``tol`` or more in a sweep; from half of ``max_iter`` on, sweeps are averaged
with the former ones, which ends swings between two states. Messages that still move after ``max_iter`` are an error.

Scale: with at most ``max_broadcast_annotators`` the annotators' totals are broadcast, and an item's edges, at most as many
as there are annotators, are one row. Then a sweep is a narrow map that shuffles nothing, and the totals are sums over
each task's rows and a few more over all tasks, so an annotator with a third of all edges costs nothing extra. Beyond,
totals come back to the edges by a join on (annotator, salt), and the sums over an item are aggregates joined back, so
that no item is gathered. Either way a sweep is cut by a checkpoint of the edges with their messages, and the former one
deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.session import cut, release, staged, stored

SALTS = 64


class Consensus(NamedTuple):
    """What ``message_passing`` gives: two tables, the number of sweeps, and the greatest move of a message in the last."""

    items: DataFrame
    annotators: DataFrame
    sweeps: int
    moved: float


def votes(results: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(receipt_id, judge_id, label): one vote per item and annotator, the last usable answer.

    An answer is unusable if its label is none of ``classes`` (after trimming, in any case), if it has no reason, or
    if it is the all-default row (UNCERTAIN at confidence 0) that a failed call leaves behind. Null confidence alone
    does not make an answer unusable. Rows with a null item or annotator are no votes. Ties in attempt and time are
    settled by result_id.
    """
    label = F.upper(F.trim("label"))
    reasons = F.filter("reasons", lambda r: F.trim(r) != "")
    failed = (label == "UNCERTAIN") & (F.coalesce(F.col("confidence"), F.lit(1.0)) == 0)
    usable = label.isin(*classes) & (F.coalesce(F.size(reasons), F.lit(0)) > 0) & ~failed
    order = F.struct("attempt", "judged_at", "result_id")
    return (
        results.where(usable & F.col("receipt_id").isNotNull() & F.col("judge_id").isNotNull())
        .select("receipt_id", "judge_id", label.alias("label"), order.alias("o"))
        .groupBy("receipt_id", "judge_id")
        .agg(F.max_by("label", "o").alias("label"))
    )


def _back(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """Join annotator totals to the edges, an annotator's edges in several parts."""
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = edges.withColumn("salt", F.pmod(F.xxhash64("receipt_id"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["judge_id", "salt"]).drop("salt")


def message_passing(
    edges: DataFrame,
    classes: tuple[str, ...] = ("REAL", "FAKE", "UNCERTAIN"),
    max_iter: int = 200,
    tol: float = 1e-3,
    favour: float = 1.0,
    max_broadcast_annotators: int = 100_000,
) -> Consensus:
    """Consensus of (receipt_id, judge_id, label), which must be unique per pair.

    items: receipt_id, label, scores (per class), n_votes, agreement (share of votes equal to the consensus).
    annotators: judge_id, n_votes, reliability (hit less alarm of each class, -1 to 1), accuracy (share of votes equal to
    the consensus). Ties in the score go to the class named first. An empty input gives two empty tables.
    """
    edges = edges.select("receipt_id", "judge_id", "label")
    names = edges.select("judge_id").distinct().limit(max_broadcast_annotators + 1).collect()
    if len(names) <= max_broadcast_annotators:
        return _few(edges, sorted(r[0] for r in names), classes, max_iter, tol, favour)
    return _many(edges, classes, max_iter, tol, favour)


def _few(edges: DataFrame, names: list[str], classes: tuple[str, ...], max_iter: int, tol: float, favour: float) -> Consensus:
    """``message_passing`` where the annotators' totals fit every task."""
    spark, n, many = edges.sparkSession, range(len(classes)), len(names)
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"j int, judge_id {edges.schema['judge_id'].dataType.simpleString()}"))
    kind = reduce(lambda acc, k: F.when(F.col("label") == classes[k], k).otherwise(acc), n, F.lit(-1))
    numbered = edges.join(number, "judge_id").select("receipt_id", "j", kind.cast("int").alias("c"))
    shares = numbered.agg(F.count("*").alias("d"), *[F.count_if(F.col("c") == k).alias(f"s{k}") for k in n]).first()
    share = [shares[f"s{k}"] / max(shares["d"], 1) for k in n]
    packed = numbered.groupBy("receipt_id").agg(F.collect_list(F.struct("j", "c")).alias("e")).select("receipt_id", F.col("e.j").alias("j"), F.col("e.c").alias("c"))
    columns = ["receipt_id", "j", "c", *[f"p{k}" for k in n], "change"]
    kind_of_id = edges.schema["receipt_id"].dataType.simpleString()
    schema = f"receipt_id {kind_of_id}, j array<int>, c array<int>, " + ", ".join(f"p{k} array<double>" for k in n) + ", change double"

    def lists(start: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[start, len(values)].astype(np.int32)), pa.array(values))

    def flat(b: pa.RecordBatch, name: str) -> np.ndarray:
        return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Batches with their annotators, classes, the item of each edge and where items begin."""
        for b in batches:
            if b.num_rows:
                sizes = np.diff(np.asarray(b.column(1).offsets))
                yield b, flat(b, "j"), flat(b, "c"), np.repeat(np.arange(b.num_rows), sizes), np.r_[0, np.cumsum(sizes)[:-1]]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, c, item, start in whole(batches):
            size = np.bincount(item)
            p = [(np.add.reduceat((c == k) * 1.0, start)[item] - (c == k) + share[k]) / size[item] for k in n]
            yield pa.RecordBatch.from_arrays([*b.columns, *[lists(start, x) for x in p], pa.array(np.ones(b.num_rows))], columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's totals: of each annotator the edges, then hits, all and alarms of each class; and the greatest move."""
        total, moved = np.zeros((1 + 3 * len(classes), many)), 0.0
        for b, j, c, _, _ in whole(batches):
            total[0] += np.bincount(j, minlength=many)
            for k in n:
                p, own = flat(b, f"p{k}"), c == k
                for i, x in enumerate((p * own, p, (1 - p) * own)):
                    total[1 + 3 * k + i] += np.bincount(j, x, many)
            moved = max(moved, float(b.column(b.num_columns - 1).to_numpy().max()))
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), moved)), *[pa.array(x[at]) for x in total]], ["j", "moved", *[f"t{i}" for i in range(len(total))]])

    def totals_of(state: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        """The annotators' totals, the prior log odds of each class, and the greatest move."""
        parts = range(1 + 3 * len(classes))
        sums = state.mapInArrow(count, "j int, moved double, " + ", ".join(f"t{i} double" for i in parts)).groupBy("j").agg(F.max("moved").alias("moved"), *[F.sum(f"t{i}").alias(f"t{i}") for i in parts])
        total, moved = np.zeros((len(parts), many)), 0.0
        for r in sums.collect():  # one row for each annotator
            total[:, r["j"]] = [r[f"t{i}"] for i in parts]
            moved = max(moved, r["moved"])
        odds = np.clip(total[2::3].sum(axis=1) / max(total[0].sum(), 1.0), 1e-6, 1 - 1e-6)
        return total, np.log(odds / (1 - odds)), moved

    def spoken(total: np.ndarray, k: int, j: np.ndarray, c: np.ndarray, p: np.ndarray | float, rest: np.ndarray | float) -> np.ndarray:
        """y at every edge, from the annotator's totals without the edge's own part."""
        own = c == k
        hit = (total[1 + 3 * k][j] - p * own + 2 * favour) / (total[2 + 3 * k][j] - p + 3 * favour)
        alarm = (total[3 + 3 * k][j] - rest * own + favour) / (total[0][j] - total[2 + 3 * k][j] - rest + 3 * favour)
        return np.where(own, np.log(hit / alarm), np.log((1 - hit) / (1 - alarm)))

    def sweep(sent, mixed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, prior = sent.value
            for b, j, c, item, start in whole(batches):
                moved, out = np.zeros(len(j)), []
                for k in n:
                    p = flat(b, f"p{k}")
                    y = spoken(total, k, j, c, p, 1 - p)
                    q = 1 / (1 + np.exp(np.clip(y - np.add.reduceat(y, start)[item] - prior[k], -700, 700)))
                    q = (q + p) / 2 if mixed else q
                    moved = np.maximum(moved, np.abs(q - p))
                    out.append(lists(start, q))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *out, pa.array(np.maximum.reduceat(moved, start))], columns)

        return run

    def decide(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, prior = sent.value
            for b, j, c, item, start in whole(batches):
                # Every annotator is judged by other items.
                p = [flat(b, f"p{k}") for k in n]
                score = np.stack([prior[k] + np.add.reduceat(spoken(total, k, j, c, p[k], 1 - p[k]), start) for k in n], axis=1)
                best, size = score.argmax(axis=1), np.bincount(item)
                same = np.add.reduceat((c == best[item]) * 1.0, start) / size
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([classes[i] for i in best]), pa.array(list(score), pa.list_(pa.float64())), pa.array(size), pa.array(same)], ["receipt_id", "label", "scores", "n_votes", "agreement"])

        return run

    state, sweeps = cut(packed.mapInArrow(begin, schema)), 0
    while True:
        total, prior, moved = totals_of(state)
        sent = spark.sparkContext.broadcast((total, prior))
        if moved < tol:
            break
        if sweeps == max_iter:
            raise RuntimeError(f"messages not converged after {max_iter} sweeps: the last moved by {moved}")
        before, state = state, cut(state.mapInArrow(sweep(sent, 2 * sweeps >= max_iter), schema))
        sweeps += 1
        release(before)
        sent.unpersist()
    items = cut(state.mapInArrow(decide(sent), f"receipt_id {kind_of_id}, label string, scores array<double>, n_votes bigint, agreement double"))
    worth = [(total[1 + 3 * k] + 2 * favour) / (total[2 + 3 * k] + 3 * favour) - (total[3 + 3 * k] + favour) / (total[0] - total[2 + 3 * k] + 3 * favour) for k in n]
    rows = [(names[i], int(total[0][i]), [float(w[i]) for w in worth]) for i in range(many)]
    annotators = spark.createDataFrame(rows, f"judge_id {edges.schema['judge_id'].dataType.simpleString()}, n_votes long, reliability array<double>")
    return Consensus(items, annotators.join(_accuracy(edges, items), "judge_id", "left"), sweeps, moved)


def _accuracy(edges: DataFrame, items: DataFrame) -> DataFrame:
    hits = edges.withColumnRenamed("label", "vote").join(items.select("receipt_id", "label"), "receipt_id")
    return hits.groupBy("judge_id").agg(F.avg((F.col("vote") == F.col("label")).cast("double")).alias("accuracy"))


def _many(edges: DataFrame, classes: tuple[str, ...], max_iter: int, tol: float, favour: float) -> Consensus:
    """``message_passing`` where they do not."""
    n = range(len(classes))
    chosen = [F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in classes]
    edges = cut(edges)

    def over_items(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """``df`` with sums over the rows of its item."""
        return df.join(df.groupBy("receipt_id").agg(*[F.sum(v).alias(k) for k, v in sums.items()]), "receipt_id")

    def log_odds(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(x / (1 - x))

    def worth(hits: Column, of: Column, more: float) -> Column:
        """A rate from counts; what is not known is favourable (two thirds of hits, one third of alarms)."""
        return (hits + (1 + more) * favour) / (of + 3 * favour)

    def spoken(df: DataFrame, own: bool) -> list[Column]:
        """y at every edge with its annotator's totals: without the edge's own part, which messages p hold, if ``own``."""
        out = []
        for k in n:
            p = F.col(f"p{k}") if own else F.lit(0.0)
            rest = (1 - p) if own else F.lit(0.0)
            hit = worth(F.col(f"a{k}") - p * chosen[k], F.col(f"A{k}_") - p, 1.0)
            alarm = worth(F.col(f"b{k}") - rest * chosen[k], F.col("d") - F.col(f"A{k}_") - rest, 0.0)
            out.append(F.when(chosen[k] == 1, F.log(hit / alarm)).otherwise(F.log((1 - hit) / (1 - alarm))))
        return out

    # At first an item's other votes speak for themselves, with the share of the class among all as one more vote.
    shares = edges.agg(*[F.avg(chosen[k]).alias(f"s{k}") for k in n]).first()
    share = [shares[f"s{k}"] or 0.0 for k in n]
    first = over_items(edges, {"m": F.lit(1), **{f"t{k}": chosen[k] for k in n}})
    state = first.select("receipt_id", "judge_id", "label", *[((F.col(f"t{k}") - chosen[k] + share[k]) / F.col("m")).alias(f"p{k}") for k in n])

    def totals_of(state: DataFrame) -> tuple[DataFrame, str, dict[str, float]]:
        """The annotators' totals, what is to be released of them, and the sums and the greatest move over all of them."""
        sums = [c for k in n for c in (F.sum(F.col(f"p{k}") * chosen[k]).alias(f"a{k}"), F.sum(f"p{k}").alias(f"A{k}_"), F.sum((1 - F.col(f"p{k}")) * chosen[k]).alias(f"b{k}"))]
        # The optimizer must know how small they are: estimates that go round in the loop would grow without end.
        out, path = stored(state.groupBy("judge_id").agg(F.count("*").cast("double").alias("d"), F.max("change").alias("change"), *sums))
        s = out.agg(F.sum("d").alias("d"), F.max("change").alias("change"), *[F.sum(f"A{k}_").alias(f"A{k}") for k in n]).first()
        # The prior goes with the rows: as a number in the plan it would have the code of every sweep compiled anew.
        prior = [log_odds(F.lit((s[f"A{k}"] or 0.0) / (s["d"] or 1.0))) for k in n]
        return out.drop("change").withColumns({f"o{k}": prior[k] for k in n}), path, s.asDict()

    state = cut(state.withColumn("change", F.lit(1.0)))
    sweeps = 0
    while True:
        totals, path, s = totals_of(state)
        if not s["d"] or s["change"] < tol:
            break
        if sweeps == max_iter:
            raise RuntimeError(f"messages not converged after {max_iter} sweeps: the last moved by {s['change']}")
        joined = _back(state, totals)
        y = joined.select("receipt_id", "judge_id", "label", *[f"p{k}" for k in n], *[f"o{k}" for k in n], *[c.alias(f"y{k}") for k, c in enumerate(spoken(joined, True))])
        y = over_items(y, {f"t{k}": F.col(f"y{k}") for k in n})
        p = [1 / (1 + F.exp(-(F.col(f"o{k}") + F.col(f"t{k}") - F.col(f"y{k}")))) for k in n]
        if 2 * sweeps >= max_iter:
            p = [(p[k] + F.col(f"p{k}")) / 2 for k in n]
        moves = staged(y, **{f"q{k}": p[k] for k in n})
        change = F.greatest(*[F.abs(F.col(f"q{k}") - F.col(f"p{k}")) for k in n])
        before, state = state, cut(moves.select("receipt_id", "judge_id", "label", *[F.col(f"q{k}").alias(f"p{k}") for k in n], change.alias("change")))
        sweeps += 1
        release(before)
        release(path)

    # The item's score is what all its annotators say, each of them judged by other items.
    scored = _back(state, totals)
    scored = scored.select("receipt_id", "label", *[f"o{k}" for k in n], *[c.alias(f"y{k}") for k, c in enumerate(spoken(scored, True))])
    sums = scored.groupBy("receipt_id").agg(
        F.count("*").alias("n_votes"), *[(F.first(f"o{k}") + F.sum(f"y{k}")).alias(f"s{k}") for k in n], *[F.count_if(F.col("label") == c).alias(f"v{k}") for k, c in enumerate(classes)]
    )
    score = [F.col(f"s{k}") for k in n]
    same = reduce(lambda acc, k: F.when(F.col("label") == classes[k], F.col(f"v{k}")).otherwise(acc), n, F.lit(0))
    items = sums.withColumn("label", _argmax(score, classes))
    items = cut(items.select("receipt_id", "label", F.array(*score).alias("scores"), "n_votes", (same / F.col("n_votes")).alias("agreement")))
    reliability = [worth(F.col(f"a{k}"), F.col(f"A{k}_"), 1.0) - worth(F.col(f"b{k}"), F.col("d") - F.col(f"A{k}_"), 0.0) for k in n]
    annotators = totals.select("judge_id", F.col("d").cast("long").alias("n_votes"), F.array(*reliability).alias("reliability")).join(_accuracy(edges, items), "judge_id", "left")
    return Consensus(items, annotators, sweeps, s["change"] or 0.0)


def _argmax(scores: list[Column], classes: tuple[str, ...]) -> Column:
    top = F.greatest(*scores)
    return reduce(lambda acc, k: F.when(scores[k] == top, F.lit(classes[k])).otherwise(acc), reversed(range(len(classes))), F.lit(None).cast("string"))


def consensus(results: DataFrame, classes: tuple[str, ...] = ("REAL", "FAKE", "UNCERTAIN"), **kw) -> Consensus:
    """``message_passing`` for judge results; an item without any usable answer is UNCERTAIN with 0 votes and null agreement."""
    found = message_passing(votes(results, classes), classes, **kw)
    every = results.where(F.col("receipt_id").isNotNull()).select("receipt_id").distinct()
    items = every.join(found.items, "receipt_id", "left")
    return found._replace(items=items.withColumns({"label": F.coalesce("label", F.lit("UNCERTAIN")), "n_votes": F.coalesce("n_votes", F.lit(0))}))
