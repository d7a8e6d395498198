"""Attributions of all training sets of repeated folds at once, from each probe's column and the sets' membership.

A probe's values are packed into one column of bytes, in sample order. A task gets the columns of the genes of one training set and the
repeat's folds, takes the set's members from the columns, and gets class AUC, linear Shapley values and permutation losses by sums along
rows. Nothing is sent to every task: what a task holds grows with one column times the genes of a set (what() tells how much), and what
is shuffled with the selected columns times the sets. Beyond MOST_BYTES the row-wise operators of attribution do the work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..functions.resampled import nullable

FOLD = ("repeat", "fold")
#: Most bytes of one training set's columns in a task; values that are looked at together.
MOST_BYTES, BLOCK = 1 << 30, 1 << 20
SHOWN = "repeat int, fold int, gene string, auc double, shap double, shap_signed double, raw double"


def what(n_samples: int, n_genes: int) -> int:
    """Bytes that a task holds: a set's columns as they come and scaled, and what belongs to a sample."""
    return n_samples * (24 * n_genes + 64)


def columns(values: DataFrame, state: DataFrame) -> DataFrame:
    """probe_id, x (values in sample order), ids (a digest of the samples) of the probes that the state selects."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, x = rows.column("sample_id").to_numpy(), rows.column("x").to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({"probe_id": pa.array([key[0].as_py()], pa.string()), "x": pa.array([x[order].tobytes()], pa.binary()), "ids": pa.array([hashlib.sha256(ids[order].tobytes()).digest()], pa.binary())})

    cells = values.join(state.select("probe_id").distinct(), "probe_id", "left_semi").select("probe_id", F.col("sample_id").cast("long").alias("sample_id"), F.col("x").cast("double").alias("x"))
    return cells.groupBy("probe_id").applyInArrow(pack, "probe_id string, x binary, ids binary")


def designs(folds: DataFrame) -> DataFrame:
    """repeat, samples, held, ys (ids, test folds and classes in sample order, as bytes): a row a repeat."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("sample_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        parts = {"samples": ids, "held": rows.column("fold").to_numpy(), "ys": rows.column("y").to_numpy()}
        return pa.table({"repeat": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([c[order].tobytes()], pa.binary()) for n, c in parts.items()}})

    kinds = {"repeat": "int", "sample_id": "long", "fold": "int", "y": "int"}
    return folds.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).groupBy("repeat").applyInArrow(pack, "repeat int, samples binary, held binary, ys binary")


def drawn_order(ids: list[bytes], *key: object) -> np.ndarray:
    """Places of the samples, whose ids rise, in the order of scalars.keyed(*key, id): a permutation as splits.permutations() draws it."""
    start = b":".join(str(k).encode() for k in key) + b":"
    digests = np.frombuffer(b"".join([hashlib.md5(start + i, usedforsecurity=False).digest() for i in ids]), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.argsort(digests[:, 0], kind="stable")
    first = digests[order, 0]
    return np.lexsort((digests[:, 1], digests[:, 0])) if (first[1:] == first[:-1]).any() else order


def _auc(x: np.ndarray, y: np.ndarray) -> float:
    one, zero = np.sort(x[y == 1]), x[y == 0]
    if not len(one) or not len(zero):
        return np.nan
    behind = np.searchsorted(one, zero, "left") + np.searchsorted(one, zero, "right")
    return (len(one) * len(zero) - behind.sum() / 2) / (len(one) * len(zero))


def _losses(f: np.ndarray, side: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Balanced Brier loss of rows of scores; ``side`` is -1 for class 1, whose error is the share of the other class."""
    p = 1 / (1 + np.exp(-side * f))
    return (p * p) @ weight


def fold_attributions(values: DataFrame, folds: DataFrame, state: DataFrame, moves: DataFrame | None = None, draws: tuple[int, int] | None = None) -> DataFrame:
    """repeat, fold, gene, auc, shap, shap_signed, raw of every training set and gene: class AUC of the training values, mean absolute and
    mean linear Shapley value, and the rise of the balanced Brier loss over ``moves`` (repeat, fold, r, sample_id, from_id), or over
    those that ``draws`` (number, seed) has splits.permutations() draw, made in the task (neither: null).

    auc is null where a class is missing. Every sample must be in every repeat, and every selected probe must have every sample once;
    else the job fails. Memory of a task: what()."""
    packed = kept(columns(values, state))
    w = (F.col("mean1") - F.col("mean0")) / F.col("scale")
    selected = state.select(*[F.col(c).cast("int").alias(c) for c in FOLD], "probe_id", "gene", "mean", "scale", w.alias("w")).join(packed, "probe_id")
    empty = {"samples": "binary", "held": "binary", "ys": "binary", "r": "int", "source": "array<long>"}
    told = lambda rows: rows.select(*FOLD, *[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    sets = state.select(*[F.col(c).cast("int").alias(c) for c in FOLD]).distinct()
    context = told(kept(designs(folds)).join(sets, "repeat"))
    if moves is not None:
        own = moves.groupBy(*FOLD, "r").agg(F.array_sort(F.collect_list(F.struct("sample_id", "from_id"))).alias("m"))
        context = context.unionByName(told(own.select(*[F.col(c).cast("int").alias(c) for c in (*FOLD, "r")], F.col("m.from_id").alias("source"))))

    def run(key: tuple, given: pa.Table, rows: pa.Table) -> pa.Table:
        fields = [pa.field(n, {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SHOWN.split(", "))]
        if not rows.num_rows:
            return pa.schema(fields).empty_table()
        repeat, fold = (k.as_py() for k in key)
        given = given.sort_by("r")
        design = [i for i, s in enumerate(given.column("samples")) if s.is_valid]
        if len(design) != 1:
            raise ValueError("a repeat has no folds")
        ids, held, ys = (np.frombuffer(given.column(c)[design[0]].as_buffer(), t) for c, t in (("samples", np.int64), ("held", np.int32), ("ys", np.int32)))
        digest = hashlib.sha256(ids.tobytes()).digest()
        if any(d.as_py() != digest for d in rows.column("ids")):
            raise ValueError("a probe or a repeat lacks samples, or has some twice")
        rows = rows.sort_by("gene")
        genes, mean, scale, w = rows.column("gene").to_pylist(), *(rows.column(c).to_numpy() for c in ("mean", "scale", "w"))
        member = held != fold
        ids, y, z, auc = ids[member], ys[member], np.empty((len(genes), int(member.sum()))), np.empty(len(genes))
        for k, x in enumerate(rows.column("x")):
            own = np.frombuffer(x.as_buffer())[member]
            auc[k] = _auc(own, y)
            z[k] = (own - mean[k]) / scale[k]
        n1, n0 = int((y == 1).sum()), int((y == 0).sum())
        many = max(1, BLOCK // max(1, len(y)))
        blocks = [slice(i, i + many) for i in range(0, len(genes), many)]
        shap, signed, raw = np.empty(len(genes)), np.empty(len(genes)), np.full(len(genes), np.nan)
        for b in blocks:
            phi = (z[b] - z[b].mean(1, keepdims=True)) * w[b, None]
            shap[b], signed[b] = np.abs(phi).mean(1), phi.mean(1)
        sources = [s.values.to_numpy() for s in given.column("source") if s.is_valid]
        orders = (np.searchsorted(ids, s) for s in sources)
        if draws is not None:
            names = [b"%d" % i for i in ids.tolist()]
            orders = (drawn_order(names, draws[1], repeat, fold, r) for r in range(draws[0]))
        if (sources or draws is not None) and n1 and n0:
            f = np.round(w @ z, 9)
            side, weight = np.where(y == 1, -1.0, 1.0), np.where(y == 1, 0.5 / n1, 0.5 / n0)
            total, n = np.zeros(len(genes)), 0
            start = float(_losses(f, side, weight))
            for at in orders:
                for b in blocks:
                    total[b] += _losses(f + (z[b][:, at] - z[b]) * w[b, None], side, weight) - start
                n += 1
            raw = total / n if n else raw
        return pa.Table.from_arrays([pa.array([repeat] * len(genes), pa.int32()), pa.array([fold] * len(genes), pa.int32()), pa.array(genes, pa.string()), *map(nullable, (auc, shap, signed, raw))], schema=pa.schema(fields))

    return context.groupBy(*FOLD).cogroup(selected.groupBy(*FOLD)).applyInArrow(run, SHOWN)
