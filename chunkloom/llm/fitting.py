"""Fitting the passage model on all judged documents, however many there are.

The features of the judged documents lie in blocks. Every step of the fit is a function
of some blocks and the models so far: it gives sums over the blocks, or writes new
arrays beside them. So the same steps run over blocks in memory (``Here``) and, where
there are too many for one task, as jobs over files in the shared folder (``Spread``);
a task then holds one block at a time, and the driver the models only.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from chunkloom.session import shared_dir
from chunkloom.sources.streams import open_place

#: Pull of a weight towards the seed's.
SHRINK = 0.3
#: Folds of the judged documents; log odds of the other folds' model from which an abusive, up to which a clean judgement is believed, and what is added where several agree.
FOLDS, BELIEVE_ABUSIVE, BELIEVE_CLEAN, AGREED = 3, -2.0, 2.5, 2.0
#: Share of the agreed abusive judgements that single ones may score below.
DOUBTED = 0.02
#: Tasks whose sums the driver adds up itself; those of more are first added up by other tasks.
ADDED_BY_DRIVER = 16
#: Bytes of files that a Python worker keeps between tasks.
KEPT_BYTES = 64 << 20

Arrays = dict[str, np.ndarray]
#: (weights, bias)
Model = tuple[np.ndarray, float]


class Memory:
    """Arrays by name, in memory."""

    index = np.int64

    def __init__(self):
        self.held: dict[str, Arrays] = {}

    def put(self, folder: str, arrays: Arrays) -> str:
        name = f"{folder}/{uuid.uuid4().hex}"
        self.held[name] = arrays
        return name

    def get(self, name: str) -> Arrays:
        return self.held[name]

    def done(self, name: str) -> None:
        del self.held[name]


class Files:
    """Arrays in files; each attempt of a task writes files of its own name."""

    index = np.int32

    kept: dict[str, tuple[int, Arrays]] = {}

    def put(self, folder: str, arrays: object) -> str:
        name = f"{folder}/{uuid.uuid4().hex}"
        system, path = open_place(name)
        with system.open_output_stream(path) as out:
            out.write(pickle.dumps(arrays, 5))
        return name

    def read(self, name: str) -> bytes:
        system, path = open_place(name)
        with system.open_input_stream(path) as source:
            return source.read()

    def get(self, name: str) -> Arrays:
        """Files never change, so the last ones are kept, up to ``KEPT_BYTES``."""
        if name in self.kept:
            return self.kept[name][1]
        data = self.read(name)
        arrays = pickle.loads(data)
        while self.kept and sum(n for n, _ in self.kept.values()) + len(data) > KEPT_BYTES:
            del self.kept[next(iter(self.kept))]
        if len(data) <= KEPT_BYTES:
            self.kept[name] = len(data), arrays
        return arrays

    def done(self, name: str) -> None:
        """Stays until its folder is dropped: the task may be run again."""


class Here:
    """Runs the steps in this process."""

    def __init__(self, store: Memory):
        self.store = store

    def folder(self) -> str:
        return uuid.uuid4().hex

    def drop(self, folder: str) -> None:
        self.store.held = {k: v for k, v in self.store.held.items() if not k.startswith(folder)}

    def each(self, step: Callable, items: list, shared: object) -> list:
        return [step(self.store, item, shared) for item in items]

    def total(self, step: Callable, items: list, shared: object) -> tuple:
        return _summed(step, self.store, items, shared)


class Spread:
    """Runs the steps as Spark jobs over files that all executors reach."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sc = spark, spark.sparkContext
        self.home = self.folder()

    def folder(self) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(shared_dir(self.spark, "fit"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _parts(self, run: Callable, items: list, shared: object):
        """(file of what all tasks get, one result of ``run`` for each part of the items)."""
        name = Files().put(self.home, shared)
        rdd = self.sc.parallelize(items, max(1, min(len(items), self.sc.defaultParallelism)))
        return name, rdd.mapPartitions(lambda own: [run(own, pickle.loads(Files().read(name)))])

    def each(self, step: Callable, items: list, shared: object) -> list:
        name, parts = self._parts(lambda own, told: [step(Files(), item, told) for item in own], items, shared)
        out = [x for part in parts.collect() for x in part]
        self._remove(name)
        return out

    def total(self, step: Callable, items: list, shared: object) -> tuple:
        name, parts = self._parts(lambda own, told: _summed(step, Files(), own, told), items, shared)
        if parts.getNumPartitions() > ADDED_BY_DRIVER:
            out = parts.treeReduce(_added)
        else:
            out = None
            for part in parts.collect():
                out = _added(out, part)
        self._remove(name)
        return out

    def _remove(self, name: str) -> None:
        system, path = open_place(name)
        system.delete_file(path)


def _added(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _summed(step: Callable, store: Memory | Files, items: list, shared: object) -> tuple:
    out = None
    for item in items:
        out = _added(out, step(store, item, shared))
    return out


def block(slots: np.ndarray, where: np.ndarray, owner: np.ndarray, fold: np.ndarray, share: np.ndarray, votes: np.ndarray) -> Arrays:
    """One block: features (slot, passage), the document of each passage, and each document's fold and judgements."""
    return {
        "slots": slots.astype(np.int32), "where": where.astype(np.int32), "owner": owner.astype(np.int32), "fold": fold.astype(np.int8),
        "bad": share > 0.5, "sure": np.abs(share - 0.5) > 0.1, "agreed": (votes >= 2) & ((share == 0) | (share == 1)), "votes": np.minimum(votes, 3.0),
    }


def _worst(b: Arrays, models: list[Model]) -> np.ndarray:
    """The highest passage score of each document under the model that hasn't seen its fold."""
    at = b["fold"].astype(np.int64)[b["owner"]]
    weights = np.stack([w for w, _ in models])
    score = np.bincount(b["where"], weights[at[b["where"]], b["slots"]], len(at)) + np.array([bias for _, bias in models])[at]
    out = np.full(len(b["fold"]), -np.inf)
    np.maximum.at(out, b["owner"], score)
    return out


# The steps. An item is a tuple of names: the block, then what earlier steps wrote about it.


def _judgements(store, item, _):
    """Documents with a clear judgement, and those of them judged abusive."""
    b = store.get(item[0])
    return int(b["sure"].sum()), int((b["sure"] & b["bad"]).sum())


def _agreed_scores(store, item, models):
    b = store.get(item[0])
    worst = _worst(b, models)
    return worst[b["agreed"] & b["bad"] & np.isfinite(worst)]


def _without_fold(store, item, folder):
    """Model k is fitted on all folds but k."""
    b = store.get(item[0])
    used = np.stack([b["sure"] & (b["fold"] != k) for k in range(FOLDS)])
    return item[0], store.put(folder, {"used": used, "clean": np.zeros((FOLDS, len(b["owner"])), bool)})


def _believed(store, item, shared):
    """One model, fitted on the judgements that the models of the other folds don't clearly contradict."""
    folder, models, least = shared
    b = store.get(item[0])
    worst, margin = _worst(b, models), np.where(b["agreed"], AGREED, 0.0)
    believed = np.where(b["bad"], worst > least - margin, worst < BELIEVE_CLEAN + margin)
    return item[0], store.put(folder, {"used": (b["sure"] & believed)[None], "clean": np.zeros((1, len(b["owner"])), bool)})


def _document_counts(store, item, n_slots):
    """Of each model: abusive and clean documents that have each feature, and all of them."""
    b, used = store.get(item[0]), store.get(item[1])["used"]
    pairs = np.unique(b["owner"].astype(np.int64)[b["where"]] * n_slots + b["slots"])
    doc, slot = pairs // n_slots, pairs % n_slots
    counts = [np.stack([np.bincount(slot[docs[doc]], minlength=n_slots) for docs in used & kind]) for kind in (b["bad"], ~b["bad"])]
    return *counts, (used & b["bad"]).sum(1), (used & ~b["bad"]).sum(1)


def _choose(store, item, shared):
    """Writes the examples of each model; gives the block's names and how many there are."""
    folder, turn, models = shared
    b, state = store.get(item[0]), store.get(item[1])
    slots, where, owner, bad, n = b["slots"], b["where"], b["owner"], b["bad"], len(b["owner"])
    arrays, counts, cleans = {}, [], []
    for k, (weights, bias) in enumerate(models):
        used = state["used"][k][owner]
        score = np.bincount(where, weights[slots], n) + bias
        order = np.lexsort((-score, owner))
        rank = np.empty(n, np.int64)
        starts = np.r_[0, np.flatnonzero(np.diff(owner[order])) + 1] if n else np.zeros(0, np.int64)
        rank[order] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        # clean examples stay once they were among the worst, else the next model forgets them
        clean = state["clean"][k] | (used & ~bad[owner] & (rank < 3))
        chosen = clean | (used & bad[owner] & (rank < 1))
        if turn >= 2:  # no passage like those of other abusive documents: taken for a slip of the judgement
            chosen &= ~bad[owner] | (score > -1.5)
        keep = chosen[where]
        ids, s = np.unique(slots[keep], return_inverse=True)
        arrays |= {f"ids{k}": ids, f"s{k}": s.astype(np.int32), f"p{k}": (np.cumsum(chosen) - 1)[where[keep]].astype(np.int32)}
        arrays |= {f"y{k}": bad[owner[chosen]].astype(float), f"weight{k}": b["votes"][owner[chosen]]}
        counts.append(int(chosen.sum()))
        cleans.append(clean)
    return (item[0], store.put(folder, {"used": state["used"], "clean": np.stack(cleans)}), store.put(folder, arrays)), counts


def _present(store, item, n_slots):
    """Of each model: which features its examples have."""
    examples = store.get(item[2])
    out = [np.zeros(n_slots, bool) for k in range(len(examples) // 5)]
    for k, own in enumerate(out):
        own[examples[f"ids{k}"]] = True
    return tuple(out)


def _numbered(store, item, shared):
    """Writes the examples with their features numbered among those of all examples."""
    folder, present = shared
    examples, out = store.get(item[2]), {}
    for k, own in enumerate(present):
        out |= {f"s{k}": np.searchsorted(own, examples[f"ids{k}"])[examples[f"s{k}"]].astype(store.index), f"p{k}": examples[f"p{k}"].astype(store.index)}
        out |= {c: examples[c] for c in (f"y{k}", f"weight{k}")}
    store.done(item[2])
    return item[0], item[1], store.put(folder, out)


def _gradient(store, item, models):
    """Sums of the gradients of the examples' log loss, of each model, then of the biases."""
    examples = store.get(item[2])
    out, out_bias = [], np.zeros(len(models))
    for k, (weights, bias) in enumerate(models):
        s, p, y = (examples[f"{c}{k}"] for c in ("s", "p", "y"))
        z = np.bincount(p, weights[s], len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * examples[f"weight{k}"]
        out.append(np.bincount(s, g[p], len(weights)).astype(float))
        out_bias[k] = g.sum()
    return *out, out_bias


def _learn(work: Here | Spread, items: list[tuple], seed: Model, rounds: int, steps: int) -> list[Model]:
    """Multiple-instance learning of all models of ``used`` side by side: each round takes
    the worst passages of every document under the last model; the worst one of an
    abusive document is an abusive example, the three worst of a clean one are clean
    examples. Weights stay near the seed's."""
    with_bad, with_good, n_bad, n_good = work.total(_document_counts, items, len(seed[0]))
    models = []
    for a, c, n, m in zip(with_bad, with_good, n_bad, n_good, strict=True):
        lift = np.log((a + 0.5) / (n + 1)) - np.log((c + 0.5) / (m + 1))
        start = np.where(a + c >= 3, np.clip(lift, -1.0, 3.0) * (np.abs(lift) > 0.7), 0.0) * 0.5
        models.append((seed[0] * 0.5 + start, -2.0) if n and m else seed)
    open_ones = {k for k in range(len(models)) if n_bad[k] and n_good[k]}
    old = None
    for turn in range(rounds):
        folder = work.folder()
        got = work.each(_choose, items, (folder, turn, models))
        items, counts = [names for names, _ in got], np.sum([n for _, n in got], 0)
        if old:
            work.drop(old)
        old = folder
        open_ones &= set(np.flatnonzero(counts).tolist())
        if not open_ones:
            break
        present = [np.flatnonzero(own) for own in work.total(_present, items, len(seed[0]))]
        items = work.each(_numbered, items, (folder, present))
        first = [seed[0][own] for own in present]
        w, b = [own.copy() for own in first], np.full(len(models), seed[1])
        g2, gb2 = [np.full(len(own), 1e-2) for own in first], np.full(len(models), 1e-2)
        for _ in range(steps):
            *gw, gb = work.total(_gradient, items, list(zip(w, b.tolist(), strict=True)))
            for k, own in enumerate(gw):
                own = own + SHRINK * (w[k] - first[k])
                g2[k] += own**2
                w[k] -= 0.5 * own / np.sqrt(g2[k])
            gb2 += gb**2
            b -= 0.5 * gb / np.sqrt(gb2)
        for k in open_ones:
            weights = seed[0].copy()
            weights[present[k]] = w[k]
            models[k] = weights, float(b[k])
    if old:
        work.drop(old)
    return models


def fit_blocks(work: Here | Spread, blocks: list[str], seed: Model, rounds: int = 5, steps: int = 60) -> Model:
    """A model from all judged documents of the blocks.

    Annotators slip, and a model that has seen a slip learns it by heart. So each
    document is first scored by a model of the other folds; judgements that it clearly
    contradicts are left out of the last fit.
    """
    items = [(b,) for b in blocks]
    sure, bad = work.total(_judgements, items, None) if items else (0, 0)
    if bad == 0 or bad == sure:
        return seed
    folder = work.folder()
    others = _learn(work, work.each(_without_fold, items, folder), seed, rounds, steps)
    # how low the other folds' models go where several annotators agree: with few judgements they know less
    known = np.concatenate(work.each(_agreed_scores, items, others))
    least = min(BELIEVE_ABUSIVE, float(np.quantile(known, DOUBTED))) if len(known) else -math.inf
    work.drop(folder)
    folder = work.folder()
    model = _learn(work, work.each(_believed, items, (folder, others, least)), seed, rounds, steps)[0]
    work.drop(folder)
    return model
