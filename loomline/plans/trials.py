"""Trials of feature selectors: detectors of attacked rows are fitted on training rows and compared
on validation rows; the winner is locked and judged once on test rows.

Each split is attacked on its own, and passes through the transformation that was fitted on
the clean training rows. Trials share passes: one of counts and one of sums serve all selectors, and
the trees of all trials grow a level a pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ml import classify, histograms
from ..ml.tree_fitness import Tree
from ..operators import attack, locks, quality, selectors, split
from ..sources.writers import sums
from . import flows

SELECTORS = ("all", "variance", "correlation", "redundancy", "anova")
LABEL = "is_attack"


def stored_lines(lines: DataFrame) -> DataFrame:
    """What trials read of lines, written once: with split, order-level values, and ``first``, which tells one line of
    those that share an id in a split: the least by its columns in their order, as of ``flows.one_of_each``.

    Lines that share an id are found within their order, unless an id does not tell its order.
    """
    named = split.hash_split(lines, "order_id")
    order = Window.partitionBy("order_id")
    of_train = (F.col("split") == "train") & F.col("order_id").isNotNull()
    tells = (F.col("item_id") == F.col("order_id") * 8 + F.col("line_number")) & F.col("line_number").between(0, 7)

    def found(*key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in named.columns if c not in ("item_id", *key)]))
        rows = named.withColumns({
            "first": place == 1, "odd": ~F.coalesce(tells, F.lit(False)),
            "order_item_count": F.when(of_train, F.count("*").over(order)), "order_total_value": F.when(of_train, F.sum("total").over(order)),
        })
        fields = {f for s in attack.SCENARIOS.values() for f in s.fields}
        more = [c for c in ("quantity", "total", "product_price", "discount_rate", "days_scheduled", "unit_price", "order_ts", *flows.CATEGORIES) if c not in fields]
        return flows.written(rows.select("order_id", "item_id", "split", "late", "first", "odd", "order_item_count", "order_total_value", *sorted(fields), *more), "trial-lines")

    rows = found("order_id", "item_id")
    return found("split", "item_id") if rows.filter("odd").limit(1).count() else rows


def attacked_split(rows: DataFrame, prepared: flows.Prepared, name: str, cell: tuple[str, float, str], seed: int = 42) -> DataFrame:
    """(item_id, is_attack, prepared columns) of one split of stored lines under a scenario, a rate and a severity, written.

    Lines that share an id count once.
    """
    scenario, rate, severity = cell
    one = rows.filter((F.col("split") == name) & F.col("first"))
    moved = attack.attacked(one, "item_id", attack.SCENARIOS[scenario], severity, rate, seed, LABEL)
    return flows.expanded(flows.written(flows.compact(moved, prepared, LABEL), f"trial-{name}"), prepared, LABEL)


@dataclass(frozen=True)
class Detector:
    """A tree over the bins of some columns; ``edges`` are the thresholds between bins."""

    edges: tuple[np.ndarray, ...]
    tree: Tree

    def text(self) -> str:
        return str([[v.tolist() for v in self.edges], self.tree.column.tolist(), self.tree.bin.tolist(), self.tree.score.tolist()])


@dataclass
class Trial:
    """A selector's columns, the detector on them and its metrics on the validation rows."""

    selector: str
    columns: tuple[str, ...]
    model: PipelineModel | Detector
    metrics: dict
    tested: bool = False

    def parameters(self) -> dict:
        """What a lock fixes: the selector, its columns, and the trees or coefficients."""
        if isinstance(self.model, Detector):
            text = self.model.text()
        else:
            last = self.model.stages[-1]
            text = last.toDebugString.split("\n", 1)[-1] if hasattr(last, "toDebugString") else str((last.coefficients, last.intercept))
        return {"selector": self.selector, "columns": list(self.columns), "model": locks.digest({"text": text})}


def _metrics(rows: DataFrame, columns: Sequence[str], model: PipelineModel | Detector, name: str) -> dict:
    if isinstance(model, Detector):
        return histograms.measures(model.tree.score, histograms.leaf_counts(rows, columns, LABEL, model.edges, [model.tree])[0])
    found = flows.predicted(rows.select("item_id", LABEL, *columns), {name: model}, LABEL)
    return flows.measured(found, LABEL).first().asDict()


def validation_runs(train: DataFrame, validation: DataFrame, columns: Sequence[str], names: Sequence[str], k: int, flags: Sequence[str] = ()) -> list[Trial]:
    """Select and fit decision trees on training rows, measure on validation rows. ``all`` selects nothing away.
    ``flags`` are columns that are known to be 0 or 1."""
    quality.forbid_columns(train.select(*columns), (*flows.FORBIDDEN, LABEL))
    counts = histograms.value_counts(train.filter(F.col(LABEL).isNotNull()), columns, flags=flags)
    found = histograms.moments(train, columns, LABEL, counts, flags)
    pick = lambda name: tuple(columns) if name == "all" else selectors.create(name)(train, columns, LABEL, k, **({} if name == "mutual_information" else {"found": found})).columns
    chosen = [pick(name) for name in names]
    place, edges = {c: i for i, c in enumerate(columns)}, [histograms.cuts(c) for c in counts]
    # rows without a missing value in a trial's columns: trials on the same columns with holes have the same rows
    holes = {c for c in columns if found is None and train.filter(F.col(c).isNull()).limit(1).count()}
    trees: dict[int, Tree] = {}
    judged: dict[int, np.ndarray] = {}
    groups: dict[frozenset, list[int]] = {}
    for i, c in enumerate(chosen):
        groups.setdefault(frozenset(holes & set(c)), []).append(i)
    for odd, members in groups.items():
        use = [c for c in columns if c not in holes or c in odd]
        at, own = {c: i for i, c in enumerate(use)}, [edges[place[c]] for c in use]
        rows = histograms.packed(train, use, LABEL, own, lambda df: flows.written(df, "trial-bins"), flags)
        fitted = histograms.fit_trees(rows, len(use), [[at[c] for c in chosen[i]] for i in members])
        found_leaves = histograms.leaf_counts(validation, use, LABEL, own, fitted, flags)
        for i, tree, leaves in zip(members, fitted, found_leaves, strict=True):
            # the tree by places among the trial's own columns
            back = {at[c]: j for j, c in enumerate(chosen[i])}
            trees[i] = Tree(np.array([back.get(int(c), 0) for c in tree.column]), tree.bin, tree.score)
            judged[i] = leaves
    out = []
    for i, name in enumerate(names):
        model = Detector(tuple(edges[place[c]] for c in chosen[i]), trees[i])
        out.append(Trial(name, chosen[i], model, histograms.measures(trees[i].score, judged[i])))
    return out


def validation_run(train: DataFrame, validation: DataFrame, columns: Sequence[str], selector: str, k: int, kind: str = "decision_tree") -> Trial:
    """One trial; kinds besides decision trees are fitted by ``classify.train``."""
    if kind == "decision_tree":
        return validation_runs(train, validation, columns, [selector], k)[0]
    quality.forbid_columns(train.select(*columns), (*flows.FORBIDDEN, LABEL))
    chosen = tuple(columns) if selector == "all" else selectors.create(selector)(train, columns, LABEL, k).columns
    model = classify.train(train, chosen, LABEL, kind)
    return Trial(selector, chosen, model, _metrics(validation, chosen, model, selector))


def best(trials: Sequence[Trial]) -> Trial:
    """The largest f1, then recall, then the fewest columns, then the first."""
    return min(trials, key=lambda t: (-t.metrics["f1"], -t.metrics["recall"], len(t.columns)))


def locked(trial: Trial, frames: Mapping[str, DataFrame]) -> dict:
    """A lock over the trial and the frames that it was chosen with, these by the sums of their rows' hashes."""
    return locks.build("trial", frames, trial.parameters(), of=sums)


def locked_test(trial: Trial, lock: Mapping, frames: Mapping[str, DataFrame], test: DataFrame) -> dict:
    """The metrics on the test rows, once and without fitting. Fails if the lock, its frames or the
    trial changed, if a test row is among the frames' rows, or at a second time."""
    if trial.tested:
        raise locks.LockError("the test rows have been used")
    locks.verify(lock, frames, of=sums)
    if lock["parameters"] != trial.parameters():
        raise locks.LockError("the trial differs from its lock")
    for name, frame in frames.items():
        if test.join(frame.select("item_id"), "item_id", "left_semi").limit(1).count():
            raise locks.LockError(f"test rows are among the rows of {name}")
    trial.tested = True
    return _metrics(test, trial.columns, trial.model, trial.selector)


def run(lines: DataFrame, cell: tuple[str, float, str], names: Sequence[str] = SELECTORS, share: float = 0.5, seed: int = 42) -> DataFrame:
    """A row for each selector's validation run, and one for the winner's final test.

    Selectors that take a number keep ``share`` of the columns.
    """
    rows = stored_lines(lines)
    prepared = flows.fitted(rows)
    train, validation = (attacked_split(rows, prepared, s, cell, seed) for s in ("train", "validation"))
    k = max(1, round(len(prepared.columns) * share))
    trials = validation_runs(train, validation, prepared.columns, names, k, flows.flags(prepared))
    winner, frames = best(trials), {"train": train, "validation": validation}
    lock = locked(winner, frames)
    last = locked_test(winner, lock, frames, attacked_split(rows, prepared, "test", cell, seed))
    kept = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "average_precision", "roc_auc")
    out = [("validation", t.selector, len(t.columns), *(t.metrics[c] for c in kept)) for t in trials]
    out.append(("test", winner.selector, len(winner.columns), *(last[c] for c in kept)))
    kinds = "tp long, fp long, fn long, tn long, precision double, recall double, f1 double, average_precision double, roc_auc double"
    return lines.sparkSession.createDataFrame(out, f"phase string, selector string, n_columns int, {kinds}")
