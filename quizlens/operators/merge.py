"""Keyed tables as mergeable folds.

A mutable row (one per visit, one per order) is the fold of every message about
its key. Each output column follows one rule:

``first_row``   value carried by the earliest message, NULL included
``last_row``    value carried by the latest message, NULL included
``first_known`` earliest non-NULL value
``last_known``  latest non-NULL value
``highest`` / ``lowest`` / ``ever``  maximum, minimum, logical or

A rule becomes a *state column* that is merged with plain ``min`` or ``max``.
That makes a merge associative, order-free and idempotent: partial aggregation
before the shuffle, replays, incremental upserts and streaming aggregation all
give the same row.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    value: Column


class Fold:
    def __init__(self, key, order, **rules):
        self.key, self.order, self.rules = key, order, rules
        self._together = {
            kind: [n for n, r in rules.items() if r.kind == kind] for kind in ("first_row", "last_row")
        }

    def _moment(self):
        return [F.col(name).alias(f"o{i}") for i, name in enumerate(self.order)]

    def lift(self, messages: DataFrame) -> DataFrame:
        """One state row per message; no shuffle."""
        columns = []
        for kind, names in self._together.items():
            if names:
                fields = [self.rules[n].value.alias(n) for n in names]
                columns.append(F.struct(*self._moment(), *fields).alias(kind))
        for name, rule in self.rules.items():
            if rule.kind in ("first_known", "last_known"):
                pair = F.struct(*self._moment(), rule.value.alias("v"))
                columns.append(F.when(rule.value.isNotNull(), pair).alias(name))
            elif rule.kind in ("highest", "lowest", "ever"):
                columns.append(rule.value.alias(name))
        return messages.select(F.col(self.key), *columns)

    def merged(self):
        """The aggregate of each state column."""
        merged = []
        for kind, names in self._together.items():
            if names:
                merged.append((F.min if kind == "first_row" else F.max)(kind).alias(kind))
        for name, rule in self.rules.items():
            if rule.kind in ("first_known", "lowest"):
                merged.append(F.min(name).alias(name))
            elif rule.kind in ("last_known", "highest", "ever"):
                merged.append(F.max(name).alias(name))
        return merged

    def columns(self):
        """The table's columns out of the state columns, in rule order."""
        columns = []
        for name, rule in self.rules.items():
            if rule.kind in self._together:
                columns.append(F.col(rule.kind)[name].alias(name))
            elif rule.kind in ("first_known", "last_known"):
                columns.append(F.col(name)["v"].alias(name))
            else:
                columns.append(F.col(name))
        return columns

    def merge(self, states: DataFrame) -> DataFrame:
        """One state row per key."""
        return states.groupBy(self.key).agg(*self.merged())

    def finish(self, states: DataFrame, *carried) -> DataFrame:
        """State rows to table rows; ``carried`` are further columns to keep."""
        return states.select(self.key, *self.columns(), *carried)

    def fold(self, messages: DataFrame) -> DataFrame:
        return self.finish(self.merge(self.lift(messages)))

    def upsert(self, states: DataFrame, messages: DataFrame) -> DataFrame:
        """States after new messages. ``states`` may come from any earlier merge."""
        return self.merge(states.unionByName(self.lift(messages)))


class Joint:
    """Several folds of one key in one state row, each fed by messages of its own kind."""

    def __init__(self, *folds):
        self.folds, self.key = folds, folds[0].key

    def lift(self, *messages: DataFrame) -> DataFrame:
        """State rows of the messages of each fold, in the folds' order."""
        lifted = [fold.lift(rows) for fold, rows in zip(self.folds, messages, strict=True)]
        every = lifted[0]
        for rows in lifted[1:]:
            every = every.unionByName(rows, allowMissingColumns=True)
        return every

    def merge(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key).agg(*(c for fold in self.folds for c in fold.merged()))

    def finish(self, states: DataFrame, *carried) -> DataFrame:
        return states.select(self.key, *(c for fold in self.folds for c in fold.columns()), *carried)
