"""Trees of a Spark ML ensemble as plain paths, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np

#: (feature, True for "<=" and False for ">", threshold)
Condition = tuple[int, bool, float]

_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(model) -> list[list[tuple[tuple[Condition, ...], float]]]:
    """For each tree, its leaves as (conditions from the root, prediction)."""
    trees: list[list[tuple[tuple[Condition, ...], float]]] = []
    stack: list[tuple[int, Condition]] = []
    for line in model.toDebugString.splitlines():
        text, depth = line.strip(), len(line) - len(line.lstrip())
        if text.startswith("Tree "):
            trees.append([])
            stack = []
        elif m := _TEST.match(text):
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(m[2]), m[3] == "<=", float(m[4]))))
        elif text.startswith("Predict:"):
            while stack and stack[-1][0] >= depth:
                stack.pop()
            trees[-1].append((tuple(c for _, c in stack), float(text.split(":")[1])))
    return trees


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for feature, below, at in conditions:
        ok &= x[:, feature] <= at if below else x[:, feature] > at
    return ok


def vote(trees: list[list[tuple[tuple[Condition, ...], float]]], x: np.ndarray) -> np.ndarray:
    """Share of the trees that predict 1 for each row."""
    votes = np.zeros(len(x))
    for leaves in trees:
        for conditions, prediction in leaves:
            if prediction:
                votes += holds(x, conditions)
    return votes / max(1, len(trees))
