"""Choosing a limited number of templates per identity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of coverage selection.
REACH, FLOOR, SMOOTH, BONUS, LIMIT = 0.25, 0.25, 0.20, 0.05, 0.275


def ranked(templates: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """First ``budget`` templates of each identity in an order."""
    r = F.row_number().over(Window.partitionBy("identity").orderBy(*order))
    return templates.withColumn("place", r).filter(F.col("place") <= budget).select("identity", "template", "place")


def first(templates: DataFrame, budget: int) -> DataFrame:
    return ranked(templates, [F.col("template")], budget)


def by_quality(templates: DataFrame, budget: int) -> DataFrame:
    return ranked(templates, [F.desc("quality"), F.col("template")], budget)


def random(templates: DataFrame, budget: int, seed: int) -> DataFrame:
    """Reproducible choice without replacement, by hash order."""
    return ranked(templates, [F.sha2(F.concat_ws("|", F.lit(seed), "identity", "template"), 256)], budget)


def distances(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return np.clip((1 - unit @ unit.T) / 2, 0, 1)


def greedy_order(quality: np.ndarray, budget: int, scores) -> list[int]:
    """Positions taken one after another: the first by quality, each further
    one by ``scores(taken)``, the worth of all positions now that ``taken`` is
    chosen.  Ties go to the higher quality, then to the first position."""
    closed, order = np.zeros(len(quality), bool), []
    worth = np.zeros(len(quality))
    while len(order) < min(budget, len(quality)):
        worth = np.where(closed, -np.inf, np.round(worth, 12))
        level = np.flatnonzero(worth == worth.max())
        order.append(int(level[quality[level].argmax()]))
        closed[order[-1]] = True
        worth = scores(order[-1])
    return order


def diverse_order(d: np.ndarray, quality: np.ndarray, budget: int) -> list[int]:
    """Farthest point first: worth is the distance to the nearest taken one."""
    near = np.full(len(quality), np.inf)
    return greedy_order(quality, budget, lambda taken: np.minimum(near, d[taken], out=near))


def middle_of_others(d: np.ndarray) -> np.ndarray:
    """Median of each row without its own place; 0 for a single row."""
    n = len(d)
    if n == 1:
        return np.zeros(1)
    ranks = np.sort(np.where(np.eye(n, dtype=bool), np.inf, d), axis=1)
    return (ranks[:, (n - 2) // 2] + ranks[:, (n - 1) // 2]) / 2


def coverage_order(d: np.ndarray, quality: np.ndarray, budget: int) -> list[int]:
    """Every template is a point to cover, weighted by quality, coherence with
    the rest and inverse density; worth is the weight newly covered, plus a
    bonus.  Taking one changes the worth only through the points it covers
    better than before, so only their rows are looked at again."""
    reach = np.clip(1 - d / REACH, 0, 1)
    coherent = np.clip(1 - middle_of_others(d) / (2 * LIMIT), FLOOR, 1)
    shares = coherent / (SMOOTH + reach.sum(axis=1))
    weight = quality * shares if (quality * shares).sum() > 0 else shares
    weight = weight / weight.sum()
    covered, worth = np.zeros(len(d)), weight @ reach + BONUS * quality * coherent

    def taken(at: int) -> np.ndarray:
        rows = np.flatnonzero(reach[at] > covered)
        new = reach[at, rows]
        open_before = np.maximum(reach[rows] - covered[rows, None], 0)
        covered[rows] = new
        np.subtract(worth, weight[rows] @ (open_before - np.maximum(reach[rows] - new[:, None], 0)), out=worth)
        return worth

    return greedy_order(quality, budget, taken)


def greedy(templates: DataFrame, budget: int, how: str) -> DataFrame:
    """Diverse or covering choice per identity; at most ``budget`` templates
    give all of them, in input order.  An identity's templates are compared
    with each other, so an identity is one unit of work."""
    order = {"diversity": diverse_order, "coverage": coverage_order}[how]
    kind = templates.schema["identity"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("template", kind="stable")
        if len(pdf) <= budget:
            picked = list(range(len(pdf)))
        else:
            picked = order(distances(np.stack(pdf["vector"].to_list()).astype(float)), pdf["quality"].to_numpy(float), budget)
        out = pdf.iloc[picked][["identity", "template"]].copy()
        out["place"] = np.arange(1, len(picked) + 1)
        return out

    return templates.select("identity", "template", "vector", "quality").groupBy("identity").applyInPandas(run, f"identity {kind}, template bigint, place int")
