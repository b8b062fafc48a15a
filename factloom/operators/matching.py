"""What a claim that leads nowhere may mean now: the most similar of what has been added.

Claims are the query set; they come to the tasks in blocks of ``BLOCK`` rows, and every task reads its share of the added rows once. What a
pair can reach at most, from its lengths and then from its counts of characters, decides whether it is compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Claims that one pass over the added rows serves.
BLOCK = 2048
#: What the same module and the same kind add to the ratio, and what a match needs.
SAME_MODULE, SAME_KIND, LEAST = 1.0, 0.25, 0.75
#: Classes that characters are counted in; two in one class only raise what a pair can reach.
CLASSES = 64


def _counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le"), "<u4") % CLASSES
    cell = np.repeat(np.arange(len(names)), lengths) * CLASSES + codes
    return lengths, np.bincount(cell, minlength=len(names) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def best_in(claim: tuple[str, str, str], names: list[str], modules: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, counts: np.ndarray, best: tuple) -> tuple:
    """The largest (score, module, name) of these rows and ``best``; claim: name, module, kind. Equal scores are all compared."""
    name, module, kind = claim
    extra = (modules == module) * SAME_MODULE + (kinds == kind) * SAME_KIND
    both = np.maximum(lengths + len(name), 1)
    by_length = np.where(lengths + len(name) == 0, 1.0, 2.0 * np.minimum(lengths, len(name)) / both) + extra
    least = max(LEAST, best[0]) - 1e-9  # bounds are rounded otherwise than ratios
    near = np.flatnonzero(by_length >= least)
    if not len(near):
        return best
    _, own = _counts([name])
    shared = np.minimum(counts[near], own[0]).sum(axis=1)
    bound = np.where(lengths[near] + len(name) == 0, 1.0, 2.0 * shared / both[near]) + extra[near]
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < max(LEAST, best[0]) - 1e-9:
            break
        at = near[i]
        best = max(best, (SequenceMatcher(None, name, names[at]).ratio() + extra[at], modules[at], names[at]))
    return best


def similar_symbols(claims: DataFrame, added: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, module, name, score of the most similar added symbol of each claim, if it scores 0.75 or more.

    claims: id, name, module, kind; added: module, name, kind. The score is the ratio of matching characters, 1 more in the same module
    and 0.25 more of the same kind; of equal scores the greatest module and name win. Null names are left out.
    """
    spark = claims.sparkSession
    rows = claims.where("id is not null and name is not null").select("id", "name", "module", "kind").distinct().toLocalIterator()
    there = added.where("name is not null").select("module", "name", "kind").distinct()
    key = claims.schema["id"].dataType
    out = spark.createDataFrame([], "module string, name string, score double").select(F.lit(None).cast(key).alias("id"), "module", "name", "score")
    while asked := [(r["id"], (r["name"], r["module"], r["kind"])) for r in islice(rows, block)]:

        def run(batches: Iterator[pd.DataFrame], asked: list = asked) -> Iterator[pd.DataFrame]:
            best = [(0.0, "", "")] * len(asked)
            for batch in batches:
                names = batch["name"].tolist()
                modules, kinds = batch["module"].fillna("").to_numpy(object), batch["kind"].fillna("").to_numpy(object)
                lengths, counts = _counts(names)
                best = [best_in(claim, names, modules, kinds, lengths, counts, b) for (_, claim), b in zip(asked, best, strict=True)]
            found = [(i, m, n, s) for (i, _), (s, m, n) in zip(asked, best, strict=True) if s >= LEAST]
            yield pd.DataFrame(found, columns=["id", "module", "name", "score"])

        out = out.unionByName(there.mapInPandas(run, f"id {key.simpleString()}, module string, name string, score double"))
    top = out.groupBy("id").agg(F.max(F.struct("score", "module", "name")).alias("best"))
    return top.select("id", "best.module", "best.name", "best.score")


CALL = tuple(f"{e}_{c}" for e in ("caller", "callee") for c in ("path", "class", "symbol"))


def similar_calls(claims: DataFrame, added: DataFrame) -> DataFrame:
    """id, score and the six parts of the added call that shares most with each claim (id and the six parts).

    The same caller and the same callee count 2 each, a path in the same place 1; of equal scores the greatest call wins. The greatest
    call of each caller, callee and path is found first, so no claim meets more than five rows however many calls share its path.
    """
    calls = added.select(*CALL).distinct().select(F.struct(*CALL).alias("call"))
    same = {
        "both": (5, CALL),
        "caller": (3, CALL[:3]),
        "callee": (3, CALL[3:]),
        "caller's path": (1, CALL[:1]),
        "callee's path": (1, CALL[3:4]),
    }
    asked = claims.select("id", *CALL).distinct()
    parts = []
    for score, keys in same.values():
        top = calls.groupBy(*[F.col(f"call.{k}").alias(f"of_{k}") for k in keys]).agg(F.max("call").alias("call"))
        on = [asked[k] == top[f"of_{k}"] for k in keys]
        parts.append(asked.join(top, on).select("id", F.lit(score).alias("score"), "call"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.max(F.struct("score", "call")).alias("best")).select("id", "best.score", "best.call.*")
