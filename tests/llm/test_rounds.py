"""Rounds that join groups of near copies are few, and so are those of connected components."""

from __future__ import annotations

import random

import numpy as np

from plumbline.llm import pairs, tables


def test_stars_take_one_round(spark, monkeypatch):
    made, write = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df: made.append(1) or write(df))
    got = tables.components(spark.createDataFrame([(1, b) for b in range(2, 40)] + [(50, 51)], "a long, b long")).collect()
    assert {r.vertex: r.component for r in got} == {v: 1 for v in range(1, 40)} | {50: 50, 51: 50}
    assert len(made) == 2  # the links, and one round


def test_components_of_any_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(a, b) for a in range(5) for b in range(10, 13)] + [(7, 7)]
    shuffled = random.Random(5).sample(links, len(links))
    got = {r.vertex: r.component for r in tables.components(spark.createDataFrame(shuffled, "a long, b long")).collect()}
    assert got == {v: 100 for v in range(100, 161)} | {v: 0 for v in (0, 1, 2, 3, 4, 10, 11, 12)}


def test_hubs_reach_every_other_component_once():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 60, 200).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[: 200 - d], rng.integers(0, 1 << 60, d).astype(np.uint64)])) for b in base for d in (0, 1, 2, 3)]
    bits = np.array([pairs.bitmap(s) for s in sets]).view(np.uint64)
    rows = pairs.Classes(np.array([0, 1, 2, 2, 3, 4, 5, 6, 7, 7, 7, 7]), np.array([len(s) for s in sets]), bits)
    got = [(int(a), int(b)) for i, j in pairs.near_hubs(rows, 90) for a, b in zip(i, j)]
    # Of two candidates of a component the closer one, and none within the hub's own component or of another text.
    assert sorted(got) == [(0, 1), (0, 2), (4, 5), (4, 6), (4, 7)]
