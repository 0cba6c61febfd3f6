"""Candidate pairs of large groups of near copies."""

from __future__ import annotations

from plumbline.llm import jaccard_join


def far_hub_rows(copies):
    """Copies that differ in a word each, and an outlier of more ordinary words, which is the first hub of their lists and links to none."""
    base = [f"base{i}" for i in range(200)]
    usual = [f"usual{i}" for i in range(30)]
    rows = [(1, " ".join(base[:170] + usual))]
    rows += [(10 + i, " ".join([*base[:185], f"edit{i}", *base[186:]])) for i in range(copies)]
    return rows + [(1000 + i, " ".join([*usual * 4, *base[170:] * 2, *(f"fill{i}x{j}" for j in range(80))])) for i in range(40)]


def test_large_group_away_from_its_hub(spark, monkeypatch):
    pairs, whole = [], jaccard_join.compared

    def compared(*args):
        out = whole(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "compared", compared)
    copies = 60
    rows = jaccard_join.jaccard_components(spark.createDataFrame(far_hub_rows(copies), "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert got == {d: 10 if 10 <= d < 10 + copies else d for d in got}
    assert len(got) == copies + 41
    assert len(pairs) == 1 and pairs[0] <= 2 * copies  # 1,770 pairs link
