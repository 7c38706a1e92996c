import random

from harborline.llm import jaccard_join
from tests.llm.conftest import words


def brute(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() if (w := words(t))}
    links = [(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least, before = {i: i for i in texts}, None
    while least != before:
        before = dict(least)
        for a, b in links:
            least[a] = min(least[a], least[b])
    return least


def test_near_copies_meet_once_and_not_once_a_part(spark, prose, monkeypatch):
    """A group of copies of one text, some of them too far from all others: the pairs that leave the comparison follow
    the group's size. They were 2,921 of 90 documents, one for each part on which a node agrees with others."""
    base, r = prose(120, 77).split(), random.Random(3)
    texts = {}
    for i in range(90):
        w = list(base)
        for at in r.sample(range(len(w)), 2 if i % 2 else 5):
            w[at] = f"edit{i}x{at}"
        texts[i] = " ".join(w)
    made = spark.sparkContext.accumulator(0)
    compare = jaccard_join._compare

    def counted(nearest):
        def run(batches):
            for b in compare(nearest)(batches):
                made.add(len(b))
                yield b

        return run

    monkeypatch.setattr(jaccard_join, "_compare", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute(texts) and 1 < len(set(got.values())) < 90
    assert made.value <= 4 * len(texts)


def test_merged_regions_lose_no_meeting(spark):
    r = random.Random(5)
    regions = {k: r.sample(range(40), r.randint(2, 9)) for k in range(60)}
    rows = [(k, n, n // 4, len(v), min(x // 4 for x in v)) for k, v in regions.items() for n in v]
    out = jaccard_join._merged(spark.createDataFrame(rows, "region long, node long, label long, size long, low long")).collect()
    by = {}
    for x in out:
        by.setdefault(x["region"], set()).add((x["node"], x["label"], x["size"]))
    assert all(any({(n, n // 4) for n in v} <= {m[:2] for m in g} for g in by.values()) for v in regions.values())
    assert all({m[2] for m in g} == {len(g)} for g in by.values())
    assert sum(len(g) ** 2 for g in by.values()) <= sum(len(v) ** 2 for v in regions.values()) and len(by) < len(regions)
