"""Jaccard join: crowded lists and the growth of its candidates."""

import random

import pytest

from finlake.llm import jaccard
from tests.llm.test_corpus import brute_components, corpus


def near_copies(n, seed=0, length=300, changes=(3, 7)):
    """Copies of one text with so many words changed that few of them link."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(20_000)]
    base = rng.choices(vocab, k=length)
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(*changes)):
            words[rng.randrange(length)] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    return out


def components_of(spark, rows, words=5, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words, percent).collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_crowded_lists_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_OUTSIDERS", 0)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 200)  # a leader's pairs go to several parts
    rows = corpus(seed)
    assert components_of(spark, rows, 3, 70) == brute_components(rows, 3, 70)


@pytest.mark.parametrize("words,percent", [(5, 80), (4, 85)])
def test_near_copies_equal_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_OUTSIDERS", 3)
    families = near_copies(50, 1, 120, (0, 5)) + [
        (1000 + i, t) for i, t in near_copies(30, 2, 120, (1, 3))]
    # Copies of copies share their changes, and lie far from the first text.
    rng = random.Random(3)
    for k in range(5):
        words_ = families[k][1].split()
        for j in range(8):
            copy = list(words_)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            families.append((2000 + 10 * k + j, " ".join(copy[:rng.choice([120, 120, 110])])))
    assert components_of(spark, families, words, percent) == brute_components(families, words, percent)


def test_candidates_grow_with_the_group(spark, monkeypatch):
    made = []
    whole = jaccard._paired

    def counted(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard, "_paired", counted)
    totals = []
    for n in (100, 200):
        made.clear()
        rows = near_copies(n)
        got = components_of(spark, rows)
        assert n == 200 or got == brute_components(rows, 5, 80)
        totals.append(sum(made))
    assert 100 <= totals[0] and totals[1] <= 2.5 * totals[0], totals


def shuffled_rows(plan):
    """Rows that all exchanges of an executed plan wrote."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_only_texts_of_pairs_are_shuffled(spark):
    rows = near_copies(400, 5, 60, (2, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    sets = {i: jaccard.shingle_sets([t], 3)[0] for i, t in rows}
    nodes = spark.createDataFrame([(jaccard.set_node(s), i, len(s)) for i, s in sets.items()], "node long, doc_id long, n long")
    wanted = [tuple(jaccard.set_node(sets[i]) for i in p) for p in ((1, 2), (3, 4), (5, 4))]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # Pairs of a large corpus are not broadcast.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = jaccard.verify(spark.createDataFrame(wanted, "a long, b long"), nodes, docs, 3, 1)
        assert sorted((r.a, r.b) for r in found.collect()) == sorted(wanted)
        assert shuffled_rows(found._jdf.queryExecution().executedPlan()) < 100
        # The asked ids are all there, whatever their type.
        texts = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text")
        kept = {r.doc_id for r in jaccard.asked_docs(texts, texts.where("doc_id < 300").select("doc_id")).collect()}
        assert {str(i) for i in range(300)} <= kept and len(kept) < 310
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
