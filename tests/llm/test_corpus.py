"""Language ID, line dedup, Jaccard join, mixing, toxicity and the pipeline on small corpora."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finlake.llm import jaccard, langid, lines, mixing, toxicity
from finlake.llm.components import components
from finlake.llm.queries import QUERIES
from tests.llm.test_texts import WORD, shingles
from tests.oracle import SF_DIR

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_id_held_out(spark, con):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF_DIR).collect()}
    truth = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert set(got) == set(truth) and all(r.held_out == (crc(i, 3) == 1) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert np.mean([got[i].rejected for i in held]) < 0.01


def test_language_id_edges(spark):
    rng = random.Random(1)
    vocab = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["zwart", "krom", "vlug", "hout"]}
    rows = [(i, " ".join(rng.choices(vocab[k], k=30)), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa", None, None), (901, "", "bb", "s", 0), (902, "12 -- 34!", "aa", "s", 0), (None, "lorem ipsum", None, "s", 0),
             (903, "щит меч копьё лук", "bb" * 0 or None, "s", 0), (904, "krom vlug " * 200_000, None, "s", 0), (904, "krom vlug", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA + "")
    model = langid.train(docs, ~langid.held_out())
    got = langid.predict(docs.withColumn("lang_pred", docs.lang), model).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == rows[i][2] for i in range(80) if crc(i, 3) == 1)
    assert [by[i][0].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(by[i][0].lang_rejected for i in (900, 901, 902, 903))
    assert [r.lang_pred for r in by[904]] == ["bb", "bb"] and by[None][0].lang_pred == "aa"
    assert langid.train(docs.where("lang = 'none'"), ~langid.held_out()) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_every_language_is_learned_whatever_the_order(spark):
    """More languages than were learned before, one id on most rows of one of them: all are known, and reruns agree."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{k:03}": ["".join(rng.choices(letters, k=6)) for _ in range(3)] for k in range(210)}
    rows = [(1000 * k + i, " ".join(rng.choices(words, k=12)), lang, "s", 0)
            for k, (lang, words) in enumerate(vocab.items()) for i in range(4)]
    rows += [(7, " ".join(rng.choices(vocab["l000"], k=12)), "l000", "s", 0) for _ in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    everything = docs.doc_id.isNotNull() | docs.doc_id.isNull()
    model = langid.train(docs.repartition(3), everything)
    again = langid.train(docs.orderBy("text"), everything)
    assert set(model.languages) == set(vocab) and (model.table == again.table).all()


def test_lines(spark):
    rows = [(i, f"own {i}\n menu \n\nmenu", "en", "hot", 0) for i in range(40)]
    rows += [(100 + i, "menu\nother", "en", None, 0) for i in range(8)]
    rows += [(200, None, "en", "hot", 0), (201, "", "en", "hot", 0), (None, "menu", "en", "hot", 0), (202, "x " * 100_000, "en", "hot", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "n_lines")
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, ratio=0.5).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[100].text == "" and got[100].n_dropped == 2
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "" and got[None].text == "menu"
    assert got[202].text == "x " * 100_000
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_the_ratio_decides_on_small_hosts(spark):
    """Hosts of 1 to 6 pages at the default ratio: repeated lines go, a line of one page stays."""
    rows = [(10 * n + i, f"menu\nbody {n} {i}", "en", f"h{n}", 0) for n in range(1, 7) for i in range(n)]
    rows += [(100, "pair\nalone", "en", "h4", 0), (101, "pair\nsingle\nsingle", "en", "h4", 0)]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10: "menu\nbody 1 0", 100: "alone", 101: "single\nsingle",
                   **{10 * n + i: f"body {n} {i}" for n in range(2, 7) for i in range(n)}}


def brute_components(rows, words, percent):
    sets = [(i, shingles(t or "", words)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for base in range(12):
        words = rng.choices(vocab, k=rng.randint(1, 60))
        if base % 3 == 0:
            words = words[:rng.randint(0, 10)] + passage + words[:rng.randint(0, 6)]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    rows += ["", None, " \n ", "one", "One", "one two three", rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # long prefixes that ask for several matches
        monkeypatch.setattr(jaccard, "VERIFY_COST", 10.0)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 70).collect()}
    assert got == brute_components(rows, 3, 70)


def test_jaccard_edges(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "a b c d e f"), (5, None), (5, None), (7, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (5, 0, 5), (5, 0, 5), (7, 2, 1)])
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_null_id_with_a_text_of_its_own(spark):
    rows = [(1, "a b c d e f"), (None, "p q r s t u v w"), (None, "p q r s t u v w"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == Counter([(1, 2, 1), (2, 2, 1), (None, 4, None), (None, 4, None)])


def test_prefixes_grow_with_cost():
    tokens = np.arange(100, dtype=np.uint64)
    rare, common = np.ones(100, dtype=np.int32), np.full(100, 50, dtype=np.int32)
    p, m = jaccard.prefix(tokens, rare, 0.0, 85)
    assert m == 1 and len(p) == 16
    q, m = jaccard.prefix(tokens, common, 0.0, 85)
    assert m > 1 and len(q) == 15 + m and p.tolist() == q[:16].tolist()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (70, 60), (60, 60), (50, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets():
    assert mixing.targets([10, 1000, 100, 0], [3, 1, 2, 3], 1.5 * 1110, 2) == pytest.approx([20, 1445, 200, 0])
    assert sum(mixing.targets([5, 5, 5], [3, 1, 2], 22.5, 2)) == pytest.approx(22.5)
    assert mixing.targets([], [], 0, 2) == []


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 400, 60).astype(float)
    p, hits = np.full(60, 0.3), np.zeros(60)
    for seed in range(400):
        q = mixing.flight(p, x, np.random.default_rng(seed))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and q @ x == pytest.approx(p @ x)
        hits += q
    assert np.abs(hits / 400 - 0.3).max() < 0.13
    same = mixing.flight(p, np.full(60, 7.0), rng)
    assert ((same > 0) & (same < 1)).sum() <= 1


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 80), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(1500)]
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "empty", 0), (7, "w w", "en", "b", 0), (None, "w", "en", "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "size")
    # Small blocks, so that sources take several rounds.
    out = mixing.mix(docs, block=64).collect()
    again = mixing.mix(docs.repartition(13), block=64).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(out, key=key) == sorted(again, key=key) and len(out) == len(rows)
    totals = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        t = totals[r.source]
        t[0] += r.size
        t[1] += r.taken
        t[2], t[3] = r.target, r.source_size
        assert r.taken <= 2 * r.size and r.size == len(WORD.findall(next((x[1] or "") for x in rows if x[0] == r.doc_id and len(WORD.findall(x[1] or "")) == r.size)))
    sizes = {s: t[0] for s, t in totals.items()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    for s, w in zip(names, want):
        assert totals[s][3] == sizes[s] and totals[s][2] == pytest.approx(w)
        assert abs(totals[s][1] - w) <= max(3, 0.005 * w)
    assert mixing.mix(docs.limit(0)).count() == 0


def heavy_tailed(seed=8):
    """A source of many blocks beside small ones, a null one too, whose few largest documents hold most words."""
    rng = random.Random(seed)
    rows = [(i, "hot", rng.randint(1, 80)) for i in range(1500)]
    return rows + [(2000 + 100 * k + i, s, int(4 * rng.paretovariate(0.8)) % 5000 + 1)
                   for k, s in enumerate(["a", "b", "c", None]) for i in range(60)]


def test_small_groups_land_whatever_the_others_need(spark):
    units = spark.createDataFrame([(s, i, n, 0.3) for i, s, n in heavy_tailed()], "group string, doc_id long, size long, p double")
    small = units.where("group is null or group != 'hot'")
    beside = sorted((r.doc_id, r.picked) for r in mixing.balanced_sample(units, block=64).collect() if r.group != "hot")
    alone = sorted((r.doc_id, r.picked) for r in mixing.balanced_sample(small, block=64).collect())
    assert beside == alone and len(alone) == 240


def test_mixing_with_one_hot_source(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, s, n in heavy_tailed()], "doc_id long, text string, source string")
    out = mixing.mix(docs, block=64).collect()
    assert len(out) == 1740 and all(r.copies in (0, 1, 2) for r in out)
    for s in ("hot", "a", "b", "c", None):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(3, 0.005 * mine[0].target)


def test_toxicity_held_out(spark, con):
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF_DIR).collect()}
    truth = dict(con.sql("SELECT doc_id, toxic FROM labels").fetchall())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(i, 5) == 0) for i, r in got.items())
    held = [i for i in truth if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    assert np.mean([got[i].predicted for i in held if truth[i] == 0]) < 0.03


def test_toxicity_edges(spark):
    rng = random.Random(5)
    clean, bad = [f"good{i}x" for i in range(60)], ["grobian", "schuftig", "lumpen"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choices(clean, k=40) + (rng.choices(bad, k=4) if toxic else []))))
        marks.append((i, int(toxic), "x"))
    rows += [(900, None), (901, ""), (902, "Grobian " * 100_000), (None, "good1x"), (902, "lumpen schuftig grobian")]
    marks += [(None, 1, ""), (3, None, ""), (5, 1, "")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    got = toxicity.predict(docs, model).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got if r.doc_id != 902}
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert score[900] == score[901] < 0.5 and all(r.score > 0.5 for r in got if r.doc_id == 902)
    assert toxicity.train(docs, labels.where("toxic = 0"), ~toxicity.held_out()) is None
    assert {r.score for r in toxicity.predict(docs, None).collect()} == {0.0}


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    votes = [np.where(rng.random(4000) < np.where(y, 0.3 + 0.05 * i, 0.01), 1, -1) for i in range(7)]
    weak = np.where(rng.random(4000) < np.where(y, 0.1, 0.05), 1, -1)
    v = np.stack([*votes, weak, weak, weak], axis=1).astype(np.int8)
    model = toxicity.fit_label_model(v, 0.2)
    found = model.rates[:7, 1, 2]
    assert np.abs(found - (0.3 + 0.05 * np.arange(7))).max() < 0.08 and model.rates[:7, 0, 2].max() < 0.05
    assert (model.shares[7:] < 0.5).all() and (model.shares[:7] > 0.7).all()
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.95


@pytest.fixture(scope="module")
def small_corpus(spark):
    rows = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(300).collect()]
    extra = [(10_000, None, "en", "src1", 0), (10_001, "12 34 !!", "en", None, 8), (10_002, rows[5].text + " tail", "en", "src2", 1)]
    return spark.createDataFrame([*map(tuple, rows), *extra], SCHEMA)


def test_pipeline_stages(spark, small_corpus):
    docs, kept = small_corpus, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        kept[name] = docs = spark.createDataFrame(after.collect(), after.schema)
    ids = lambda name: [r.doc_id for r in kept[name].collect()]
    known = set(ids("language_id"))
    assert not known & {10_000, 10_001} and len(known) >= 300
    assert set(ids("line_dedup")) == known
    cleaned = {r.doc_id: r.text for r in kept["line_dedup"].collect()}
    roots = brute_components(list(cleaned.items()), 5, 80)
    assert sorted(ids("jaccard_join")) == sorted(i for i, (_, r) in roots.items() if i == r)
    size = {r.doc_id: len(WORD.findall(r.text)) for r in kept["jaccard_join"].collect()}
    source = {r.doc_id: r.source for r in kept["jaccard_join"].collect()}
    names = sorted(set(source.values()))
    sums = [sum(size[i] for i in size if source[i] == s) for s in names]
    want = mixing.targets(sums, [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(sums), 2)
    taken = Counter(ids("source_mixing"))
    assert max(taken.values()) <= 2
    for s, w in zip(names, want):
        got = sum(n * size[i] for i, n in taken.items() if source[i] == s)
        assert abs(got - w) <= 0.1 * w + 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    first = {r.doc_id: r.doc_tokens for r in pieces}
    assert whole == Counter({i: n * first[i] for i, n in taken.items()})


def test_pipeline_tells_documents_by_id_and_text(spark, tmp_path):
    """Texts that share an id, or have none, are documents of their own; clashing extra columns do no harm."""
    rng = random.Random(4)
    words = [f"wort{i}" for i in range(3000)]
    text = lambda: " ".join(rng.choices(words, k=40))
    one, two = text(), text()
    rows = [(i, text(), "de", f"s{i % 3}", 0) for i in range(30)]
    rows += [(5, one, "de", "s1", 0), (3, two, "de", "s1", 0), (5, two, "de", "s2", 0), (None, text(), "de", "s1", 0), (None, text(), "de", "s1", 0),
             (6, one + " nachtrag", "de", None, 0), (8, one, "de", "s1", 0), (8, one, "de", "s1", 0), (40, "", "de", "s1", 0), (40, "", "de", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x")).withColumn("copies", F.lit(1))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter((i, t) for i, t, *_ in rows[:30]) + Counter([(5, one), (3, two), (40, "")] + [(i, t) for i, t, *_ in rows[33:35]])
    mixed = corpus_pipeline.mix_sources(spark, kept, SF_DIR)
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(taken) <= set(got) and max(taken.values()) <= 2
    assert any(i is None for i, _ in taken)
    labelled = corpus_pipeline.identify_language(spark, docs.unionByName(docs.select(*docs.columns)), SF_DIR)
    assert labelled.where("doc_id IS NULL").count() == 4


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
