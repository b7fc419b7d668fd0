"""Filter audit, whitening and SimHash against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from finlake.llm import filter_audit, simhash, whitening
from finlake.llm.queries import ORACLE, QUERIES
from tests.oracle import SF_DIR, compare

NAN, INF = float("nan"), float("inf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, first string, n string"


def fails(rows):
    """The letters that each row fails."""
    firsts = {}
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        yield "".join(letter for letter, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)),
            i is not None and text in firsts and i > firsts[text])) if bad)


def audited(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for row, failed in zip(rows, fails(rows)):
        parts[row[2] or ""].append((row[0], failed))
    out = {}
    for part, docs in parts.items():
        removals = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removals[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == f for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
        for key, values in out.items():
            if key[0] == part:
                values[6] = removals[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, monkeypatch):
    rng = random.Random(3)
    long = lambda words, n: " ".join(rng.choices(words, k=n))
    words = [f"wort{i}" for i in range(300)] + ["LAUT", "é€😀", "#tag", "50%"]
    rows = [(i, long(words[:rng.choice([20, 200, 304])], rng.choice([3, 49, 50, 80])), rng.choice(["x", "y", None, ""])) for i in range(120)]
    rows += [(200 + i, rows[5][1], "x") for i in range(40)] + [(3, rows[5][1], "y"), (3, rows[5][1], "y"), (None, rows[5][1], "y")]
    rows += [(None, None, None), (None, "nur hier", "z"), (400, "", "z"), (401, None, "z"), (402, "Wort " * 60_000, "z"), (402, "Wort " * 60_000, "z"),
             (403, " \t\v\n", "w"), (404, "a b " * 60, "w"), (405, "A" * 5 + "b" * 95, "w"), (406, "A" * 6 + "b" * 94, "w")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumnRenamed("doc_id", "doc_id")
    got = filter_audit.audit(docs.repartition(5), marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == audited(rows, labels)
    assert len(got) == 600 * 5
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    none = filter_audit.audit(docs, marks.limit(0)).agg({"good_lost": "max", "kept": "max"}).first()
    assert none["max(good_lost)"] == 0 and none["max(kept)"] > 0


def test_contraction_is_a_sum_of_cells():
    t = np.random.default_rng(1).integers(0, 9, (2, 3, 2, 2, 2, 2, 2))
    sums = filter_audit.contract(t).reshape(2, 3, 3, 3, 3, 3, 3)
    assert (sums[..., 0, 2, 1, 2, 2] == t[..., 0, :, 1, :, :].sum(axis=(-1, -2, -3))).all()


def test_audit_query(spark, con):
    assert compare(QUERIES["op11_filter_audit"](spark, SF_DIR), con, ORACLE["op11_filter_audit"]) is None


def whitened(vectors, k):
    """Rows of exact figures, in the order of ``vectors``."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return [int((a * a).sum()) for a in away], centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("block", [7, 4096])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(whitening, "BLOCKS_PER_SPLIT", 2)
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(0, 0.3, 10) * np.arange(1, 11)]) for i in range(90)]
    good += [(200 + i, good[7][1]) for i in range(50)] + [(3, good[8][1]), (None, good[9][1])]
    bad = [(300, None), (301, [0.1, None] * 5), (302, [NAN] * 10), (303, [INF] * 10), (304, []), (305, [0.5, 0.5]), (306, [-INF] + [0.0] * 9)]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, index string, centred int").repartition(6)
    got = whitening.whiten(df).collect()
    deviation, values, explained = whitened([v for _, v in good], 8)
    assert len(got) == 8 * len(good) and all(r.n == len(good) for r in got)
    ids = Counter((r.vec_id, int(r.deviation)) for r in got)
    assert ids == Counter({k: 8 * c for k, c in Counter(zip([i for i, _ in good], deviation)).items()})
    by = {(r.vec_id, r.component): r for r in got if r.vec_id is not None and r.vec_id != 3}
    for c in range(8):
        mine = np.array([by[i, c + 1].whitened for i, _ in good if i not in (3, None)])
        want = np.array([values[j, c] for j, (i, _) in enumerate(good) if i not in (3, None)])
        assert np.allclose(mine, want * np.sign(mine @ want), rtol=1e-9, atol=1e-9)
        assert all(abs(r.explained / explained[c] - 1) < 1e-9 for r in got if r.component == c + 1)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [NAN])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    # One direction with a variance: one component, large values kept exact.
    got = whitening.whiten(spark.createDataFrame([(i, [1e6 * i, 2.0, 2e6 * i]) for i in range(4)], schema)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)
    x = [[1024 * 10**6 * i, 1024 * 2 * 10**6 * i] for i in range(4)]
    assert {r.vec_id: int(r.deviation) for r in got} == {
        i: sum((4 * x[i][d] - sum(v[d] for v in x)) ** 2 for d in (0, 1)) for i in range(4)}


def test_whitening_query(spark, con):
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    deviation, values, explained = whitened([v for _, v in rows], 8)
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, SF_DIR).collect()}
    assert len(got) == 8 * len(rows)
    assert all(got[i, 1].deviation == d for (i, _), d in zip(rows, deviation))
    for c in range(8):
        mine = np.array([got[i, c + 1].whitened for i, _ in rows])
        assert np.allclose(mine, values[:, c] * np.sign(mine @ values[:, c]), atol=1e-7)


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items):
    """Smallest id reachable of each (id, fingerprint), by all pairs."""
    prints = sorted({p for _, p in items})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, p in items:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, f"{p:016x}", least.get(find(p))) for i, p in items)


def check_prints(spark, items):
    prints = sorted({p for _, p in items})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(7)
    found = [(np.int64(r.a).astype(np.uint64).item(), np.int64(r.b).astype(np.uint64).item()) for r in simhash.links(df, len(prints)).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in found)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        root[find(a)] = find(b)
    got = defaultdict(set)
    for p in prints:
        got[find(p)].add(p)
    want = defaultdict(set)
    for (i, p, c), _ in classes([(k, p) for k, p in enumerate(prints)]).items():
        want[c].add(int(p, 16))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    return len(found)


def test_balls_meet_at_every_distance(spark):
    rng = random.Random(8)
    prints = []
    for _ in range(150):
        p = rng.getrandbits(64)
        for d in range(1, 6):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints += [p, q]
            p = rng.choice([q, rng.getrandbits(64)])
    check_prints(spark, list(enumerate(prints)) + [(9000, 0), (9001, 2**64 - 1), (9002, 2**63)])


def test_star_links_grow_with_the_group(spark):
    """All fingerprints within two bits of one: 2,081 of them, whose pairs would be two million."""
    p = 0x0123456789ABCDEF
    ball = [p, *(p ^ 1 << a for a in range(64)), *(p ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(64), 2))]
    n = len(ball)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in ball], "fingerprint long")
    found = simhash.links(df, n).count()
    assert n - 1 <= found <= 66 * n


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=400)
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 60])))) for i in range(60)]
    for i in range(100, 180):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            copy[rng.randrange(400)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \v\f"), (None, None), (None, "ganz allein hier"), (503, "ABC Def é"), (503, "abc def\x1fé"), (7, "w1 " * 300_000),
             (504, "abc DEF é"), (504, "a b c d"), (505, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, first int").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == classes([(i, brute_print(t)) for i, t in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_query(spark, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op13_simhash"](spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == classes([(i, brute_print(t)) for i, t in rows])
