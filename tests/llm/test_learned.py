import numpy as np
import pytest
from pyspark.sql import functions as F

from motorcade.llm import ann, classifier, langid, mixing, toxicity
from motorcade.llm.common import id_crc

MIDDLE = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    g = toxicity.fit(docs, labels.where(id_crc("doc_id") % 3 != 1))
    got = toxicity.score(docs, g).join(labels, "doc_id").where(id_crc("doc_id") % 3 == 1).collect()
    hit = [r.score >= toxicity.REJECT_AT for r in got if r.toxic == 1]
    false = [r.score >= toxicity.REJECT_AT for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.7 and np.mean(false) < 0.03


def test_toxicity_grammar():
    g = toxicity.Grammar()
    a = g.compiled()
    plain, quoted, negated = (g.score(a, t) for t in ("you idiot", "he said idiot", "not an idiot"))
    assert plain > negated and plain > quoted and g.score(a, "idiotic news") < 0.1
    assert g.score(a, "I will kill you") > g.score(a, "kill the process") >= g.score(a, "")
    assert g.clause("i will kill you") == [["kill+", 1.0, False, False]]


def test_toxicity_table_is_the_composition():
    """The table's marks are those of each part run alone."""
    parts = [toxicity._near("neg", 2), toxicity._near("tgt", 1), toxicity._since("rep", 4), toxicity._meeting("thr", "tgt", 8)]
    rng = np.random.default_rng(0)
    state, alone = 0, [t.start for t in parts]
    for i in rng.integers(0, len(toxicity.TERMINALS), 3000):
        state, marks = toxicity.TABLE[state][i]
        steps = [t.step(s, toxicity.TERMINALS[i]) for t, s in zip(parts, alone, strict=True)]
        alone = [s for s, _ in steps]
        assert marks == sum(m for _, m in steps)


def test_toxicity_learns_clause_patterns(spark):
    """The same words throughout: only threats at a target, and insults neither negated nor reported, are toxic."""
    rng = np.random.default_rng(3)
    names = [f"{a}{b}" for a in "lorem ipsum dolor amet tempor magna".split() for b in "abcdefgh"]
    bad = ["i will kill you", "you idiot", "we hurt them", "you moron"]
    good = ["we kill processes", "you are not an idiot", "she said moron", "hurt feelings", "they never kill you", "nobody said idiot"]
    rows = [(i, " ".join(rng.choice(names, 6)) + ". " + (bad if i % 2 else good)[i // 2 % (4 if i % 2 else 6)] + ".", i % 2) for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    g = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id >= 120").select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id < 120"), g, keep=("toxic",)).collect()
    assert [r.doc_id for r in got if (r.score >= toxicity.REJECT_AT) != (r.kept.toxic == 1)] == []
    assert g.threats[toxicity.TARGET] > 3.0 > g.threats[0] and g.gains[toxicity.NEGATION] < toxicity.NEGATED


def test_toxicity_odd_rows(spark, odd, no_labels):
    g = toxicity.fit(odd, no_labels)
    got = toxicity.score(odd, g, keep=("score", "lang", "text")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.score >= 0.7} == {8}
    assert toxicity.score(odd.limit(0), g).count() == 0
    other = spark.createDataFrame([(1, None), (5, 2), (6, -1), (8, 7)], "doc_id long, toxic int")
    assert toxicity.fit(odd, other) == toxicity.Grammar()  # no label that is 0 or 1


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    m = langid.fit(docs.where(id_crc("doc_id") % 4 != 2))
    got = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where(id_crc("doc_id") % 4 == 2)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_scores_equal_plain_kernel_ridge(spark):
    """fit and identify against a kernel matrix over n-gram sets, piece by piece, and its dense ridge solution."""
    rng = np.random.default_rng(5)
    words = {"de": "der hund lief nicht über die straße", "en": "the dog ran over that street", "fr": "le chien courut dans une rue"}
    rows = [(i, " ".join(rng.choice(words[x].split(), rng.integers(4, 900))), x) for i, x in enumerate(["de", "en", "fr"] * 12)]
    new = [(100 + i, " ".join(rng.choice(words[x].split(), rng.integers(4, 900)))) for i, x in enumerate(["de", "en", "fr"] * 4)]

    def kernel(a, b):
        parts = [[set(langid.grams(t[i : i + langid.PIECE + 2])) for i in range(0, len(t), langid.PIECE)] for t in (a, b)]
        return np.mean([[len(x & y) / np.sqrt(len(x) * len(y)) for y in parts[1]] for x in parts[0]])

    texts, names = [t for _, t, _ in rows], sorted(words)
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for *_, x in rows])
    alpha = np.linalg.solve(k + langid.RIDGE * len(rows) * np.eye(len(rows)), y)
    want = np.array([[kernel(t, u) for u in texts] for _, t in new]) @ alpha
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.allclose(langid.products(langid.pieces([t for _, t in new]), len(new), m.weights), want, atol=2e-3)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(new, "doc_id long, text string"), m).collect()}
    for (i, _), s in zip(new, want, strict=True):
        e = np.exp(langid.SHARPNESS * (s - s.max()))
        assert got[i].lang_pred == names[s.argmax()] and got[i].score == pytest.approx(e.max() / e.sum(), abs=1e-2)


def test_language_learns_rare_ones_and_letters(spark):
    rows = [(i, "the dog and the street", "en") for i in range(3000)] + [(5000 + i, "ja niin on koira tie", "fi") for i in range(3)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["½ ² ① Ⅷ ٣", "ª", "koira on", "9 % _"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), m).collect()}
    assert m.langs == ["en", "fi"] and got[0] == got[3] == "und" and got[1] != "und" and got[2] == "fi"


def test_language_labels_are_bounded(spark):
    """Of too many different labels those of most rows are learnt."""
    rows = [(i, "the dog and the street", "en") for i in range(30)] + [(100 + i, "koira on tie", "fi") for i in range(20)] + [(200 + i, f"text {i}", f"dirty {i}") for i in range(40)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=2).langs == ["en", "fi"]


def test_language_odd_rows(spark, odd):
    m = langid.fit(odd)
    got = {r.doc_id: r for r in langid.identify(odd, m).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(odd.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), m).count() == 0


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    m = classifier.fit(docs, labels.where(id_crc("doc_id") % 3 != 1))
    assert (np.diff(m.thresholds) > 0).all()
    got = classifier.rate(docs, m).join(labels, "doc_id").where(id_crc("doc_id") % 3 == 1).collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.3


def test_classifier_odd_rows(spark, odd, no_labels):
    got = classifier.rate(odd, classifier.fit(odd, no_labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.expected_grade <= 3 and 0 <= r.tail <= 1 for r in got)
    one = classifier.fit(odd, spark.createDataFrame([(4, 1, 0), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert (np.diff(one.thresholds) > 0).all()


def exact(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in ok if i % 100 == 0):
        near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)
        out[q] = near[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in e.collect()], 10)
    got = {}
    for r in ann.search(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 10 * len(want)


def test_neighbours_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (11, [None, 1.0]), (12, [1.0])]
    e = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, list int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(e, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 5), (100, 1, 0), (100, 2, 3)]
    assert ann.search(e.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Copies of rows change nothing, be there few of all or many near a query."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(0, 1200, 20)]
    want = {(q, i + 1, n) for q, near in exact(rows, 10).items() for i, (_, n) in enumerate(near)}
    near = {n for q, i, n in want if i == 1}
    e = spark.createDataFrame([r for r in rows for _ in range(30 if r[0] in near else 3)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(e).collect()]
    assert len(got) == len(want) and set(got) == want


def test_neighbours_of_ids_with_two_vectors(spark):
    """An id is found once, by its nearest vector, and asks with each of its vectors."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(8).tolist()) for i in (*range(0, 900, 20), *range(0, 900, 20))]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 900, 100):
        best = {}
        for i, v in rows:
            for j, u in rows:
                if j == q and i != q:
                    best[i] = min(best.get(i, np.inf), float(np.linalg.norm(np.subtract(u, v))))
        assert got[q] == [i for _, i in sorted((d, i) for i, d in best.items())[:10]]


def test_short_lists_send_a_query_to_more(spark):
    """A query whose nearest list holds fewer than k others goes on to the next lists."""
    index = ann.Index(np.eye(2), np.array([[0.0, 0.0], [50.0, 0.0], [90.0, 0.0]]), 1)
    rows = spark.createDataFrame([(1, [91.0, 1.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    held = np.array([30, 4, 3])
    got = {(r.id, r.list) for r in ann.assigned(rows, index, 1, held, 11).collect()}
    assert got == {(1, 2), (1, 1), (1, 0), (2, 0)}
    assert {(r.id, r.list) for r in ann.assigned(rows, index, 1, held, 7).collect()} == {(1, 2), (1, 1), (2, 0)}
    assert ann.assigned(rows, index, 1, held, 100).count() == 6  # fewer candidates than asked for: all lists


def test_probes_follow_the_vectors():
    """Clustered vectors need a small share of the lists, and a smaller one of more vectors."""
    shares = []
    for n in (2000, 20_000):
        rng = np.random.default_rng(2)
        lists = int(n**0.5)
        x = 20 * rng.standard_normal((lists, 16))[rng.integers(0, lists, n)] + rng.standard_normal((n, 16))
        centres = x[rng.choice(n, lists, replace=False)]
        shares.append(ann._probes(x, centres, 10, rng) / lists)
    assert shares[1] < shares[0] and shares[0] < 0.5


def test_scan_gives_up_only_what_is_far():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    rot = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    ids = np.arange(3000)
    for qid, near, dist in ann.scan(x[:20], ids[:20], x, ids, rot, 10):
        d = np.sqrt(((x - x[qid]) ** 2).sum(1))
        d[qid] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert len(set(near) & set(want)) >= 9 and np.allclose(dist, d[near])


def test_mixing_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels).toPandas()
    names = list(got.posteriors[0])
    a = np.array([[p[n] for n in names] for p in got.posteriors]) * got.n_tokens.to_numpy()[:, None]
    own = a.sum(0)
    want = (own / own.sum()) ** mixing.TEMPER
    want *= own.sum() / want.sum()
    assert (got.rate >= 0).all() and np.abs((a * got.rate.to_numpy()[:, None]).sum(0) - want).max() < 2e-3 * want.max()
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in got.posteriors)


def test_mixing_odd_rows(spark, odd, no_labels):
    got = mixing.mix(odd, no_labels, least=1.0, grow=True, keep=("text", "rate", "p", "bins")).collect()
    assert len(got) == odd.count() and all(r.rate >= 1 for r in got)
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, some).count() == odd.count()
    assert mixing.mix(odd.limit(0), some).count() == 0


def test_no_python_in_native_operators(spark, odd, no_labels):
    from motorcade.llm import pii

    for df in (mixing.mix(odd, no_labels), mixing.measured(odd, "doc_id", "text"), pii.pii_digest(odd), pii.redact(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("seed", range(3))
def test_ridge_logistic_matches_gradient_zero(seed):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.random((60, 3)), np.ones((60, 1))])
    y = (rng.random(60) < 0.5).astype(float)
    prior = np.array([0.5, 0, 0, 0])
    w = toxicity.ridge_logistic(x, y, np.ones(60), prior)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs((x.T @ (p - y) + np.array([toxicity.RIDGE] * 3 + [1e-6]) * (w - prior))).max() < 1e-4


def test_classifier_gradient_and_optimum():
    """The gradient is that of the likelihood written out grade by grade, and training ends where it is zero."""
    rng = np.random.default_rng(4)
    n = 60
    row, feature, value = np.repeat(np.arange(n), 5), rng.integers(0, 40, 5 * n), rng.random(5 * n)
    y = rng.integers(0, 4, n)
    x = np.zeros(classifier.SIZE + 3)
    x[:40], x[-3:] = rng.standard_normal(40), (-0.5, 0.1, -0.2)

    def plain(x):
        t = [x[-3], x[-3] + np.exp(x[-2]), x[-3] + np.exp(x[-2]) + np.exp(x[-1])]
        total = 0.0
        for i in range(n):
            s = sum(v * x[f] for f, v in zip(feature[row == i], value[row == i], strict=True))
            above = [1.0, *[1 / (1 + np.exp(-(s - k))) for k in t], 0.0]
            total -= np.log(above[y[i]] - above[y[i] + 1])
        return total / n + classifier.RIDGE / 2 * (x[: classifier.SIZE] ** 2).sum()

    got, grad = classifier.loss(x, row, feature, value, y)
    assert got == pytest.approx(plain(x))
    for i in (0, 7, 39, classifier.SIZE, classifier.SIZE + 1, classifier.SIZE + 2):
        e = np.zeros(len(x))
        e[i] = 1e-6
        assert (plain(x + e) - plain(x - e)) / 2e-6 == pytest.approx(grad[i], abs=1e-6)
    m = classifier.train(row, feature, value, y)
    gaps = np.log(np.diff(m.thresholds))
    assert np.abs(classifier.loss(np.concatenate([m.weights, [m.thresholds[0]], gaps]), row, feature, value, y)[1]).max() < 1e-4


def test_classifier_grades_stay_in_range(spark, odd):
    m = classifier.fit(odd, spark.createDataFrame([(4, 3, 0), (5, 7, 5), (6, -1, -2), (7, 0, 9)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.expected_grade <= 3 for r in classifier.rate(odd, m).collect())


def test_mixing_rates_are_the_projected_optimum(spark):
    """Rates equal those of plain projected gradient steps on dense arrays, run to the end."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels, targets={"q0t0": 0.4, "q0t1": 0.1, "q1t0": 0.4, "q1t1": 0.1}).toPandas()
    names = list(got.posteriors[0])
    a = np.array([[p[n] for n in names] for p in got.posteriors]).T * got.n_tokens.to_numpy()
    want = np.array([{"q0t0": 0.4, "q0t1": 0.1, "q1t0": 0.4, "q1t1": 0.1}.get(n, 0.0) for n in names])
    want *= a.sum() / want.sum()
    x, h = np.ones(a.shape[1]), np.linalg.inv(a @ a.T + 1e-9 * np.trace(a @ a.T) * np.eye(len(names)))
    for _ in range(3000):
        x = np.maximum(0, x - a.T @ (h @ (a @ x - want)))
    assert np.abs(a @ got.rate.to_numpy() - a @ x).max() <= 3 * mixing.TOLERANCE * want.max()
    assert got.missed[0] == pytest.approx(np.abs(a @ got.rate.to_numpy() - want).max() / want.max(), abs=1e-6)


@pytest.mark.parametrize("least", (0.0, 1.0))
@pytest.mark.parametrize("spread", (0.1, 0.3, 1.0))
def test_mixing_steps_are_few_where_plain_ones_are_many(least, spread):
    """Posteriors so alike that targets are hard or impossible to meet: few passes, and no farther from the targets than
    a thousand plain steps."""
    rng, n = np.random.default_rng(0), 2000
    logs = np.log(rng.dirichlet(np.ones(4)))[:, None] + spread * rng.standard_normal((4, 3)) @ rng.standard_normal((3, n))
    a = np.exp(logs) / np.exp(logs).sum(0) * (np.floor(np.exp(rng.normal(5, 1.2, n))) + 1)
    own, gram = a.sum(1), a @ a.T
    goal = own**mixing.TEMPER / (own**mixing.TEMPER).sum()
    goal *= own.sum() if not least else (own / goal).max()
    h = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(4))
    far = lambda t: np.sqrt((t - goal) @ h @ (t - goal))
    x = y = np.ones(n)
    for _ in range(1000):
        x = np.maximum(least, x - a.T @ (h @ (a @ x - goal)))
    passes, tried = 0, None

    def totals(push):
        nonlocal passes, tried
        passes, tried = passes + 1, np.maximum(least, y - a.T @ push)
        return a @ tried, (a * (tried > least)) @ a.T

    def take():
        nonlocal y
        y = tried

    steps, now = mixing.stepped(own, goal, gram, gram if not least else 0 * gram, totals, take)
    assert passes <= 80 and np.allclose(now, a @ y) and y.min() >= least
    assert np.abs(now - goal).max() <= mixing.TOLERANCE * goal.max() or far(now) <= 1.05 * far(a @ x)
    z = np.ones(n)
    for push in steps:
        z = np.maximum(least, z - a.T @ push)
    assert np.allclose(z, y)


def test_mixing_ends_when_labels_tell_nothing(spark, monkeypatch):
    """Labels that have nothing to do with the texts: targets stay out of reach and rates are still written only a few times."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = docs.selectExpr("doc_id", "int(pmod(xxhash64(doc_id), 3) = 0) as quality", "int(pmod(xxhash64(doc_id, 1), 9) = 0) as toxic")
    made, write = [], mixing.written

    def counted(df, what):
        made.append(what)
        assert made.count("rates") <= 10
        return write(df, what)

    monkeypatch.setattr(mixing, "written", counted)
    targets = {"q0t0": 0.02, "q0t1": 0.9, "q1t0": 0.02, "q1t1": 0.06}
    got = mixing.mix(docs, labels, targets=targets).toPandas()
    names = list(got.posteriors[0])
    a = np.array([[p[n] for n in names] for p in got.posteriors]).T * got.n_tokens.to_numpy()
    want = np.array([targets[n] for n in names])
    want *= a.sum() / want.sum()
    assert got.missed[0] == pytest.approx(np.abs(a @ got.rate.to_numpy() - want).max() / want.max(), abs=1e-6)


def test_mixing_posteriors_are_naive_bayes(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, 0, 1), (7, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.measured(odd, "doc_id", "text").collect()
    named = {4: "q1t0", 5: "q0t1", 8: "q0t1", 7: "q1t0", 9: "q1t1"}
    learnt = [(named[r.id], r.bins) for r in rows if r.id in named]
    got = {(r.doc_id): r.posteriors for r in mixing.mix(odd, labels).collect()}
    for r in rows:
        logs = {}
        for d in sorted(set(named.values())):
            mine = [b for n, b in learnt if n == d]
            logs[d] = np.log((len(mine) + mixing.SMOOTH * mixing.BINS) / (len(learnt) + 3 * mixing.SMOOTH * mixing.BINS))
            for m, b in enumerate(r.bins):
                logs[d] += np.log((sum(x[m] == b for x in mine) + mixing.SMOOTH) / (len(mine) + mixing.SMOOTH * mixing.BINS))
        total = sum(np.exp(v) for v in logs.values())
        assert got[r.id] == pytest.approx({d: np.exp(v) / total for d, v in logs.items()})
