"""Toxicity, language, secrets: held-out accuracy, brute force, edge cases."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lading.llm import language_id as lang
from lading.llm import secret_scan as secrets
from lading.llm import toxicity as tox
from lading.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_language_of_held_out_documents(spark):
    got = QUERIES["op7_language_id"](spark, FOLDER).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
    base = [(i, t, n, "x") for i, (t, n) in enumerate([("the quick brown fox is here", "en"), ("der schnelle braune fuchs ist hier", "de")] * 20)]
    rows = [*base, (100, None, "en", "x"), (101, "", None, "x"), (102, "123 !?", "de", "x"), (None, "the fox", None, None), (103, "der fuchs " * 60000, None, None), (0, base[0][1], "en", "x")]
    df = spark.createDataFrame(rows, schema)
    kernel = lang.train(df)
    out = lang.classify(df, kernel)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[None].lang_pred == "en" and got[103].lang_pred == "de" and out.count() == len(rows)
    none = lang.train(df.filter("false"))
    assert {r.lang_pred for r in lang.classify(df, none).collect()} == {"und"} and lang.classify(df.limit(0), kernel).collect() == []


def test_kernel_is_the_presence_kernel():
    a, b = "banana bandana", "bananas"
    grams = lambda t: {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = lang.presence(a, 3), lang.presence(b, 3)
    assert abs(x.sum() - len(grams(a))) <= 1 and abs((x & y).sum() - len(grams(a) & grams(b))) <= 1


def test_toxic_documents(spark):
    got = QUERIES["op1_toxicity"](spark, FOLDER).join(table(spark, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").collect()
    toxic, clean = [r for r in got if r.y], [r for r in got if not r.y]
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic) and sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 for r in got)


def test_toxicity_on_documents_it_has_not_seen(spark):
    larger = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet").filter("toxic is not null")
    model = tox.train_on_labels(docs, labels.filter("doc_id % 3 <> 0"))
    got = tox.score_toxicity(docs.select("doc_id", "text"), model).join(labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").select("toxic", "y").collect()
    assert sum(r.toxic and r.y == 1 for r in got) >= 0.8 * sum(r.y == 1 for r in got)  # of about 300 toxic documents to learn from
    assert sum(r.toxic and r.y == 0 for r in got) <= 0.003 * sum(r.y == 0 for r in got)


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 8)).astype(np.float32)
    z = x @ np.array([2, 1.5, 1, 0, 0, 0, -1, -1]) + rng.logistic(size=600) * 0.3
    grade = np.digitize(z, [0.5, 2.0])
    w, cuts = tox.fit(x, grade, 3)
    assert cuts[0] < cuts[1] and w[0] > w[1] > w[2] > w[6] and abs(w[3:6]).max() < w[2]
    model = tox.Ordinal({}, w, cuts)
    expected = model.above(x @ w).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85
    k, eps = 3, 1e-5  # the slope of the likelihood at the optimum is nearly nil

    def loss(v):
        full = np.concatenate([np.zeros((600, 1)), 1 / (1 + np.exp(-(cuts[None] - (x @ v)[:, None]))), np.ones((600, 1))], 1)
        return -np.log(full[np.arange(600), grade + 1] - full[np.arange(600), grade]).mean() + 5e-5 * (v * v).sum()

    step = np.zeros_like(w)
    step[k] = eps
    assert abs((loss(w + step) - loss(w - step)) / (2 * eps)) < 0.02


def test_toxicity_edge_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("grade", T.StringType())])
    rows = [(i, "nice words here" if i % 2 else "awful rotten words", "x") for i in range(40)]
    docs = spark.createDataFrame([*rows, (50, None, "x"), (51, "", "x"), (None, "awful rotten", None), (52, "awful " * 100000, None), (0, rows[0][1], "x")], schema)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(50, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = tox.train_on_labels(docs, labels)
    out = tox.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "severity", "p_toxic", "grade", "toxic"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].toxic and not got[1].toxic and got[None].toxic and got[52].toxic and got[0].severity > got[1].severity
    nothing = tox.train_on_labels(docs, labels.limit(0))
    assert not any(r.toxic for r in tox.score_toxicity(docs, nothing).collect()) and tox.score_toxicity(docs.limit(0), model).collect() == []


_BASE = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"([0-9a-f]+)"),
}


def brute(text):
    out = []
    for n, (kind, least) in enumerate((("assign", 12), ("access", 18), ("hex", 16))):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in _BASE[kind].finditer(text or "") if len(m[1]) >= least]
    return [s for _, _, s in sorted(out)]


def test_base_secrets_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op6_secret_scan"](spark, FOLDER).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) if want else True


def test_secret_edge_cases(spark):
    key = "AKIA" + "Q" * 14
    rows = [(1, None), (2, ""), (3, f"é{key}"), (4, 'TOKEN="abcdefghijkl" token=short'), (5, "paſſword=abcdefghijklmno"), (6, "a" * 300000 + " " + "0123456789abcdef" * 3), (None, "secret: 0123456789abcdef0"), (3, f"é{key}"), (7, "token=token=abcdefghijklmnop")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    got = secrets.digests(secrets.findings(df, secrets.Network())).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        assert by[i].spans == ",".join(brute(t))
    assert by[3].spans == "access:1:19" and by[5].n_assign == 0 and by[6].n_hex == 2
    assert secrets.findings(df.limit(0), secrets.Network()).collect() == []


def test_network_learns_and_keeps_recall():
    rng = np.random.default_rng(3)
    hexa, word = "0123456789abcdef", "etaoin shrdlu"
    x, y = [], []
    for k in range(400):
        pre = "".join(rng.choice(list(word), 30))
        if k % 2:
            t = pre + " key = " + "".join(rng.choice(list(hexa), 32)) + " end"
            x.append(secrets.encode(t, 37, 69))
        else:
            t = pre + " mail " + "".join(rng.choice(list(word[:6]), 20)) + "12@example.com end"
            x.append(secrets.encode(t, 36, 70))
        y.append(k % 2)
    net = secrets.fit(np.stack(x), np.array(y))
    p = net.probability(np.stack(x))
    found = p >= net.threshold
    assert found[np.array(y) == 1].mean() >= 0.95 and found[np.array(y) == 0].mean() <= 0.05


def test_a_secret_at_the_end_of_a_long_token_is_seen(monkeypatch, spark):
    text = "a1/" * 40 + "Z" * 20
    seen = secrets.encodings(text, 0, len(text))
    z = secrets.encode("Z" * 20, 0, 20)[secrets.BEFORE]
    inside = [w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] for w in seen]
    assert (inside[-1][-20:] == z).all() and len(secrets.encodings(text, 0, 48)) == 1
    net = secrets.Network(np.zeros((1, 40, 1), np.float32), np.zeros(1, np.float32), np.array([1.0, 0.0], np.float32), shift=-0.5, threshold=0.5)
    net.filters[0, z, 0] = 1
    got = secrets.findings(spark.createDataFrame([(1, text + " end")], "doc_id long, text string"), net).collect()
    assert [(f.kind, f.start, f.end) for f in got[0].found] == [("net", 0, len(text))]


def test_windows_of_a_text_are_encoded_alike():
    text = "ä key = " + "Ab1" * 60 + " end 😀x"
    spans = [(0, 1), (2, 5), (8, 188), (188, 192), (193, 195), (0, len(text))]
    windows = [w for s, e in spans for w in secrets.windows_of(s, e)]
    assert (secrets.encode_all(text, windows) == np.stack([w for s, e in spans for w in secrets.encodings(text, s, e)])).all()
    assert secrets.encode_all(text, []).shape == (0, secrets.WIDTH)


def test_threshold_keeps_recall_below_a_half():
    rng = np.random.default_rng(1)
    x = np.stack([secrets.encode("".join(rng.choice(list("ab1"), 20)), 0, 20) for _ in range(1000)])
    net = secrets.fit(x, (np.arange(1000) % 10 == 0).astype(int), rounds=1)
    assert 0 < net.threshold < 0.5


def test_planted_secrets_that_no_base_pattern_matches(spark):
    rng = np.random.default_rng(9)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prose = lambda: " ".join(pick("etaoinshrdlu", int(rng.integers(3, 12))) for _ in range(30))
    rows = []
    for i in range(400):
        rows.append((i, f"{prose()} password = {pick(mixed, 24)} {prose()} see http://example.org/{pick('abcde', 8)}/page on 2024-01-{i % 28 + 1:02d} id a{i}"))
    rows += [(1000 + i, f"{prose()} ghp_{pick(mixed, 36)} {prose()}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.train(df)
    got = {r.doc_id: [(f.kind, f.p) for f in r.found] for r in secrets.findings(df, net).collect()}
    caught = sum(any(k == "net" for k, _ in got[1000 + i]) for i in range(100))
    wrong = sum(k == "net" for i in range(400) for k, _ in got[i])
    print(f"recall {caught / 100}, precision {caught / (caught + wrong)}")
    assert caught >= 90 and wrong <= 10
    assert all(p is not None for i in range(400) for k, p in got[i] if k == "assign")


def test_all_windows_train_the_network(spark, monkeypatch):
    seen = []
    fit = secrets.fit
    monkeypatch.setattr(secrets, "fit", lambda x, y, **more: seen.append((x, y)) or fit(x, y, **more | {"rounds": 1}))
    df = spark.range(2500).selectExpr("id AS doc_id", "concat('the key AKIA', upper(substr(sha2(string(id), 256), 1, 20)), ' is used by ', substr(md5(string(id)), 1, 6), '@example.org') AS text")
    secrets.train(df)
    x, y = seen[0]
    assert 2500 <= (y == 1).sum() == len(np.unique(x[y == 1], axis=0))


def test_shards_of_windows_train_one_network(spark, monkeypatch):
    """More windows than the driver fits: every shard's weights go into the network, and the threshold holds over all."""
    monkeypatch.setattr(secrets, "SHARD", 1000)
    rng = np.random.default_rng(4)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    prose = lambda: " ".join(pick("etaoinshrdlu", int(rng.integers(3, 12))) for _ in range(12))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(i, f"{prose()} password = {pick(mixed, 24)} {prose()} see http://example.org/{pick('abcde', 8)} on 2024-01-{i % 28 + 1:02d} id a{i}") for i in range(1500)]
    rows += [(5000 + i, f"{prose()} ghp_{pick(mixed, 36)} {prose()}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit_all = secrets.fit_all
    monkeypatch.setattr(secrets, "fit_all", lambda *a: seen.append([(r.y, bytes(r.x), r.fold) for r in a[0].collect()]) or fit_all(*a))
    net = secrets.train(df)
    assert len(seen) == 1 and len(seen[0]) > 3000
    x = np.stack([np.frombuffer(w, np.uint8) for y, w, fold in seen[0] if y < 0 and fold in (2, 3)])
    p = np.sort(net.probability(x))[::-1]
    assert abs(net.threshold - p[int(np.ceil(secrets.RECALL * len(p))) - 1]) < 1e-5
    got = {r.doc_id: [f for f in r.found if f.kind == "net"] for r in secrets.findings(df, net).collect()}
    caught, wrong = sum(bool(got[5000 + i]) for i in range(50)), sum(bool(got[i]) for i in range(1500))
    assert caught >= 38 and wrong <= 30, (caught, wrong)



def test_kernel_ridge_against_a_plain_one():
    """With all training rows as landmarks, the classifier is kernel ridge on the presence
    kernel, one against the rest: a plain solver over sets of bins gives its winners."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(a), 60)) for a in ("abcde ", "defgh ", "ghijk ") for _ in range(12)]
    labels = ["x"] * 12 + ["y"] * 12 + ["z"] * 12
    rows = np.stack([lang.presence(t, 3) for t in texts])
    kernel = lang.fit(labels, rows, 3, landmarks=12)
    sets = [set(np.flatnonzero(r).tolist()) for r in rows]
    like = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[like(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if y == k else -1.0 for k in "xyz"] for y in labels])
    alpha = np.linalg.solve(gram + lang.RIDGE * len(labels) * np.eye(len(labels)), target)
    fresh = ["".join(rng.choice(list(a), 40)) for a in ("abcde ", "defgh ", "ghijk ") for _ in range(20)]
    new = np.stack([lang.presence(t, 3) for t in fresh])
    own = kernel.scores(new).argmax(1)
    plain = np.array([[like(set(np.flatnonzero(r).tolist()), b) for b in sets] for r in new]) @ alpha
    assert (own == plain.argmax(1)).all() and abs(kernel.scores(new) - plain).max() < 0.05


def test_cumulative_link_against_a_plain_optimiser():
    """The same likelihood climbed by plain full gradients of numeric differences ends in the same cuts and weights."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 3)).astype(np.float32)
    grade = np.digitize(x @ np.array([2.0, 1.0, -1.0]) + rng.logistic(size=400), [0.5, 2.5])
    w, cuts = tox.fit(x, grade, 3, ridge=1e-3)

    def loss(v):
        c = np.array([v[3], v[3] + np.exp(v[4])])
        full = np.concatenate([np.zeros((400, 1)), 1 / (1 + np.exp(-(c[None] - (x @ v[:3])[:, None]))), np.ones((400, 1))], 1)
        return -np.log(np.maximum(full[np.arange(400), grade + 1] - full[np.arange(400), grade], 1e-12)).mean() + 5e-4 * (v[:3] ** 2).sum()

    v = np.zeros(5)
    for _ in range(1500):
        g = np.array([(loss(v + 1e-4 * e) - loss(v - 1e-4 * e)) / 2e-4 for e in np.eye(5)])
        v -= 0.5 * g
    assert abs(w - v[:3]).max() < 0.1 and abs(cuts - [v[3], v[3] + np.exp(v[4])]).max() < 0.1


def test_samples_stay_bounded_where_rows_repeat(spark):
    """5000 rows of one id are one row of the sample; a hot group's last window reads no more than its salts let through."""
    rows = [(1, "awful rotten", "en", 1)] * 3000 + [(i, "nice words", "en", 0) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    original = tox.train
    try:
        tox.train = lambda r, *a: seen.append(len(r)) or original(r, *a)
        tox.train_on_labels(df, df.select("doc_id", "toxic"), sample=20)
    finally:
        tox.train = original
    assert seen == [21]
    kernel = lang.train(df, sample=20)
    assert kernel.landmarks.shape[0] <= 24
    from lading.llm.common import place_of, smallest_hashes

    few = smallest_hashes(df.select("doc_id", "lang").distinct(), "doc_id", "lang", 7)
    got = sorted(r.doc_id for r in few.collect())
    order = df.select("doc_id").distinct().orderBy(place_of(F.col("doc_id"))).limit(7).collect()
    assert got == sorted(r.doc_id for r in order)
    large = spark.range(20000).select("id", (F.col("id") % 2 * 0).alias("g"))
    assert smallest_hashes(large, "id", "g", 50).count() == 50
    assert large.filter(place_of(F.col("id")) * 20000 <= 400).count() < 600  # what the window reads
