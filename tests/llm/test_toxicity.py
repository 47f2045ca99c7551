import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from weft.llm import toxicity
from weft.llm.toxicity import HIDDEN, STRIDE, WINDOW, Network, Scorer, fit, query, score, sigmoid, train, windows


def test_gradients():
    rng = np.random.default_rng(1)
    net = Network({"a": 0}, np.zeros(2), np.zeros(toxicity.GRAMS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    mask = np.arange(5) < np.array([5, 3, 0, 4])[:, None]
    inputs = {way: rng.normal(size=(4, 5, 3 * HIDDEN)) for way in "fb"}
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        x = net.run(inputs, mask)
        return float((weight / weight.sum() * (np.logaddexp(0, x) - y * x)).sum())

    g, inputs_d = net.gradients(inputs, mask, y, weight)
    for name, values, d in [*((k, net.p[k], g[k]) for k in g), *((w, inputs[w], inputs_d[w]) for w in "fb")]:
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in values.shape)
            held, values[i] = values[i], values[i] + 1e-3
            above = loss()
            values[i] = held - 1e-3
            assert abs((above - loss()) / 2e-3 - d[i]) < 3e-4, name
            values[i] = held


def test_windows_cover_and_overlap():
    for n in (0, 1, WINDOW, WINDOW + 1, 500, 1001):
        starts = list(windows(n))
        assert starts[0] == 0 and starts[-1] + WINDOW >= n and all(0 < b - a <= STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_scores_are_the_highest_window():
    texts = [" ".join(f"w{(i * k) % 37}" for i in range(n)) for k, n in ((3, 100), (5, 20), (7, 333))]
    net = train([*texts, "bad word here"] * 3, [0, 0, 0, 1] * 3)
    alone = [max(sigmoid(Scorer(net).logits(pa.array([" ".join(t.split()[s : s + WINDOW])]))[1][0]) for s in windows(len(t.split()))) for t in texts]
    assert np.allclose(Scorer(net).score(pa.array(texts)), alone, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for y, p in judged if y]
    clean = [p for y, p in judged if not y]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, "x"), (8, 0, "x"), (8, 0, "x"), (18, 0, "x"), (None, 1, "x"), (12, None, "x")], "doc_id long, toxic int, text string")
    net = fit(odd, labels)
    got = score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(empty, net).count() == 0
    assert all(r["score"] < 0.5 for r in score(odd, fit(odd, labels.limit(0))).collect())


def test_network_adds_to_its_evidence():
    """On held-out rows the network ranks toxic texts better than its evidence inputs do alone, whether a window's sum or its mean is taken."""
    sf = "/root/testdata/sf0.1"
    texts = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    rows = sorted((r["doc_id"], r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in texts)
    kept = [(i, y) for i, y in rows if zlib.crc32(str(i).encode()) % 5]
    net = train([texts[i] for i, y in kept if y or i % 2], [y for i, y in kept if y or i % 2])
    judged = [(i, y) for i, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    y, held = np.array([y for _, y in judged]), pa.array([texts[i] for i, _ in judged])
    scorer = Scorer(net)
    words, text, first, size = scorer.windows(held)
    x = net.features(list(scorer.row))[0]

    def highest(each, mean):
        sums = np.concatenate([[0], np.cumsum(each[words])])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, text, (sums[first + size] - sums[first]) / (np.maximum(size, 1) if mean else 1))
        return best

    def ranked(score):
        """The chance that a toxic text scores above another."""
        return np.mean(score[y == 1][:, None] > score[y == 0]) + np.mean(score[y == 1][:, None] == score[y == 0]) / 2

    alone = [ranked(highest(each, mean)) for each in (x[:, 0], np.maximum(x[:, :3], 0).sum(axis=1)) for mean in (False, True)]
    assert ranked(scorer.score(held)) > max(alone) + 0.02, alone


def test_evidence_is_of_other_folds():
    """A text's own fold is left out: a key that only that fold's texts hold is no evidence for them."""
    docs, labels, folds = [np.array([0, 1])] * 6 + [np.array([1])] * 6, np.array([1] * 6 + [0] * 6), np.array([0] * 6 + [1] * 6)
    found = toxicity.counts(docs, labels, folds, 2)
    whole, other = toxicity.evidence(found.sum(axis=0), np.array([6, 6])), toxicity.evidence(found.sum(axis=0) - found[0], np.array([6, 0]))
    assert whole[0] > 1 and other[0] == 0


def test_a_fit_takes_a_bounded_number_of_bytes(spark, monkeypatch):
    """Long texts don't fill the driver: fewer of them are taken."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, prior=None: seen.append((texts, labels)))
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    toxicity.fit(docs, labels)
    toxicity.fit(docs, labels, most=400_000)
    assert len(seen[0][0]) == 400 and 5 < len(seen[1][0]) < 120
