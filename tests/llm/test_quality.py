import zlib

import numpy as np

from graphloom.llm import quality as Q

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = Q.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in good for y in bad])
    assert auc > 0.85
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.9


def test_report_and_filter_agree(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    kept = Q.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_held_out_labels_are_not_read(spark):
    docs, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in Q.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs, labels = tables(spark)
    odd = spark.createDataFrame([(None, None, 1), (7, "", 2), (8, "x" * 300_000, 3), (8, "x" * 300_000, 3)], "doc_id long, text string, score int")
    assert all(0 <= r.score <= 1 for r in Q.quality_scores(odd, labels).collect())
    net = Q.train(docs, labels)
    texts = [b"", b"abc", b"word " * 5000]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)
    assert Q.quality_scores(odd.limit(0), labels).count() == 0
    assert {r.score for r in Q.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def plain_score(p, text):
    """The network over one text, position by position."""
    text = b"\0" * Q.BLOCK + text + b"\0" * (Q.BLOCK * max(1, -(-len(text) // Q.BLOCK)) - len(text)) + b"\0" * Q.BLOCK
    relu = lambda x: np.maximum(x, 0)
    response = [relu(sum(p["t"][k][text[i + k] if i + k < len(text) else 0] for k in range(4)) + p["c"]) if text[i] else np.zeros(Q.FILTERS) for i in range(0, len(text), 2)]
    pooled = np.zeros(Q.HIDDEN)
    for s in range(0, len(text) - Q.BLOCK, Q.BLOCK):
        real = sum(b != 0 for b in text[s : s + 2 * Q.BLOCK])
        mean = 2 * sum(response[s // 2 : s // 2 + Q.BLOCK]) / max(real, 8)
        pooled = np.maximum(pooled, relu(mean @ p["w"] + p["b"]))
    return 1 / (1 + np.exp(-(pooled @ p["v"] + p["a"][0])))


def test_forward_pass_against_positions():
    net = Q.Net(3)
    texts = [b"", b"a", b"word " * 40, "Zwölf Boxkämpfer ".encode() * 9, bytes(range(256)) * 2, b"x" * Q.BLOCK]
    assert np.allclose(net.score(texts), [plain_score(net.p, t) for t in texts], atol=1e-5)


def test_gradient_against_differences():
    net, r = Q.Net(5), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, starts = net.buffer([b"some words of a text, and more", b"THE!! THE!! THE!!" * 8, b"plain"])
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.forward(x, starts)
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    for name, g in net.gradient(x, starts, label).items():
        for at in r.permutation(np.flatnonzero(np.abs(g) > 1e-4))[:8]:
            flat, eps = net.p[name].reshape(-1), 1e-5
            flat[at] += eps
            up = loss()
            flat[at] -= 2 * eps
            down = loss()
            flat[at] += eps
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[at]) < 1e-4, name
