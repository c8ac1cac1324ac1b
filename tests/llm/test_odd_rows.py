"""Null ids, repeated rows, very long texts and lines, clashing columns; models against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.llm import bytenet, jaccard, langid, lines, packing
from curaspark.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


def test_packing_of_null_ids_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = [(1, "one two three " * 900), (1, "one two three " * 900), (2, "four"), (2, "five six"), (None, "seven"), (None, None), (3, "")]
    got = packing.pack_documents(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, LENGTH string, start int").repartition(3), path).collect()
    tok, want, have = Tokenizer.from_file(path), {}, {}
    for d, t in rows:
        want.setdefault(d, []).append(len(tok.encode(t or "", add_special_tokens=False).ids) + 1)
    for p in got:
        have[d] = have.get(d := p.doc_id, 0) + p.length
        assert p.doc_tokens in want[d]
    assert have == {d: sum(n) for d, n in want.items()}
    spans = sorted((p.sequence_id, p.offset, p.length) for p in got)
    assert all(b == (a + n if s == t else 0) for (s, a, n), (t, b, _) in zip(spans, spans[1:], strict=False))


def test_jaccard_of_null_ids_and_long_texts(spark):
    r = np.random.default_rng(1)
    long = list(r.choice(WORDS, 60_000))
    near = [*long[:30_000], "changed", *long[30_001:]]
    rows = [(None, "a b c d e f g"), (5, "A b c d e f g"), (None, "x y z u v w"), (7, " ".join(long)), (8, " ".join(near)), (7, " ".join(long))]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id long, text string, node int, component_id string")
    got = sorted(((x.doc_id or -1, x.component_id or -1) for x in jaccard.jaccard_components(df).collect()))
    assert got == [(-1, -1), (-1, 5), (5, 5), (7, 7), (7, 7), (8, 7)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted((x.doc_id or -1) for x in kept.collect()) == [-1, 5, 7]


def test_lines_of_null_ids_and_long_lines(spark):
    r = np.random.default_rng(2)
    long = list(r.choice(WORDS, 20_000))
    near = [*long[:9_000], "changed", *long[9_001:]]
    rows = [(None, "alone here\n" + " ".join(long)), (1, " ".join(near)), (2, "Alone  here"), (2, "Alone  here"), (3, None), (4, "\n\n")]
    df = spark.createDataFrame([(*x, "clash", 9) for x in rows], "doc_id long, text string, gone string, N_LINES_DROPPED int")
    got = lines.dedup_lines(df)
    texts = sorted((x.doc_id or -1, x.text, x.n_lines_dropped) for x in got.collect() if x.text is not None)
    assert texts == [(-1, "", 2), (1, " ".join(near), 0), (2, "Alone  here", 0), (2, "Alone  here", 0), (4, "\n\n", 0)]
    assert got.count() == len(rows) and [c.lower() for c in got.columns].count("n_lines_dropped") == 1


def plain_vectors(net, text):
    """Filters, chunks and pooling one by one."""
    b = np.frombuffer(text.encode(), np.uint8)
    blocks = max(2, -(-len(b) // bytenet.HALF))
    x = np.zeros(blocks * bytenet.HALF, np.uint8)
    x[: len(b)] = b
    e, w = net.p["e"], net.p["w"].reshape(2 * bytenet.STEP * bytenet.EMBED, bytenet.FILTERS)
    most = np.zeros((blocks, bytenet.FILTERS))
    for at in range(0, len(x), bytenet.STEP):
        seen = e[x[at : at + 2 * bytenet.STEP]].ravel()  # the last step has four bytes alone
        z = seen @ w[: len(seen)] + net.p["c"]
        most[at // bytenet.HALF] = np.maximum(most[at // bytenet.HALF], z)
    chunk = np.maximum(most[:-1], most[1:])
    return np.concatenate([chunk.mean(0), chunk.max(0)])


def test_classifier_is_the_network(spark):
    texts = ["short", "some words, again. " * 30, "é語 $$$ " * 200, "x" * 1024]
    net = bytenet.ByteNet(3)
    net.p["v"] = np.random.default_rng(4).normal(size=2 * bytenet.FILTERS).astype(np.float32)
    for t in texts:
        assert net.vectors(t) == pytest.approx(plain_vectors(net, t), abs=1e-3)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, SCORE string").repartition(2)
    got = {r.doc_id: (r.score, r.predicted) for r in bytenet.classify(df, net).collect()}
    for i, t in enumerate([*texts, "", ""]):
        v = plain_vectors(net, t) if t else np.zeros(2 * bytenet.FILTERS)
        want = 1 / (1 + np.exp(-float(v @ net.p["v"] + net.p["b"][0])))
        assert got[i][0] == pytest.approx(want, abs=1e-3) and got[i][1] == int(got[i][0] >= 0.3)


def test_languages_are_the_machines_votes(spark):
    r = np.random.default_rng(5)
    alphabets = {"de": "äöüßschei", "nl": "ijoeuaaee", "fr": "éèàquoieu", "ru": "абвгдеж"}
    rows = [(i, " ".join("".join(r.choice(list(a), 5)) for _ in range(12)), lang) for lang, a in alphabets.items() for i in range(40)]
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    for k, (_, t, _) in enumerate(rows):
        lang, score = plain_prediction(model, t)
        assert got[k].lang_pred == lang and got[k].score == pytest.approx(score, abs=1e-4)
    assert np.mean([got[k].lang_pred == rows[k][2] for k in range(1, len(rows), 2)]) > 0.9


def plain_prediction(model, text):
    x = langid.features([text])[0]

    def choose(machines):
        if len(machines.classes) == 1:
            return 0, 1.0
        votes, least = [0.0] * len(machines.classes), [np.inf] * len(machines.classes)
        for (a, b), w in zip(machines.pairs, machines.w, strict=True):
            m = float(x @ w[:-1] + w[-1])
            winner = a if m > 0 else b
            votes[winner] += 1
            votes[a] += 0.01 * np.tanh(m)
            votes[b] -= 0.01 * np.tanh(m)
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = int(np.argmax(votes))
        return best, 1 / (1 + np.exp(-2 * least[best]))

    f, s = choose(model.top)
    c, t = choose(model.inside[f])
    return model.inside[f].classes[c], s * t
