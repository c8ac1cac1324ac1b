"""The n-gram model against Kneser-Ney by dictionaries, and the whole verdict of the quality rules by brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.llm import common, perplexity
from curaspark.llm.perplexity import LEAST, ORDER


class Plain:
    """Interpolated modified Kneser-Ney over bytes; n-grams rarer than LEAST leave their mass to the back-off."""

    def __init__(self, texts):
        self.counts = {k: Counter() for k in range(1, ORDER + 1)}
        for t in texts:
            b = b"\xff" * (ORDER - 1) + t.encode()
            for i in range(ORDER, len(b) + 1):
                self.counts[ORDER][b[i - ORDER : i]] += 1
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.taken = {}, defaultdict(int), defaultdict(float)
        for k, counts in self.counts.items():
            n = [sum(c == i for c in counts.values()) for i in range(1, 5)]
            self.discount[k] = perplexity.discounts(*n)
            for g, c in counts.items():
                self.total[k, g[:-1]] += c
                if c >= LEAST.get(k, 1):
                    self.taken[k, g[:-1]] += c - self.discount[k][min(c, 3)]

    def p(self, g):
        k, lower = len(g), self.p(g[1:]) if len(g) > 1 else 1 / 256
        total, c = self.total.get((k, g[:-1]), 0), self.counts[k].get(g, 0)
        if not total:
            return lower
        own = c - self.discount[k][min(c, 3)] if c >= LEAST.get(k, 1) else 0.0
        return own / total + (1 - self.taken[k, g[:-1]] / total) * lower

    def log_ppl(self, text):
        b = b"\xff" * (ORDER - 1) + text.encode()
        return -float(np.mean([np.log(self.p(b[i - ORDER : i])) for i in range(ORDER, len(b) + 1)])) if text else 0.0


def corpus():
    r = np.random.default_rng(11)
    words = "der die und ein mit auf haus baum über straße weiß groß klein laufen sehen geht".split()
    russian = "мама мыла раму папа читал газету пил чай с вареньем на кухне утром".split()
    rows = [(i, " ".join(r.choice(words, 60)), "de") for i in range(40)] + [(100 + i, " ".join(r.choice(russian, 60)), "ru") for i in range(40)]
    junk = "".join(chr(c) for c in r.integers(0x0400, 0x04FF, 500))
    rows += [(200, " ".join(junk[i : i + 6] for i in range(0, 480, 6)), "ru"), (201, rows[0][1], "de"), (202, None, "de"), (203, "", None), (204, "kurz", "??")]
    return rows


@pytest.mark.parametrize("shards", [1, 16])
def test_model_is_kneser_ney(shards):
    texts = [t for _, t, _ in corpus() if t]
    plain, model = Plain(texts), perplexity.Model.of(texts, shards)
    other = ["der hund geht mit dem ball", "мама читал чай", "日本語のテキスト", "x", ""]
    assert model.perplexity(texts[::7] + other) == pytest.approx([plain.log_ppl(t) for t in texts[::7] + other], abs=1e-5)


def test_probabilities_sum_to_one():
    model = perplexity.Model.of([t for _, t, _ in corpus() if t], 4)
    for context in (b"er di", b" und ", b"\xff\xff\xff\xff\xff", b"qqqqq"):
        codes = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint64)
        assert np.exp(model.log_p(codes).astype(float)).sum() == pytest.approx(1.0, abs=1e-4)


def test_counts_grow_with_the_corpus(spark):
    texts = [t for _, t, _ in corpus() if t]
    few, all_ = (len(perplexity.text_counts(x)[0]) for x in (texts[:10], texts))
    assert all_ > 2 * few


def test_verdicts(spark):
    """Features of Spark's model, bands and kept, recomputed from the plain model; junk of Cyrillic letters is rejected."""
    rows = corpus()
    plain = Plain([t for _, t, _ in rows if t])
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, N_WORDS string, kept string").repartition(3)
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    ppl = {d: plain.log_ppl(t or "") for d, t, _ in rows}
    lang = {d: x if x in ("de", "ru") else "und" for d, _, x in rows}
    fine = perplexity.FINE
    for d, t, _ in rows:
        assert got[d].log_ppl == pytest.approx(ppl[d], abs=1e-5)
        same = np.sort([np.floor(got[e].log_ppl * fine) + 0.5 for e, x, _ in rows if x and lang[e] == lang[d]])
        w = (t or "").split()
        failed = len(w) < 10 or got[d].n_repeat_words * 100 > 20 * len(w)
        assert got[d].base_failed == failed
        if failed:
            assert not got[d].kept
            continue

        def median(x):
            return np.sort(x)[int(np.ceil(len(x) / 2)) - 1]

        mid = median(same)
        sd = max(1.4826 * median(np.abs(same - mid)) / fine, 0.03)
        off = (got[d].log_ppl - mid / fine) / (sd * np.sqrt(1 + 200 / len(t)))
        assert got[d].kept == (-6 <= off <= 5)
    assert not got[200].kept and not got[200].base_failed
    assert np.mean([got[d].kept or got[d].base_failed for d, t, _ in rows if t and d < 200]) > 0.95


def test_no_texts_are_kept_between_without_them(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    short = perplexity.quality_rules(docs, with_text=False)
    whole = perplexity.quality_rules(docs)
    assert "text" not in short.columns and whole.columns[:3] == docs.columns
    assert sorted(short.select("doc_id", "kept").collect()) == sorted(whole.select("doc_id", "kept").collect())
    assert perplexity.quality_rules(docs.limit(0)).count() == 0 and perplexity.quality_rules(docs.drop("lang").filter("doc_id > 201")).filter(F.col("kept")).count() == 0
    common.clean(spark)
