"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; brute force where there is no SQL."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.llm import ann, bytenet, html, jaccard, langid, lines, packing, perplexity, sentencepiece, urls
from curaspark.llm.components import components
from curaspark.llm.queries import tokenizer_path

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river"
ROWS = [
    (1, PROSE, "en"),
    (2, PROSE + " today", "en"),
    (2, PROSE + " today", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", "xx-odd"),
    (None, "a line of its own with null id here\nshort\n" + PROSE, "en"),
    (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich\n" * 3, "de"),
    (8, "word " * 30_000, "en"),
    (9, "x", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    odd = F.lit("clash")
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: odd for c in ("score", "kept", "ids", "gone", "h", "node", "times", "__own2")}).repartition(3)


def words(t, lower=True):
    t = t or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_sentencepiece_round_trip(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    got = sentencepiece.decode(sentencepiece.encode(docs, path, dropout=0.3), path)
    assert got.filter("decoded <> coalesce(text, '')").count() == 0 and got.count() == len(ROWS)
    assert sentencepiece.encode(docs.limit(0), path).count() == 0
    import sentencepiece as library

    ref, plain = library.SentencePieceProcessor(model_file=path), sentencepiece.Encoder(sentencepiece.Model(path), 0.0)
    texts = [t or "" for _, t, _ in ROWS] + ["  two  spaces é 語 \U0001f600", "y" * 300]
    assert [x.tolist() for x in plain.encode(texts, [0] * len(texts))] == [ref.encode(t) for t in texts]
    varied = sentencepiece.Encoder(plain.model, 0.3, seed=2)
    a = [varied.encode([PROSE], [d])[0].tolist() for d in range(8)]
    assert len({tuple(x) for x in a}) > 1 and a == [varied.encode([PROSE], [d])[0].tolist() for d in range(8)]


def by_one_agenda(encoder, text, doc):
    """Each unit by itself, with the heap."""
    out = []
    for k, unit in enumerate(encoder.model.unit.findall(" " + text)):
        out += encoder._finish(unit, *encoder.by_heap(unit, int(encoder.keys(np.array([doc]), np.array([k]))[0]))).tolist()
    return out


def test_trees_equal_the_agenda():
    e = sentencepiece.Encoder(sentencepiece.Model(tokenizer_path("piece_bpe_32k.model")), 0.3, seed=3)
    text = "antidisestablishmentarianism international, ...!? Straße語x  " + "y" * 60 + " " + PROSE
    for d in (0, 5, 2**40):
        assert e.encode([text, "", text], [d, 1, d])[0].tolist() == by_one_agenda(e, text, d)
    e.most = 0  # forgets before each slice
    assert e.encode([text], [5])[0].tolist() == by_one_agenda(e, text, 5)


def test_decode_of_null_and_empty_lists(spark):
    """Null and empty lists of ids decode to the empty text, others by their own part of a batch."""
    path = tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [264]), (4, None), (5, [264, 264])], "doc_id long, ids array<int>").coalesce(1)
    got = sentencepiece.decode(rows.filter("doc_id > 1"), path)
    assert [r.decoded for r in got.orderBy("doc_id").collect()] == ["", "a", "", "a a"]
    both = sentencepiece.decode(sentencepiece.encode(rows.select("doc_id", F.lit("a b").alias("text")), path), path)
    assert dict(both.dtypes)["ids"] == "array<int>" and both.filter("decoded = text").count() == 5


def test_words_met_once_make_no_nodes():
    """They go through their agendas by themselves; before, each made a node for itself and one for every skip."""
    e = sentencepiece.Encoder(sentencepiece.Model(tokenizer_path("piece_bpe_32k.model")), 0.3, seed=3, most=120)
    text = " ".join("ab" * (k % 9) + f"{chr(97 + k % 26)}{chr(97 + k // 26)}ologische語" for k in range(100))
    assert e.encode([text], [5])[0].tolist() == by_one_agenda(e, text, 5) and e.first.n == 0
    for d in range(40):  # units beyond 120 are forgotten, those with nodes stay and keep them
        again = text.replace("ologische", f"ologo{d}") + " the" * 5 + " international" * 3
        assert e.encode([again], [d])[0].tolist() == by_one_agenda(e, again, d)
    assert e.first.n and e.unit[" the"] < 10 and e.root.all[e.unit[" the"]] >= 0


def test_every_occurrence_draws_its_own_skips():
    e = sentencepiece.Encoder(sentencepiece.Model(tokenizer_path("piece_bpe_32k.model")), 0.3)
    one = [tuple(by_one_agenda(e, "international", d)) for d in range(1000)]
    assert len(set(one)) > 100 and [tuple(x) for x in e.encode(["international"] * 1000, list(range(1000)))] == one
    many = e.encode([" ".join(["international"] * 1000)], [1])[0]
    assert e.model.decode(many) == " ".join(["international"] * 1000) and len(set(np.diff(np.flatnonzero(many == many[0])))) > 4


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 700)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(230, 6)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 6), (302, [1.0, float("nan")] + [0.0] * 4), (400, [1.0, 2.0]), (None, [1.0] * 6), (7, x[7].tolist())]
    rows += [(100, x[100].tolist()), (200, x[3].tolist()), (500, x[9].tolist()), (500, x[9].tolist())]  # repeated queries, one of another vector
    df = spark.createDataFrame([(i, v, "clash", i) for i, v in rows], "vec_id long, embedding array<double>, score string, KEY long").repartition(5)
    got = {}
    for q in ann.nearest(df, df.filter("vec_id % 100 = 0"), k=5, query_block=2, strip=7, sample=3).orderBy("query_id", "query_key", "rank").collect():
        got.setdefault((q.query_id, q.query_key), []).append((q.score, q.vec_id, q.rank))
    pool = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    asked = [(0, x[0]), (100, x[100]), (200, x[200]), (200, x[3]), (500, x[9])]
    want = [(q, sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in pool if i != q)[:5]) for q, v in asked]
    assert sorted((q, tuple(i for _, i, _ in found)) for (q, _), found in got.items()) == sorted((q, tuple(i for _, i in w)) for q, w in want)
    for (q, _), found in got.items():
        assert [r for *_, r in found] == [1, 2, 3, 4, 5] and any(np.allclose([s for s, *_ in found], [s for s, _ in w]) for p, w in want if p == q)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df.limit(0), df).count() == 0


def test_quality_rules(docs):
    got = perplexity.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = words(r.text, False)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, t in enumerate(windows) if windows.count(t) > 1 for k in range(5)} if len(w) < 1000 else set(range(len(w)))
        kept = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(kept) - len(set(kept)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert perplexity.quality_rules(docs.limit(0)).count() == 0


def brute_lines(rows, least=5):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        keep = []
        for line in (t or "").split("\n"):
            w = tuple(x for x in re.split("[ \t\x0b\f\r]+", line.lower()) if x)
            near = any(w == v or (len(w) == len(v) and sum(a != b for a, b in zip(w, v)) == 1) or (len(w) - len(v) == 1 and any(w[:k] + w[k + 1 :] == v for k in range(len(w)))) or (len(v) - len(w) == 1 and any(v[:k] + v[k + 1 :] == w for k in range(len(v)))) for v in seen if len(v) >= least)
            if not w or w not in seen and (len(w) < least or not near):
                keep.append(line)
            seen.append(w)
        out[d] = "\n".join(keep) if t is not None else None
    return out


def test_line_dedup(docs, spark):
    r = np.random.default_rng(4)
    base = [[f"w{r.integers(0, 40)}" for _ in range(9)] for _ in range(5)]
    rows = []
    for d in range(30):
        lines_ = []
        for _ in range(4):
            w = list(base[r.integers(0, 5)])
            for _ in range(r.integers(0, 3)):
                k, what = r.integers(0, len(w)), r.integers(0, 3)
                w = w[:k] + ([] if what == 0 else [f"n{r.integers(0, 9)}"]) + w[k + (what < 2) :]
            lines_.append("  ".join(w) if r.integers(0, 2) else " ".join(w).upper())
        rows.append((d, "\n".join(lines_)))
    rows += [(40, None), (41, ""), (42, "a b\na b")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(rows)
    assert lines.dedup_lines(docs).count() == len(ROWS) and set(docs.columns) <= set(lines.dedup_lines(docs).columns)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_urls(spark):
    odd = ["https://A.Example.ORG/en/12?x=1", "http://example.org/es/", "http://notexample.org", "https://org/", "ftp://x.com/de/", "http://y.com/fr", None, "", "no scheme", "a://b://c/d", "http://casino-win.example.net/x#y", "://", "http://é.net/ü"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd * 2)], "page_id long, url string, host string")
    got = urls.judge_urls(df).orderBy("page_id").collect()
    bias, w = urls.weights()
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = [(t, v) for t, v in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if bias + sum(w[g] for g in urls.url_grams(host, path)) >= 0 else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas()  # noqa: F841
    assert con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.sql()}) ORDER BY 1").fetchall() == [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got]


def test_quality_classifier(docs, spark):
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(PROSE.split(), 60)) if i % 2 else " ".join(x + "$$$" for x in r.choice(PROSE.split(), 60)) for i in range(120)]
    train = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(120)], "doc_id long, quality int")
    net = bytenet.fit(train, labels)
    got = bytenet.classify(train, net).join(labels, "doc_id").withColumn("held_out", bytenet.held_out(0, 5)).filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in got]) > 0.9
    scored = bytenet.classify(docs, net)
    assert scored.filter("score between 0 and 1").count() == len(ROWS) and bytenet.classify(docs.limit(0), net).count() == 0
    long = PROSE * 20_000
    assert net.vectors(long)[: bytenet.FILTERS] == pytest.approx(net.vectors(PROSE * 200)[: bytenet.FILTERS], abs=0.2)
    assert bytenet.fit(train, labels.limit(0)).score(["x"])[0] == pytest.approx(0.5)


def test_language(docs, spark):
    de = "der die das und nicht eine von mit auf für ist im dem den des sich auch als noch wie".split()
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice(de if i % 2 else PROSE.split(), 30)), "de" if i % 2 else "en") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, ~bytenet.held_out(2, 4))
    got = langid.identify(train, model).withColumn("held_out", bytenet.held_out(2, 4)).filter("held_out").collect()
    assert all(x.lang == x.lang_pred for x in got)
    by_id = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert [by_id[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and by_id[7].lang_pred == "de"
    empty = langid.fit(train.limit(0), F.lit(True))
    assert empty.predict(["text"])[0] == ["und"]


def test_html():
    page = '<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, yes. Fine.</div><article><h1>Head &amp; line</h1><p>One  <b>long</b> sentence,\nwith marks. More.<p>Second<br>part.<form>Name, please.<input></form><div class=comments><p>Nice, really. Good.</div></article><aside><p>Aside, here. Too.</p></aside><footer>&copy;</footer><script>var a="</p>";'
    assert html.main_text(page) == "Head & line\nOne long sentence, with marks. More.\nSecond part."
    assert html.main_text("") == "" and html.main_text("<nav>x</nav>") == "" and html.main_text("<p>Only, this. Text") == "Only, this. Text"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "clash"), (1, "u", "<p>A, b.</p>", "clash"), (2, None, "", "clash")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.extract(df).collect()) == [("", 0), ("", 0), ("A, b.", 5)]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(docs, spark):
    r = np.random.default_rng(3)
    base = [list(map(str, r.integers(0, 500, 40))) for _ in range(6)]
    rows = [(i, " ".join(w if r.random() > 0.02 else "z" + w for w in base[i % 6][: r.integers(34, 41)])) for i in range(80)] + [(99, None), (98, ""), (97, "a b"), (96, "A  B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(find(i), []).append(d)
    want = {d: min(g) for g in want.values() for d in g}
    for block in (512, 4):
        got = jaccard.jaccard_components(df, block=block).collect()
        assert {x.doc_id: x.component_id for x in got} == want
        assert {x.doc_id: x.n_shingles for x in got} == {d: len(s) for (d, _), s in zip(rows, sets)}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} >= {1, 3, 4, 5, 7, 8, 9} and kept.filter("doc_id = 2").count() == 0
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def test_packing(docs):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, open_windows=2).collect()
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for d, t in {d: t for d, t, _ in ROWS if d != 2}.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    memo = packing.WordMemo(path, most=5)
    for t in ("Hello, WORLD. It's 12 o'clock!!, ok.\nYes", "<|endoftext|> x", "Σς ﬁ e\u0301", "a_, b. c", "!!. x"):
        assert memo.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_words_met_again_are_not_learned_again():
    """A full memo forgets words met in one slice of texts alone; before, it forgot all and learned common ones time and again."""
    path = tokenizer_path("word_bpe_49k.json")
    memo, learned = packing.WordMemo(path, most=40), []
    real, memo._learn = memo._learn, lambda words: learned.extend(words) or real(words)
    for k in range(30):
        texts = ["The house stands, été " + " ".join(f"new{k}x{i}***" for i in range(5)), "<|endoftext|> x", "", f"house {k}"]
        for t, ids in zip(texts, memo.encode_all(texts), strict=True):
            assert ids.tolist() == memo.tokenizer.encode(t, add_special_tokens=False).ids
    assert learned.count("house") == 1 and len(memo.word) <= 60


def test_urls_held_out():
    """Hosts that stand in no row of the table the model learns from."""
    block = "casino-palace.net bigbets.example.com sportsbetting.org pokerstars.net cheap-pills.example.com pills4u.net spam-mail.example.net adserver9.example.com adult-zone.net livecams.net payday-advance.com torrents.org ads-count.example.com adult-y.example.net casino-win.example.com warezworld.net clicktracker.net xxx-clips.net porno.example.org jackpots.info"
    allow = "newspapers.net weatherstation.org my-garden.com blog.libraries.example.net reading-room.org history-today.com nature-park.net schulen.example.com gartenbau.de cuisines.fr bibliotecas.es thering.example.com tionsh.example.net universal.org mountaineers.net bridges.com northern-lights.org mathematica.net kitchens.com windows.net"
    bias, w = urls.weights()
    known = {host for host, _, _ in urls.labelled()}
    for hosts, verdict in ((block.split(), True), (allow.split(), False)):
        assert not known & set(hosts)
        assert np.mean([(bias + sum(w[g] for g in urls.url_grams(h, "/en/5"))) >= 0 for h in hosts] == np.array(verdict)) >= 0.9


def test_language_sample_and_clashes(docs, spark):
    """At most per_language texts of a language are learned from, whatever their number; empty tables and odd columns."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort und satz "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 100 == 0, "nl").otherwise("de").alias("lang"))
    seen = []
    real, langid.Hierarchy = langid.Hierarchy, lambda texts, langs: seen.append(langs) or real(texts, langs)
    try:
        model = langid.fit(rows, F.lit(True), per_language=40)
        langid.fit(rows, F.lit(True), per_language=40, most_languages=1)
    finally:
        langid.Hierarchy = real
    assert [sorted((x, langs.count(x)) for x in set(langs)) for langs in seen] == [[("de", 40), ("nl", 30)], [("de", 40)]]
    assert langid.identify(docs.limit(0), model).count() == 0
    odd = langid.identify(docs.withColumn("LANG_PRED", F.lit(1)), model)
    assert odd.columns.count("lang_pred") == 1 and "LANG_PRED" not in odd.columns and odd.count() == len(ROWS)


def test_urls_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, VERDICT long")).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
