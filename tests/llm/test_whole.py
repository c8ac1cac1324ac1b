"""The whole job where an operator once did less: no characters folded, no line, occurrence, link or block left out."""

import numpy as np

from curaspark.llm import html, jaccard, lines


def test_short_and_unspaced_lines_are_deduplicated(spark):
    rows = [(1, "Share this\n\nby  Ann\n我们今天去公园散步"), (2, "share  this\n\nby Bob\n我们昨天去公园散步\n我们今天去公园散歩\n别的"), (3, "Share this\n别的\n\nby ann")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == {1: rows[0][1], 2: "\nby Bob\n别的", 3: ""}


def test_sketch_loses_no_link_at_the_bound(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(120):
        for n, more in ((3, 1), (6, 2), (15, 5)):  # shingles of the smaller set, and those that the larger has besides
            w = [f"w{x}" for x in r.integers(0, 1 << 40, n + more + 4)]
            d = 100 * k + 10 * more
            rows += [(d, " ".join(w[: n + 4])), (d + 1, " ".join(w))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.component_id == x.doc_id // 10 * 10 for x in got) and len(got) == len(rows)


def test_html_keeps_every_chosen_block():
    long, short = "One long sentence, with marks. " * 300, "A second part, of its own. " * 30
    for page in (f"<body><div id=a><p>{long}</p></div><div id=b><p>{short}</p></div>", f"<body><section><p>{long}</p></section><section><p>{short}</p></section>"):
        assert html.main_text(page) == f"{long.strip()}\n{short.strip()}"
