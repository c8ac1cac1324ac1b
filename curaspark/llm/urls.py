"""URL filter: a rule list, and a logistic regression on hashed character n-grams of host and path for what no rule fits.

The regression is trained on a small labelled table (``labelled``), made from words below by a rule; it is plain Python on the
driver and gives the same weights each time. Scoring is made of Spark's own functions: every 4-gram is hashed by md5 into one of
65536 weights, which stand in the plan as a constant array.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the model's verdict
on the empty string (allow); a score of 0 blocks; repeated rows are judged one by one; an empty table gives no rows; columns
named host, path, rule or verdict give way, others stay.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GRAM, BUCKETS = 4, 65536
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Words of hosts to block and of hosts to allow, and what stands around either.
BLOCK_WORDS = """casino bets betting poker slots jackpot roulette gambling lottery prize pills viagra cialis pharma meds spam scam linkfarm adserver ads adclick banners
track tracker tracking popunder adult xxx porn sex cams escort nude payday loans fastcash warez cracked keygen torrent replica phishing malware trojan doubler clickbait""".split()
ALLOW_WORDS = """weather garden library university museum history science nature reading teacher theatre orchestra railway harbour mountain kitchen recipes travel
language grammar parliament hospital insurance newspaper letters forest river bridge station market winter window freelance winner adviser address trackfield
pillow spice sexton farming betterment analysis mathematics chemistry wetter zeitung schule garten bahnhof verein maison cuisine histoire jardin voyage escuela
ciudad noticias biblioteca""".split()
_PREFIXES = ("", "www.", "m.", "blog.", "the-", "my-", "best-", "free-", "top-", "online-")
_SUFFIXES = ("", "-shop", "-club", "-world", "-24", "s-online", "-hub", "-daily", "zone", "-now")
_ENDS = (".com", ".net", ".org", ".info", ".example.com", ".example.net", ".example.org", ".test")
_PATHS = ("/en/12", "/de/405", "/fr/7.html", "/es/33/", "/", "/index", "/page/8", "/en/2024.html", "/item", "/about")


def _names(many: int) -> list[str]:
    """Invented names of two to four syllables, so that a name that says nothing is no reason to block."""
    out = []
    for k in range(many):
        x = (k + 1) * 7919
        out.append("".join("bcdfghklmnprstvwz"[(x >> 3 * i) % 17] + "aeiou"[(x >> 5 * i + 1) % 5] for i in range(2 + k % 3)))
    return out


def labelled(each: int = 6, names: int = 200) -> list[tuple[str, str, float]]:
    """host, path, label (1: block): every word stands in ``each`` hosts, parts around it taken in turn."""
    out = []
    for label, words in ((1.0, BLOCK_WORDS), (0.0, ALLOW_WORDS), (0.0, _names(names))):
        for i, word in enumerate(words):
            for j in range(each):
                k = i * each + j
                out.append((_PREFIXES[(3 * k + i) % 10] + word + _SUFFIXES[(7 * k + j) % 10] + _ENDS[k % 8], _PATHS[(9 * k + i) % 10], label))
    return out


def url_grams(host: str, path: str) -> list[int]:
    """Buckets of all n-grams of ^host$ and of the path, each part marked."""
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", path)):
        out += [int(hashlib.md5((mark + part[i : i + GRAM]).encode()).hexdigest()[:4], 16) % BUCKETS for i in range(max(len(part) - GRAM + 1, 0))]
    return out


@lru_cache(1)
def weights(rounds: int = 60, rate: float = 0.3, decay: float = 2e-4) -> tuple[float, tuple[float, ...]]:
    """Bias and weights, by stochastic gradient steps over the labelled table in a fixed order."""
    rows = [(url_grams(host, path), label) for host, path, label in labelled()]
    rows.sort(key=lambda r: hashlib.md5(repr(r).encode()).digest())
    w, bias = [0.0] * BUCKETS, 0.0
    for k in range(rounds):
        step = rate / (1 + 0.05 * k)
        for grams, label in rows:
            z = bias + sum(w[g] for g in grams)
            d = step * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label)
            bias -= d
            for g in grams:
                w[g] -= d / 4 + step * decay * w[g]
    return round(bias, 6), tuple(round(x, 6) for x in w)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.when(rest, F.regexp_extract(url, pattern, 1)).otherwise("")
    path = F.when(rest, F.regexp_extract(url, pattern, 2)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, at = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + at)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def model_score(host: Column, path: Column) -> Column:
    """Log odds of block."""
    bias, w = weights()
    table = F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")  # folded into one constant

    def total(mark: str, part: Column) -> Column:
        last = F.length(part) - GRAM + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))

        def add(acc: Column, i: Column) -> Column:
            bucket = F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(part, i, F.lit(GRAM))).cast("binary")), 1, 4), 16, 10).cast("int")
            return acc + F.element_at(table, bucket % BUCKETS + 1)

        return F.aggregate(starts, F.lit(0.0), add)

    return F.lit(bias) + total("h", F.concat(F.lit("^"), host, F.lit("$"))) + total("p", path)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """All columns of pages, with host, path, rule and verdict (allow or block)."""
    host, path = parts(F.col("url"))
    at = pages.withColumn("__p", F.struct(host.alias("host"), path.alias("path")))
    h, p = F.col("__p.host"), F.col("__p.path")
    rule, verdict = rule_of(h, p, rules)
    model = F.when(model_score(h, p) >= 0, "block").otherwise("allow")
    return common.replace_columns(at, {"host": h, "path": p, "rule": rule, "verdict": F.coalesce(verdict, model)}).drop("__p")


def sql() -> str:
    """The same verdicts in DuckDB SQL, the trained weights written out."""
    bias, w = weights()
    cases = "".join(f" WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'" for t, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])))
    what = "".join(f" WHEN '{t}' THEN '{v}'" for t, v in RULES)

    def total(mark: str, part: str) -> str:
        return f"coalesce(list_sum(list_transform(range(1, greatest(length({part}) - {GRAM - 1}, 0) + 1), lambda i: w[('0x' || substr(md5('{mark}' || substr({part}, i, {GRAM})), 1, 4))::INT % {BUCKETS} + 1])), 0)"

    return f"""WITH model AS (SELECT [{','.join(map(repr, w))}]::DOUBLE[] AS w),
split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT *, CASE{cases} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE rule{what} ELSE CASE WHEN {bias!r} + {total('h', "('^' || host || '$')")} + {total('p', 'path')} >= 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled, model"""
