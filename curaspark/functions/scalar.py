"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(name) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(_c(name), "(?<=.)\\.[^.]*$", "")


def suffix(name) -> Column:
    """Last suffix with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(_c(name), "[^/](\\.[^./]*)$", 1))


def slug(class_id, label) -> Column:
    """class_id and the label in lower case with runs of other signs as one underscore."""
    body = F.trim(F.regexp_replace(F.lower(_c(label)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.lower(_c(class_id)), body)


def strict_boolean(c) -> Column:
    """true/false/1/0 (trimmed, any case) to boolean; anything else but null fails the query."""
    t = F.lower(F.trim(_c(c).cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean")
    return F.when(t.isNull(), F.lit(None).cast("boolean")).when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(bad)


def is_sha256(c) -> Column:
    return F.coalesce(_c(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def human_size(n) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    n, out = _c(n).cast("double"), None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string(f"%.1f {unit}", n / 1024**k)
        out = F.when(n < 1024 ** (k + 1), text) if out is None else out.when(n < 1024 ** (k + 1), text) if unit != "TB" else out.otherwise(text)
    return out


def safe_relative_path(mode, split, folder, filename) -> Column:
    """mode/split/folder/filename; a file name that could leave its folder fails the query."""
    name = _c(filename)
    unsafe = name.isNull() | name.isin("", ".", "..") | name.contains("/") | name.contains("\\")
    return F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe file name: "), F.coalesce(name, F.lit("null")))).cast("string")).otherwise(F.concat_ws("/", _c(mode), _c(split), _c(folder), name))


def split_rank(c) -> Column:
    """Place of a split in train, val, test; an unknown one fails the query."""
    out = F.when(F.lit(False), 0)
    for name, k in SPLIT_ORDER.items():
        out = out.when(_c(c) == name, k)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(_c(c), F.lit("null")))).cast("int"))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v) -> Column:
    """Vector of length 1; a zero, empty or non-finite one fails the query."""
    n = norm(v)
    bad = F.raise_error(F.lit("vector is zero or not finite")).cast("array<double>")
    return F.when((n > 0) & (n < float("inf")), F.transform(_c(v), lambda x: x.cast("double") / n)).otherwise(bad)


def evaluation_label(training, evaluation) -> Column:
    """How a report names what was learned from and what was judged."""
    return F.concat_ws(" → ", _c(training), _c(evaluation))


def training_relation(training, evaluation) -> Column:
    return F.when(_c(training).contains("+"), "combined").when(_c(training) == _c(evaluation), "within_domain").otherwise("cross_domain")
