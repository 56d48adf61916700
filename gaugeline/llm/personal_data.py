r"""Personal data by weak supervision (operator 1).

The base kinds, e-mail addresses, IP addresses, card and phone numbers, are found by fixed patterns.
What no pattern defines, credentials, is found by the method: runs of letters and digits are
candidates; labelers that know patterns, gazetteers and contexts vote for, against or not at all;
expectation-maximisation estimates how reliable each is, from agreement alone; and a logistic span
classifier is trained on the resulting probabilities.  Candidates it accepts are added as ``secret``.

Texts go through DataFrame operations only.  What the driver sees are counts by vote pattern and
feature pattern, whose number is bounded whatever the size of the table; the statistics cover every candidate.

Positions are code points.  Spark gives matches without positions, so they are summed from the
lengths of the parts between: sums run over blocks of about the square root of their number, so
a text with very many matches takes time in proportion to the 1.5th power.  Patterns are written
so that a match never starts within a run that has already failed, and repeat groups possessively.

A null text is empty; an empty table gives an empty result; repeated rows are treated alike; other
columns are carried under the struct ``row`` by ``found``.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CANDIDATE = r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+"

#: The gazetteers: words that announce a credential, words that announce a number of no concern, and
#: beginnings that issuers give their keys.
ANNOUNCE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "access key", "private key", "bearer", "authorization", "credential")
HARMLESS = ("version", "license", "isbn", "issn", "chapter", "section", "page", "figure", "table", "commit", "sha256", "md5", "checksum", "doi", "http", "www", "serial")
ISSUED = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "ya29", "eyJ")
#: The shortest candidate.
SHORTEST = 8
LABELERS = ("pattern", "issuer", "context", "harmless", "mixture", "plain")


def matches(docs: DataFrame, name: str, pattern: str, among: Column) -> DataFrame:
    """Adds ``name``: every match of ``pattern`` in column t as (start, text, before, after)."""
    m, s, z, b = (f"{name}_{x}" for x in "mszb")
    p = F.lit(pattern)
    none = F.array().cast("array<string>")
    x = docs.withColumn(m, F.when(among, F.regexp_extract_all("t", p, F.lit(0))).otherwise(none))
    x = x.withColumn(s, F.when(F.size(m) > 0, F.split("t", pattern, -1)).otherwise(none))
    x = x.withColumn(z, F.transform(m, lambda v, i: F.length(F.get(s, i)) + F.length(v)))
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(z))).cast("int"))
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, e: a + e)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / block).cast("int")), lambda k: total(F.slice(z, F.lit(1), k * block)))
    x = x.withColumn(b, blocks)
    nth = lambda i: F.floor(i / block).cast("int")
    start = lambda v, i: F.get(b, nth(i)) + total(F.slice(z, nth(i) * block + 1, i - nth(i) * block + 1)) - F.length(v)
    near = lambda i: (F.right(F.get(s, i), F.lit(32)).alias("before"), F.left(F.get(s, i + 1), F.lit(1)).alias("after"))
    # sizes are asked for so that b, s and z are made once: a column met once, in a lambda, is inlined there
    ready = (F.size(b) > 0) & (F.size(s) > 0) & (F.size(z) > 0)
    x = x.withColumn(name, F.when(ready, F.transform(m, lambda v, i: F.struct(start(v, i).alias("start"), v.alias("text"), *near(i)))).otherwise(F.array().cast("array<struct<start:int,text:string,before:string,after:string>>")))
    return x.drop(m, s, z, b)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(worth(i) > 9, worth(i) - 9).otherwise(worth(i))) % 10 == 0


def _holds(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        d = _digits(text)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _span(kind: str, x: Column) -> Column:
    start = x["start"]
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x["text"])).alias("end"))


def _spans(kind: str) -> Column:
    return F.transform(F.filter(kind, lambda m: _holds(kind, m["text"])), lambda m: _span(kind, m))


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 none."""
    text, before = x["text"], F.lower(x["before"])
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    return {
        "pattern": vote(text.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,})$") & text.rlike("[A-Za-z]"), F.length(text) < 12),
        "issuer": vote(text.rlike(f"^(?:{_any(ISSUED)})")),
        "context": vote(before.rlike(rf"(?:{_any(ANNOUNCE)})[\x20\"':=]*$"), (x["after"] == "@") | before.rlike("@$")),
        "harmless": vote(F.lit(False), before.rlike(rf"(?:{_any(HARMLESS)})[^a-z]*$")),
        "mixture": vote((_turns(text) >= 4) & (F.length(text) >= 12), _turns(text) < 2),
        "plain": vote(F.lit(False), ~text.rlike("[A-Za-z]") | text.rlike("^[0-9]{1,4}[-/][0-9A-Za-z]{1,4}[-/][0-9]{1,4}$")),
    }


def _turns(text: Column) -> Column:
    return F.size(F.split(text, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)) - 1


def features(x: Column) -> dict[str, Column]:
    """Small whole numbers that the classifier sees of a candidate."""
    text, before = x["text"], F.lower(x["before"])
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "length": F.least(F.lit(4), F.floor(F.length(text) / 8)).cast("int"),
        "digits": F.floor(4 * F.length(_digits(text)) / F.length(text)).cast("int"),
        "upper": flag(text.rlike("[A-Z]")),
        "lower": flag(text.rlike("[a-z]")),
        "hex": flag(text.rlike("^[0-9A-Fa-f]+$")),
        "turns": F.least(F.lit(3), F.floor(_turns(text) / 2)).cast("int"),
        "signs": flag(text.rlike("[_+/-]")),
        "assigned": flag(before.rlike(r"[=:][\x20\"']*$")),
    }


#: The values of each feature but the first, which the constant stands for.
LEVELS = {"length": range(2, 5), "digits": range(1, 5), "upper": (1,), "lower": (1,), "hex": (1,), "turns": range(1, 4), "signs": (1,), "assigned": (1,)}


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | class) for each labeler, as [labeler, class, vote + 1], and P(1 | pattern).

    Votes are taken as independent given the class.  The start is the balance of the votes.
    """
    post = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1) + 0.5))
    table_ = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for j, v in itertools.product(range(patterns.shape[1]), range(3)):
            table_[j, :, v] = weight[:, patterns[:, j] == v - 1].sum(axis=1) + 0.1
        table_ /= table_.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table_[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return table_, post


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant last, for probabilities as targets (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row, t and ``candidate``, the runs long enough to be judged."""
    rest = [c for c in docs.columns if c != "doc_id"]
    x = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    x = x.withColumn("t", text_of("row.text"))
    x = matches(x, "candidate", CANDIDATE, F.col("t").rlike("[0-9]"))
    return x.withColumn("candidate", F.filter("candidate", lambda c: F.length(c["text"]) >= SHORTEST))


def train(docs: DataFrame) -> dict[tuple[str, int], float] | None:
    """The classifier's coefficients, or None where no candidate is likely to be a secret."""
    # explode() would have a filter inferred, which is pushed down and inlines all that is above into lambdas
    one = candidates(docs.select("doc_id", "text")).select(F.explode_outer("candidate").alias("c")).filter("c IS NOT NULL")
    x = F.col("c")
    rows = one.select(*[v.alias(f"v_{n}") for n, v in votes(x).items()], *[f.alias(f"f_{n}") for n, f in features(x).items()])
    tally = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as patterns
    if not tally:
        return None
    tally.sort(key=tuple)
    patterns = np.array([[r[f"v_{n}"] for n in LABELERS] for r in tally])
    counts = np.array([r["n"] for r in tally], dtype=float)
    _, post = reliabilities(patterns, counts)
    # a class that the votes speak against on balance is not one of secrets
    if (post * counts).sum() < 0.5 or ((post > 0.5) & (patterns.sum(axis=1) > 0)).sum() == 0:
        return None
    names = [(n, v) for n, levels in LEVELS.items() for v in levels]
    seen = np.array([[float(r[f"f_{n}"] == v) for n, v in names] for r in tally])
    w = logistic(seen, post, counts)
    return {**dict(zip(names, w[:-1].tolist())), ("constant", 0): float(w[-1])}


def accepts(model: dict[tuple[str, int], float] | None, x: Column) -> Column:
    if model is None:
        return F.lit(False)
    seen = features(x)
    score = F.lit(model["constant", 0])
    for (name, value), w in model.items():
        if name != "constant":
            score = score + F.when(seen[name] == value, w).otherwise(0.0)
    return score > 0


def found(docs: DataFrame) -> DataFrame:
    """doc_id, row, ``base`` and ``added``: arrays of (start, kind, end)."""
    model = train(docs)
    x = candidates(docs)
    x = matches(x, "email", EMAIL, F.col("t").contains("@"))
    number = F.col("t").rlike("[0-9]")
    x = matches(x, "ip", IP, number & F.col("t").rlike(r"[0-9]\.[0-9]"))
    x = matches(x, "card", CARD, number)
    x = matches(x, "phone", PHONE, F.col("t").rlike(r"\+[0-9]"))
    x = x.drop("t")
    for kind in KINDS[:4]:
        x = x.withColumn(kind, _spans(kind))
    base = F.array_sort(F.concat(*KINDS[:4]))
    added = F.transform(F.filter("candidate", lambda m: accepts(model, m)), lambda m: _span("secret", m))
    return x.select("doc_id", "row", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], base.alias("base"), added.alias("added"))


def shown(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = found(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in KINDS[:4]]
    every = F.array_sort(F.concat("base", "added"))
    return x.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(every).alias("spans"))
