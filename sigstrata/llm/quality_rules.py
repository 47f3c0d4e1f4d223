"""Quality rules under weak supervision: rules vote or abstain, EM estimates their accuracies.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) from statistics of the whole text. A document's votes
form one of 3**len(RULES) patterns. EM runs on the counts of patterns over all documents, which are
bounded whatever the corpus: a naive Bayes model with each rule's chance of each vote by class, and a class prior. A document
is kept if its posterior probability of being good is at least KEEP and the base rule does not fail it.

Words are runs of other than the six ASCII white-space characters. Null text counts as empty: no words,
base_failed true, kept false. Repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigstrata.llm.common import map_texts, row

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
KEEP = 0.5

FIELDS = [
    T.StructField(n, T.LongType())
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes")
]
#: Each rule compares one ratio of counts with two bounds, between which it abstains (see measure).
RULES = ("length", "symbols", "repeats", "dup_lines", "capitals", "shouts", "word_length", "variety", "marks")


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words of 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    key = ids[:-2] * distinct + ids[1:-1]
    if distinct > 2_000_000:  # the key of three would overflow
        key = np.unique(key, return_inverse=True)[1]
    _, inverse, counts = np.unique(key * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def vote(bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the ASCII white space
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeated(ids, len(seen))
    upper = sum(1 for w in words if w.isupper() and len(w) > 2)
    shouts = text.count("!")
    marks = symbols + text.count("!") + text.count("=") + text.count("_")
    m = max(n, 1)
    mean = word_chars / m
    votes = (
        vote(n < 25, n >= 60),
        vote(symbols > 0.1 * m, symbols < 0.03 * m),
        vote(rep > 0.4 * m, rep < 0.25 * m),
        vote(dup > 0.5 * max(len(lines), 1), dup == 0),
        vote(upper > 0.2 * m, upper < 0.08 * m),
        vote(shouts > 0.1 * m, shouts < 0.03 * m),
        vote(not 2.2 <= mean <= 15, 3 <= mean <= 11),
        vote(n >= 50 and len(seen) < 0.2 * min(n, 400), len(seen) > 0.3 * min(n, 400)),
        vote(marks > 0.08 * max(word_chars, 1), marks < 0.02 * max(word_chars, 1)),
    )
    code = 0
    for v in votes:
        code = code * 3 + v
    return n, word_chars, symbols, dup, rep, code


def _measured(texts: list) -> list:
    return list(map(list, zip(*map(measure, texts), strict=True))) if texts else [[] for _ in FIELDS]


def measured(docs: DataFrame, keep: list[str] | None = None, column: str = "text") -> DataFrame:
    return map_texts(docs, _measured, FIELDS, column=column, keep=keep)


def fit(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior probability of good for each vote pattern, by EM over counts of patterns."""
    if not patterns:
        return {}
    codes = np.array(sorted(patterns), dtype=np.int64)
    weight = np.array([patterns[c] for c in codes.tolist()], dtype=float)
    votes = np.stack([codes // 3 ** (len(RULES) - 1 - j) % 3 - 1 for j in range(len(RULES))], axis=1)
    is_vote = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    post = 0.97 * 0.25 ** (votes < 0).sum(axis=1)  # start: the more bad votes, the less likely good
    for _ in range(rounds):
        # chance of each vote (and of abstaining) by class and rule; pseudo-votes hold rules that hardly vote
        good, bad = (
            (np.einsum("p,prv->rv", c * weight, is_vote) + a) / ((c * weight).sum() + sum(a))
            for c, a in ((post, (0.5, 1.0, 8.5)), (1 - post, (4.0, 2.0, 4.0)))
        )
        # a bad vote never speaks for good, nor a good vote for bad
        lift = np.log(good) - np.log(bad)
        lift[:, 0], lift[:, 2] = np.minimum(lift[:, 0], 0), np.maximum(lift[:, 2], 0)
        prior = np.clip((post * weight).sum() / weight.sum(), 0.05, 0.95)
        odds = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", is_vote, lift)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def posteriors(stats: DataFrame) -> dict[int, float]:
    """Fit over all documents; at most 3**len(RULES) counts come to the driver."""
    return fit({r["votes"]: r["count"] for r in stats.groupBy("votes").count().collect()})


def verdicts(post: dict[int, float]) -> tuple[Column, Column, Column]:
    """base_failed, posterior and kept, as columns over FIELDS. The posteriors are one constant array by pattern."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    every = ",".join(repr(post.get(c, 0.0)) for c in range(3 ** len(RULES))) if post else "0.0"
    value = F.try_element_at(F.split(F.lit(every), ",").cast("array<double>"), (F.col("votes") + 1).cast("int"))
    posterior = F.coalesce(value, F.lit(0.0))
    return failed, posterior, ~failed & (posterior >= KEEP)


def judge_documents(docs: DataFrame, write) -> DataFrame:
    """Statistics and verdict of every document; write(df) makes a table that is read twice (it holds no text)."""
    stats = write(measured(docs.select("doc_id", "text"), keep=["doc_id"]))
    failed, posterior, kept = verdicts(posteriors(stats))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), posterior.alias("posterior"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Texts are measured in two passes instead of written out."""
    post = posteriors(measured(docs.select("text"), keep=[]))
    return measured(row(docs), column="row.text").where(verdicts(post)[2]).select("row.*")
