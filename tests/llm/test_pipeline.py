"""The pipeline's stages one after the other against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigstrata.llm import mixing, quality_rules
from sigstrata.llm.common import find, materialize, union

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        counts.append(docs.count())
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judge_documents(before, materialize).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "secret_scan":
            assert counts[-1] == counts[-2]
        if name == "mixing":  # what is short of its share stays, and may repeat
            names = sorted(corpus_pipeline.MIX)
            model = mixing.Classifier.fit(before, mixing.domains(spark.read.parquet(f"{SF}/labels.parquet")), names)
            sure = {r.doc_id for r in model.apply(before).where(F.element_at("p", 1 + names.index("good")) > 0.8).collect()}
            assert sure <= {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[5] == counts[4]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_mix_meets_its_shares(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    names = sorted(corpus_pipeline.MIX)
    model = mixing.Classifier.fit(docs, mixing.domains(labels), names)
    mixed = materialize(corpus_pipeline.mix(spark, docs, sf))
    got = model.apply(mixed).select("n", "p").toPandas()
    tokens = got["n"].to_numpy() @ np.array(got["p"].tolist())
    assert np.abs(tokens / tokens.sum() - [corpus_pipeline.MIX[n] for n in names]).max() < 0.01


def test_unreachable_shares_are_told(spark, caplog):
    scored = spark.createDataFrame([(10.0, [0.5, 0.5])] * 4, "n double, p array<double>")
    rates = mixing.Rates.fit(scored, np.array([0.9, 0.1]), floor=1.0)
    assert "not meet the weights" in caplog.text and not rates.move.any()
    with pytest.raises(ValueError, match="weights"):
        mixing.Rates.fit(scored, np.array([0.9, 0.1]), strict=True)


def brute_kept(rows, words=5):
    """Ids that stay if texts of Jaccard similarity 4/5 and more, on sets of 5-word shingles, are linked."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent, holders, links = np.arange(len(rows)), {}, 0
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders.get(x, ()))
        near = [j for j, n in common.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        near += [j for j in range(i) if not s and not sets[j]][:1]
        union(parent, np.full(len(near), i), np.array(near, dtype=np.int64))
        links += len(near)
        for x in s:
            holders.setdefault(x, []).append(i)
    root = find(parent, np.arange(len(rows)))
    low = {}
    for (d, _), r in zip(rows, root.tolist(), strict=True):
        low[r] = min(low.get(r, d), d)
    return sorted(low.values()), links


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    for size, edits in ((100, 1), (100, 2), (200, 4), (300, 6), (300, 7), (200, 5), (100, 3), (60, 1), (60, 2)):
        for _ in range(12):  # from near copies to pairs just below the similarity
            base = fresh(size)
            copy = list(base)
            for at in rng.choice(size, edits, replace=False):
                copy[at] = "changed"
            rows += [(10**6 + len(rows), " ".join(base)), (10**6 + len(rows) + 1, " ".join(copy))]
    base = fresh(120)
    for _ in range(150):  # one large group, where copies need not be similar to each other
        copy = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            copy[at] = fresh(1)[0]
        rows.append((10**6 + len(rows), " ".join(copy)))
    line = fresh(80)
    rows += [(10**6 + len(rows) + i, " ".join(line + fresh(60))) for i in range(60)]  # a common passage, not similar
    rows += [(10**7 + i, t) for i, t in enumerate((None, "", " \n", "a", "A", "a b", "É", "é"))]
    want, links = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert links > 500 and got == want
    odd = spark.createDataFrame([(None, rows[0][1]), (1, "x y"), (1, "x y"), (2, "X y")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, odd, SF).collect()) == ["1", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
