import re

import pytest

from ordix.llm import license_scan as L
from ordix.llm import queries

from .. import oracle


def test_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, queries.QUERIES["op1_license_scan"], queries.ORACLES["op1_license_scan"])


def _places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for p, label in L.PHRASES.items():
        p = p.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_phrases_across_blocks(spark):
    texts = []
    for at in (0, 1, 60, 61, 62, 63, 64, 65, 126, 127, 128, 129, 500):
        texts.append("x " * at + "GNU General-Public\nLicense cc by cc by MIT license, apache LICENSE" + " y" * (at % 7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df).collect():
        n, places = _places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places)) and r.n_base == 5
        assert (r.first_word, r.last_word) == (places[0][0], places[-1][0])
        assert r.base_labels == "apache,cc-by,gpl,mit" and r.score == 1.0 and set(r.base_labels.split(",")) <= set(r.labels.split(","))


def test_notice_by_containment(spark):
    t = L.NOTICES["bsd-text"].split()
    df = spark.createDataFrame([(0, " ".join(t[3:])), (1, " ".join(t[:8])), (2, " ".join(reversed(t)))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.scan(df).collect()}
    assert got == {0: "bsd-text", 1: "", 2: "bsd-text"}


def test_own_templates(spark):
    notice = "You may COPY this corpus, provided that its authors are named."
    own = L.templates_of({"corpus": notice})
    df = spark.createDataFrame([(0, "x " * 70 + notice + " y" * 9), (1, "you may copy this corpus"), (2, "mit license")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in L.scan(df, templates=own).collect()} == {0: "corpus", 1: "", 2: "mit"}
    with pytest.raises(ValueError):
        L.templates_of({"long": "w " * 66})
    assert all(len(t.words) <= L.WIDTH - L.STRIDE + 1 for t in L.TEMPLATES)


def test_messy(messy, empty):
    rows = L.scan(messy).collect()
    assert len(rows) == 9 and all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0 for r in rows)
    assert L.scan(empty).count() == 0


def test_plan_runs_no_python(docs):
    plan = L.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
