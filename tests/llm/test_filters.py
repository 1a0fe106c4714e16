import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from ordix.llm import _bytes as B
from ordix.llm import decontaminate, pii, quality, queries

from .. import oracle


# --- quality ------------------------------------------------------------------


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def _fields(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_quality_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, queries.QUERIES["op4_quality_rules"], queries.ORACLES["op4_quality_rules"])


def test_base_rules(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_rules"](spark, sf_dir).collect()}
    for i, t in texts.items():
        assert _fields(got[i]) == _base(t)
        assert not (got[i].kept and got[i].base_failed)


def test_score_against_brute_force(spark, sf_dir, docs, texts):
    import math

    trusted = {r.doc_id for r in quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    raw, target = [1] * (1 << quality.BITS), [1] * (1 << quality.BITS)

    def buckets(t):
        b = t.encode()
        return [((int.from_bytes(b[i : i + quality.N], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - quality.BITS) for i in range(len(b) - quality.N + 1)]

    for i, t in texts.items():
        for k in buckets(t):
            raw[k] += 1
            target[k] += i in trusted
    ratio = [math.log(a / sum_a) - math.log(b / sum_b) for sum_a, sum_b in [(sum(target), sum(raw))] for a, b in zip(target, raw, strict=True)]
    got = {r.doc_id: r.score for r in queries.QUERIES["op4_quality_rules"](spark, sf_dir).collect()}
    for i, t in texts.items():
        own = [ratio[k] for k in buckets(t)]
        assert got[i] == pytest.approx(sum(own) / len(own) if own else 0, abs=1e-5)


def test_clean_labelled_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.QUERIES["op4_quality_rules"](spark, sf_dir).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_ids_of_any_type(spark, docs, sf_dir):
    """String ids choose the same trusted documents as the integers do."""
    labels = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    a, b = quality.fit(docs, labels), quality.fit(named, labels.selectExpr("concat('d', doc_id)"))
    assert (a == b).all() and a.any()
    assert quality.score(named, b).where("doc_id LIKE 'd%'").count() == docs.count()


@pytest.mark.parametrize("words", [1 << 17, 1])
def test_every_trusted_id_is_in_the_target(spark, docs, monkeypatch, words):
    """However many there are, and whatever a full filter lets by."""
    from ordix.llm import candidates

    monkeypatch.setattr(candidates, "FILTER_WORDS", words)
    own = docs.where("doc_id % 2 = 0").select("doc_id")
    many = quality.fit(docs, own.union(spark.range(10_000_000, 10_300_000)))
    assert many.any() and (many == quality.fit(docs, own)).all()
    raw, target = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for r in docs.collect():
        n = quality._counts(B.texts_of(pa.array([r.text or ""])))
        raw += n
        target += n * (r.doc_id % 2 == 0)
    raw, target = raw + 1, target + 1
    assert (many == np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * quality.SCALE)).all()


def test_quality_messy(spark, messy, empty):
    trusted = spark.createDataFrame([(1,), (None,), (3,), (3,)], "doc_id long")
    ratio = quality.fit(messy, trusted)
    rows = quality.score(messy, ratio).collect()
    assert len(rows) == 9 and all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (1, 2, 5))
    assert quality.keep(messy, ratio).columns == messy.columns
    none = quality.fit(empty, trusted.limit(0))
    assert not none.any() and quality.score(empty, none).count() == 0


# --- benchmark ----------------------------------------------------------------


def test_decontamination_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, queries.QUERIES["op5_decontaminate"], queries.ORACLES["op5_decontaminate"])


BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, ""), (10, "two three four five six seven eight nine ten eleven"), (2, "short ITEM!"), (None, "odd one")]


def test_short_items_blocks_and_matches(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One, two three four five six seven eight nine ten ELEVEN y"), (2, "a short-item b short item"), (3, "short"), (4, None), (5, "item short odd one"), (6, "one two three four five six seven eight nine x ten")], "doc_id long, text string")
    want = {1: (13, 11, ["1", "10"]), 2: (6, 4, ["2"]), 3: (1, 0, []), 4: (0, 0, []), 5: (4, 2, [""]), 6: (11, 0, [])}
    for size in (decontaminate.BLOCK_BYTES, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        index = decontaminate.blocks(bench)
        got = {r.doc_id: r for r in decontaminate.report(docs, index).collect()}
        for i, (n, hit, items) in want.items():
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(items), hit > 0)
            assert got[i].items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert sorted(r.doc_id for r in decontaminate.clean(docs, index).collect()) == [3, 4, 6]
        found = {tuple(r) for r in decontaminate.matches(docs, index).where("doc_id = 1").collect()}
        assert found == {(1, "1", 1, 0, 11), (1, "10", 2, 0, 10)}
        assert {i: r.longest for i, r in got.items()} == {1: 11, 2: 2, 3: 0, 4: 0, 5: 2, 6: 0}


@pytest.mark.parametrize("held", [0, 4])
def test_longest_matches_against_brute_force(spark, monkeypatch, held):
    """Every maximal run of equal words of a document and an item, of ten or of a whole shorter item."""
    import random

    monkeypatch.setattr(decontaminate, "HELD", held)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([3, 14, 40])))) for i in range(12)]
    docs = []
    for d in range(40):
        w = [rng.choice("abcx") for _ in range(30)]
        for _, t in rng.sample(bench, 2):
            own = t.split()
            a = rng.randrange(len(own))
            w[(at := rng.randrange(len(w))) : at] = own[a : a + rng.randrange(1, 30)]
        docs.append((d, " ".join(w)))
    want = set()
    for d, t in docs:
        w = t.split()
        for i, u in bench:
            v = u.split()
            need = min(len(v), decontaminate.N)
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= need and not (a and b and w[a - 1] == v[b - 1]):
                        want.add((d, str(i), a, b, n))
    index = decontaminate.blocks(spark.createDataFrame(bench, "item_id long, text string"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(index) > 1 and {tuple(r) for r in decontaminate.matches(df, index).collect()} == want
    longest = {d: max((m[4] for m in want if m[0] == d), default=0) for d, _ in docs}
    assert {r.doc_id: r.longest for r in decontaminate.report(df, index).collect()} == longest


def test_decontamination_messy(spark, messy, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.report(messy, decontaminate.blocks(bench)).count() == 9
    assert decontaminate.report(messy, decontaminate.blocks(bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.clean(messy, decontaminate.blocks(bench.limit(0))).count() == 9
    assert decontaminate.report(empty, decontaminate.blocks(bench)).count() == 0


# --- personal data --------------------------------------------------------------


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def _brute(text):
    n = lambda s: sum(c in "0123456789" for c in s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= n(s) <= 19 and _luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= n(s) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


def test_base_spans_equal_the_patterns(texts):
    import random

    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "255.256.1.1", "+1 (555) 555-0100", "+", " ", "-", "x", "é", "a.b%c@d-e.f.g", "4417744280351547", "0", "..", "@x.y", "漢", "+44"]
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    for t in [*cases, *texts.values()]:
        got = pii.spans(t)
        assert {k: got[k] for k in pii.BASE} == _brute(t), t


def test_own_spans_and_redaction():
    t = 'see https://x.y/z. My account number: AB-12345678, token = "cb1a9fee807a0536" mail me@x.org'
    found = pii.spans(t)
    assert [t[a:z] for a, z in found["url"]] == ["https://x.y/z"]
    assert [t[a:z] for a, z in found["account"]] == ["AB-12345678"] and [t[a:z] for a, z in found["secret"]] == ["cb1a9fee807a0536"]
    assert pii.redacted(t, found) == 'see [URL]. My account number: [ACCOUNT], token = "[SECRET]" mail [EMAIL]'


def test_long_numbers_and_long_blanks_are_quick():
    import time

    began = time.perf_counter()
    assert pii.spans("0" * 5000 + ".1.1.1")["ip"] == [(0, 5006)] and not pii.spans("9" * 5000 + ".1.1.1")["ip"]
    for t in ("account" + " " * 400_000 + "x", "account number" + " " * 400_000, "token" + "\n" * 400_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "ssn " * 100_000, "http:" * 100_000, "http://" * 100_000, "mailto:" * 100_000 + ")" * 100_000, "mailto:@" * 100_000):
        pii.spans(t)
    assert time.perf_counter() - began < 20


#: Text around a planted value, and its kind; what is planted is between the braces.
PLANTED = {
    "email": ["write to {jane.doe+x@mail.example.org}.", "<{a_b%c@x-y.de}>"],
    "ip": ["host {10.0.254.7} is down", "from {192.168.000.001}:80"],
    "card": ["card {4111 1111 1111 1111}!", "paid ({5500-0000-0000-0004})"],
    "phone": ["call {+1 (555) 555-0100} now", "tel: {+44 20 7946 0958}"],
    "account": ["account number: {DE-4417744}", "SSN {078-05-1120}.", "IBAN: {DE89370400440532013000}", "Passport No. {X1234567}", "customer id = {8812345}"],
    "secret": ['api_key = "{cb1a9fee807a0536}"', "password: {hunter2hunter2}", "Token={ghp_0a1b2c3d4e5f}"],
    "url": ["see {https://x.org/a?b=1}.", "{mailto:me@x.org}", "ssh at {ssh://git@x.org/r}"],
}


@pytest.mark.parametrize("kind", list(PLANTED))
def test_every_kind_is_found_in_prose(texts, kind):
    """Recall by kind over `spans`: each planted value is a span of its kind, exactly."""
    import random

    rng, prose = random.Random(kind), [t for t in texts.values() if len(t) > 200]
    for _ in range(200):
        t, form = rng.choice(prose), rng.choice(PLANTED[kind])
        at = t.find(" ", rng.randrange(len(t) - 100))
        value = form[form.index("{") + 1 : form.index("}")]
        before = t[:at] + " " + form[: form.index("{")]
        own = pii.spans(before + value + form[form.index("}") + 1 :] + t[at:])
        assert (len(before), len(before) + len(value)) in own[kind], form


def test_cues_and_schemes_in_any_case():
    cues = ["Social Security", "SOCIAL security", "Customer ID", "User ID", "Tax ID", "Driver License", "sSn", "Account Number", "PASSPORT NO"]
    for cue in cues:
        t = f"é İ {cue}: 4417-7442 end"
        assert [t[a:z] for a, z in pii.spans(t)["account"]] == ["4417-7442"], cue
    for cue in ["API key", "Api Key", "Api_Key", "ApiKey", "PassWord", "Access_Key"]:
        t = f"é İ {cue} = cb1a9fee807a0536"
        assert [t[a:z] for a, z in pii.spans(t)["secret"]] == ["cb1a9fee807a0536"], cue
    for link in ["HTTPS://x.y/Z", "Http://x.y/Z", "MailTo:Me@x.org"]:
        t = f"é İ {link} end"
        assert [t[a:z] for a, z in pii.spans(t)["url"]] == [link]
    t = "Customer ID: 12345678, see HTTPS://x.y/z"
    assert pii.redacted(t, pii.spans(t)) == "Customer ID: [ACCOUNT], see [URL]"


def test_scan(spark, sf_dir, texts, messy, empty):
    for r in queries.QUERIES["op6_pii"](spark, sf_dir).collect():
        want = _brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{z}" for k in pii.BASE for a, z in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
    assert pii.scan(messy, redact=True).count() == 9 and pii.scan(empty).count() == 0
