import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ordix.llm import _bytes as B
from ordix.llm import jaccard_join, line_dedup, queries, substring_dedup
from ordix.llm.components import components, local
from ordix.llm.signature_tree import link, link_groups

from .. import oracle


# --- substrings ---------------------------------------------------------------


def _repeats(texts):
    data = [t.encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[max(i, end) : i + 200] = b"\1" * (i + 200 - max(i, end))
                end = i + 200
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_substrings_against_brute_force(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    a, b = noise(199), noise(260)
    texts = [noise(500) + a + "x", a + "y" + noise(40), a + "z", noise(91) + b + noise(3), noise(17) + b, b[10:230] + noise(400), "q" * 450, b[:200], noise(250)]
    texts += [texts[-1], noise(20), "", b[30:229]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == _repeats(texts)


def test_substrings_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, queries.QUERIES["op2_substring_dedup"], queries.ORACLES["op2_substring_dedup"])


def test_substrings_of_the_tables(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeats(docs).collect()}
    assert [got[i] for i in texts] == _repeats(texts.values())


def test_equal_ranks_of_different_strings_stay(monkeypatch):
    """Where all first fingerprints collide, only equal strings go."""
    monkeypatch.setattr(substring_dedup, "_window_keys", lambda t, pos, length: np.zeros(len(pos), np.uint64))
    rng, n = random.Random(7), substring_dedup.LENGTH
    a, b, c = ("".join(rng.choice("abcdef ") for _ in range(n)) for _ in range(3))
    names = [bytes([i]) * 16 for i in range(4)]
    at = [np.zeros(1, np.int32).tobytes()] * 4
    packed = list(substring_dedup._pack(iter([pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([a, c, b, c]), pa.array(at, pa.binary())], ["name", "text", "samples"])])))
    hits = []
    for k in range(substring_dedup.ROUNDS):
        sent = list(substring_dedup._send_ranks(k, 1)(iter(packed)))
        hits += substring_dedup._judge_ranks(pa.Table.from_batches(sent)).select(["bucket", "hit"]).to_pylist() if sent else []
    whole = packed[0].append_column("hits", pa.array([hits]))
    assert [x for out in substring_dedup._spans(1)(iter([whole])) for x in out.column("n_removed").to_pylist()] == [0, n, 0, n]


def test_substrings_messy(messy, empty):
    rows = substring_dedup.repeats(messy).collect()
    assert len(rows) == 9 and all(r.n_removed == 0 for r in rows if r.doc_id in (1, 2, 4, 5))
    assert substring_dedup.repeats(empty).count() == 0


# --- lines --------------------------------------------------------------------


def _line_dedup(docs):
    """(id, text) in order of id; what each keeps."""
    k = line_dedup.K
    first = {}
    for i, t in docs:
        for n, x in enumerate(t.split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                first.setdefault(x, (i, n))
    names = list(first)
    sets = [frozenset(x[j : j + k] for j in range(len(x) - k + 1)) or frozenset([x]) for x in names]
    a, b, holders = [], [], collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= line_dedup.PERCENT * (len(s) + len(sets[j]) - n):
                a.append(i)
                b.append(j)
        for x in s:
            holders[x].append(i)
    root = local(len(names), np.array(a, int), np.array(b, int))
    keeper = {}
    for i, x in enumerate(names):
        keeper[root[i]] = min(keeper.get(root[i], (1 << 60, 0)), first[x])
    at = {x: root[i] for i, x in enumerate(names)}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if x not in at or keeper[at[x]] == (i, n)) for i, t in docs}


def test_lines_of_the_tables(docs, texts):
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    want = _line_dedup(sorted(texts.items()))
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_line_query_over_the_table(spark, sf_dir, texts):
    """The registered query: its digest is that of what brute force keeps."""
    want = _line_dedup(sorted(texts.items()))
    rows = queries.QUERIES["op7_line_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, kept = texts[r.doc_id], want[r.doc_id]
        assert (r.n_lines, r.kept_sha256) == (text.count("\n") + 1, hashlib.sha256(kept.encode()).hexdigest())
        assert r.n_removed == text.count("\n") + 1 - (kept.count("\n") + 1 if kept or r.n_removed < r.n_lines else 0)


def test_bands_recall_and_long_lines():
    """Pairs at similarity 0.8 share a band; unrelated lines don't, however long they are."""
    rng, k = random.Random(6), line_dedup.K
    alphabet = "abcdefghijklmnopqrstuvwxyz      "
    found = tried = 0
    for size in (60, 200, 1000, 5000):
        for _ in range(60):
            a = [rng.choice(alphabet) for _ in range(size)]
            b, s = list(a), {tuple(a[i : i + k]) for i in range(size - k + 1)}
            while True:
                c = list(b)
                c[rng.randrange(size)] = rng.choice(alphabet)
                u = {tuple(c[i : i + k]) for i in range(size - k + 1)}
                if 100 * len(s & u) < line_dedup.PERCENT * len(s | u):
                    break
                b = c
            t = "x" + "".join(a), "x" + "".join(b)
            x = line_dedup.Lines(B.texts_of(pa.array(t)))
            one, two = x.bands(np.arange(2))
            tried, found = tried + 1, found + bool((one == two).any())
    assert found >= 0.99 * tried
    long = ["".join(rng.choice(alphabet) for _ in range(150_000)) for _ in range(4)]
    keys = line_dedup.Lines(B.texts_of(pa.array(long))).bands(np.arange(4))
    assert not any((keys[i] == keys[j]).any() for i in range(4) for j in range(i))


def test_lines_and_their_shingles_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        texts = [rng.choice([None, "".join(rng.choice("ab \t\n\n\r\x0b\x85é漢😀xyz") for _ in range(rng.randrange(0, 70)))]) for _ in range(rng.randrange(0, 6))]
        want = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b")]
        x = line_dedup.Lines(B.texts_of(pa.array(texts, pa.string())))
        got = [(d, i, x.data[a:z].tobytes().decode()) for d, i, a, z in zip(x.doc.tolist(), x.number.tolist(), x.start, x.end, strict=True)]
        assert got == want
        which = np.arange(len(want))[:: rng.choice([1, 2])]
        key, off = x.sets(which)
        of = {}
        for j, i in enumerate(which):
            line = want[i][2]
            own = key[off[j] : off[j + 1]]
            grams = {line[k : k + line_dedup.K] for k in range(max(1, len(line) - line_dedup.K + 1))}
            assert len(own) == len(grams) and (np.diff(own) > 0).all() if len(own) > 1 else len(own) == 1
            for g in grams:
                of.setdefault(g, []).append(set(own.tolist()))
        assert all(set.intersection(*sets) for sets in of.values())


def test_lines_cost_little_more_than_a_fingerprint(texts):
    """CPU seconds, against prefix sums of the same bytes on the same machine."""
    import time

    parts = [p for _, p in B.slices(pa.table({"text": pa.array(list(texts.values()), pa.large_string())}).to_batches(), "text", line_dedup.CACHE_BYTES)]

    def cost(f):
        took = []
        for _ in range(7):
            at = time.thread_time()
            for p in parts:
                f(p)
            took.append(time.thread_time() - at)
        return min(took)

    assert sum(len(p.data) for p in parts) > 100_000
    assert cost(line_dedup.Lines) < 3 * cost(B.Texts.prefix)


def test_near_lines(spark):
    base = "a line of some length that comes again with one word changed, and more " * 3
    rows = [(1, f"first\n{base}"), (2, base.replace("word", "term", 1) + "\nsecond"), (3, "first\n\n \nthird"), (4, None), (5, base)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"first\n{base}", 2: "second", 3: "\n \nthird", 4: None, 5: ""}


def test_lines_messy(messy, empty):
    out = line_dedup.dedup(messy)
    assert out.columns == messy.columns
    rows = out.collect()
    assert len(rows) == 9 and [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 4] == ["same row"] * 2
    assert line_dedup.dedup(empty).count() == 0


# --- documents ----------------------------------------------------------------


def test_jaccard_oracle(spark, sf_dir):
    oracle.check(spark, sf_dir, queries.QUERIES["op9_jaccard_join"], queries.ORACLES["op9_jaccard_join"])


def _jaccard(rows, k, percent):
    def sets(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    s = [sets(t) for _, t in rows]
    a, b = [], []
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a.append(i)
                b.append(j)
    root = local(len(rows), np.array(a, int), np.array(b, int))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    return {d: (len(s[i]), least[root[i]]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 9, 30, 120]))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(t).upper() if rng.random() < 0.3 else " \t".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components_of(df, k, percent).collect()}
    assert got == _jaccard(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_keys_meet_for_every_link(percent):
    """Whatever the order of the shingles is, as long as it is the same for all sets."""
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64))
        d = int(rng.integers(0, len(a) // 5 + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, d + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, d + 1))).astype(np.uint64)]))
        c = np.intersect1d(a, b)
        if len(b) and 100 * len(c) >= percent * (len(a) + len(b) - len(c)):
            key = np.concatenate([a, b])
            common = np.where(np.isin(key, c), key % np.uint64(5) + np.uint64(1), key % np.uint64(2) * np.uint64(3)).astype(np.uint8)
            found, of = jaccard_join.rare_first(key, np.array([0, len(a), len(a) + len(b)]), common, percent)
            assert len(np.intersect1d(found[of == 0], found[of == 1]))
            assert all((of == i).sum() <= len(x) - -(-percent * len(x) // 100) + 1 for i, x in enumerate((a, b)))
            met += 1
    assert met > 50


def test_how_common_shingles_are():
    """Counts of every chunk add up, and a shingle of one set only has 0."""
    rng = np.random.default_rng(3)
    chunks = [np.unique(rng.integers(0, 400, 200).astype(np.uint64)) << np.uint64(3) for _ in range(4)]
    many = [rng.integers(1, 4, len(x)).astype(np.uint8) for x in chunks]
    t = pa.table({"bucket": [0] * 4, "chunk": [bytes([i]) for i in range(4)], "keys": [x.astype(np.uint32).tobytes() for x in chunks], "many": [jaccard_join._counts(x) for x in many]})
    total = collections.Counter()
    for x, n in zip(chunks, many, strict=True):
        for k, m in zip(x.tolist(), n.tolist(), strict=True):
            total[k] += m
    for x, blob in zip(chunks, jaccard_join._judge(t).column("common").to_pylist(), strict=True):
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -(-len(x) // 8)), count=len(x)).astype(bool)
        got = np.zeros(len(x), int)
        got[bits] = np.frombuffer(blob, np.uint8, offset=-(-len(x) // 8))
        assert got.tolist() == [int(8 * np.log2(total[k])) if total[k] > 1 else 0 for k in x.tolist()]


def test_jaccard_messy(messy, empty):
    rows = jaccard_join.components_of(messy).collect()
    assert len(rows) == 9 and sorted(r.component_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 4, 5, 6, 7]
    assert jaccard_join.representatives(messy).columns == messy.columns
    assert jaccard_join.components_of(empty).count() == 0


def test_representatives_judge_rows_not_ids(spark):
    """An unrelated text under a shared id stays; rows that repeat id and text leave one."""
    t = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = {c: x + " end" for c, x in t.items()}
    rows = [(1, t["a"], "p"), (2, near["a"], "p"), (2, t["b"], "q"), (3, t["c"], "r"), (3, t["c"], "s"), (4, "", "t"), (4, "", "t"), (None, t["a"], "u"), (5, t["d"], "v"), (5, near["d"], "w"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in jaccard_join.representatives(df).collect())
    assert sum(got.pop((5, t[x]), 0) + got.pop((5, near[x]), 0) for x in "d") == 1
    assert got == {(1, t["a"]): 1, (2, t["b"]): 1, (3, t["c"]): 1, (4, ""): 1, (None, t["a"]): 1, (6, None): 1}


def test_tree_links_like_all_pairs():
    rng = np.random.default_rng(0)
    for n in (1, 7, 60, 150):
        base = [rng.choice(5000, int(rng.integers(1, 60)), replace=False) for _ in range(5)]
        sets = []
        for _ in range(n):
            b = base[int(rng.integers(5))]
            s = set(rng.permutation(b)[int(rng.integers(0, len(b) // 6 + 1)) :].tolist()) | set(rng.integers(0, 5000, int(rng.integers(0, 4))).tolist()) | {1}
            sets.append(np.array(sorted(s), np.uint64))
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        pairs = [(i, j) for i in range(n) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)]
        want = local(n, *(np.array(x, int) for x in (zip(*pairs, strict=True) if pairs else ([], []))))
        assert (link(np.concatenate(sets), off, 85) == want).all()


def test_small_groups_link_like_all_pairs():
    rng = np.random.default_rng(5)
    sets, group = [], []
    for g in range(40):
        base = rng.choice(300, int(rng.integers(1, 40)), replace=False)
        for _ in range(int(rng.integers(1, 12))):
            s = set(rng.permutation(base)[int(rng.integers(0, len(base) // 6 + 1)) :].tolist()) | set(rng.integers(0, 300, int(rng.integers(0, 4))).tolist()) | {1}
            sets.append(np.array(sorted(s), np.uint64))
            group.append(g)
    off, group = np.concatenate(([0], np.cumsum([len(s) for s in sets]))), np.array(group)
    side = rng.integers(0, 2, len(sets)) * (group % 3 == 0)
    apart = np.zeros(len(sets), bool)
    for g in np.unique(group[side > 0]):
        apart |= group == g
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and (not apart[i] or side[i] != side[j]) and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)]
    want = local(len(sets), *(np.array(x, int) for x in zip(*pairs, strict=True)))
    assert (link_groups(np.concatenate(sets), off, 85, group, side) == want).all()


def test_slices_of_a_large_cluster(spark, monkeypatch):
    from ordix.llm import candidates

    monkeypatch.setattr(candidates, "TILE_TOKENS", 300)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(60)] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components_of(df, 4, 70).collect()}
    assert got == _jaccard(rows, 4, 70)


def test_large_cluster_without_a_centre(spark, monkeypatch):
    """A chain that no hub holds together, dealt in ten slices; a set meets each slice at most once more than it has to."""
    from ordix.llm import candidates

    monkeypatch.setattr(candidates, "TILE_TOKENS", 400)
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 40))) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{j}" for j in range(40)) + " " + f"x{i} " * 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components_of(df, 2, 80).collect()}
    assert got == _jaccard(rows, 2, 80)


@pytest.mark.parametrize("finish", [1_000_000, 20])
def test_components_of_chains_and_stars(spark, monkeypatch, finish):
    from ordix.llm import components as c

    monkeypatch.setattr(c, "FINISH", finish)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}
    assert components(df.limit(0)).count() == 0
