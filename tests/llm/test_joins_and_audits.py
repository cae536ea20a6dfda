"""Filter audit, tokenizer alignment and the n-gram join against brute force, and over the awkward cases."""

import hashlib
import itertools
import random
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import alignment, filter_audit, ngram_join
from gridlark.llm.common import settings
from gridlark.llm.queries import ORACLES

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "same text of a few words here"), (5, "same text of a few words here"), (5, "same text of a few words here"),
    (None, "no id"), (None, "same text of a few words here"), (6, "é" * 3 + " ünï 😀 code"), (7, "long " * 30_000), (8, "\n\n"), (9, "x" * 5000), (10, "SHOUT #1 " * 300),
    (11, "a ▁ sign"), (12, "<|endoftext|> and <s> are text"), (13, "four words are few"), (14, "FOUR words are few"),
]
CLASHES = ("_id", "_at", "t", "t1", "n", "mask", "part", "pairs", "keys", "group", "root", "count", "id", "quality")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 2}") for k, (i, t) in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1), (10, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("good", F.lit("y"))


def words_of(text):
    return (text or "").encode().split()  # bytes: parted by ASCII white space only


# ---- 11 ------------------------------------------------------------------------------------------------------------------


def slow_audit(docs, labels):
    """Every order applied to the documents themselves, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t, w = text or "", words_of(text)
        fails = "".join(
            f for f, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t),
                i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
            )) if bad
        )
        rows.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                hit = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                redundant = sum(f in r[1] for r in gone)
                gone += hit
                only = sum(r[0] == part and r[1] == f for r in rows)
                out[part, "".join(order), k + 1] = [len(alive), len(hit), redundant, only, sum(r[2] for r in hit), sum(r[3] for r in hit)]
                shapley[part, f] += len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_awkward_rows(awkward, marks):
    docs = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in marks.collect()]
    got = audited(filter_audit.audit(awkward, marks))
    assert got == slow_audit(docs, labels) and len(got) == 600 * len({s or "" for _, _, s in docs})
    assert filter_audit.audit(awkward.where("1 = 0"), marks).count() == 0
    assert filter_audit.audit(awkward, marks.where("1 = 0")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_random_rows(spark):
    rng = random.Random(11)
    vocabulary = ["word", "Other", "LOUD", "#tag", "plain", "text", *(f"w{k}" for k in range(300))]
    docs = []
    for i in range(150):
        some = rng.sample(vocabulary, rng.choice([3, 60, 300]))
        docs.append((rng.randrange(120), " ".join(rng.choices(some, k=rng.choice([0, 150, 199, 200, 260]))) if rng.random() < 0.8 else "copy", rng.choice(["a", "b", None, ""])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)]
    a = spark.createDataFrame(docs, "doc_id long, text string, source string")
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(a, b))
    assert got == slow_audit(docs, labels)
    con = duckdb.connect()
    con.register("documents", a.toPandas())
    con.register("labels", b.toPandas())
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op11_filter_audit']})").fetchall()
    assert {r[:3]: r[3:] for r in want} == got


def test_lattice():
    assert len(set(filter_audit.lattice_edges())) == 80


# ---- 12 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return alignment.sides(alignment.files())


def slow_alignment(both, texts):
    """Each text in one piece; groups and links by walking along the bytes."""
    a, b = both
    rows, links = [], []
    for t in texts:
        ids = [list(side.encode([t])[0]) for side in both] if t else [[], []]
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(side.entries[k] for k in x) != whole for side, x in zip(both, ids)):
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        found, mine, run, at = [], [], ([], []), [0, 0]
        queues = [list(x) for x in ids]
        while queues[0] or queues[1]:
            side = 0 if at[0] <= at[1] and queues[0] else 1
            k = queues[side].pop(0)
            at[side] += len(both[side].entries[k])
            run[side].append(k)
            if at[0] == at[1]:
                mine.append(",".join(map(str, run[0])) + "|" + ",".join(map(str, run[1])))
                found.append((run[0][-1], run[1][-1]))
                run = ([], [])
        rows.append((len(ids[0]), len(ids[1]), len(mine), hashlib.sha256(";".join(mine).encode()).hexdigest()))
        links.append(found)
    count = Counter(p for x in links for p in x)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, n_g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha) for (n_a, n_b, n_g, sha), x in zip(rows, links)]


def scored(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_alignment_of_awkward_rows(awkward, both):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    want = [(i, *x) for (i, _), x in zip(docs, slow_alignment(both, [t for _, t in docs]))]
    assert sorted(scored(alignment.link_scores(awkward)), key=str) == sorted(want, key=str)
    by_id = {i: x for i, *x in want}
    assert by_id[11] == [0, 0, 0, 0, 0, 0, ""] and by_id[2] == by_id[1] == by_id[11] and by_id[12][0] > 5
    assert alignment.link_scores(awkward.where("1 = 0")).count() == 0


def test_alignment_by_words(both, monkeypatch):
    """Texts cut into remembered words against texts in one piece."""
    rng = random.Random(12)
    letters = ["a", "Be", "the", " ", "  ", "\n", "é", "日本", "1", "12", "'s", ".", "😀", "\t", "x y", "ing", "\x00", " ", "\u00a0", "\u3000", "\x85", "▁"]
    texts = ["".join(rng.choices(letters[:-1] if rng.random() < 0.9 else letters, k=rng.randrange(60))) for _ in range(600)] + [" ", "a ", " a", "a\n ", "  ", "word " * 50 + "w" * 500]
    for t in texts:
        assert " ".join(alignment.words_of(t)) == t
    want = [(*x[:4], x[6]) for x in slow_alignment(both, texts)]
    monkeypatch.setattr(alignment, "TOGETHER", 500)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    got = list(alignment.align(alignment.Words(*both), texts))
    assert [x[:5] for x in got] == want and all(int(x[6].sum()) == x[3] for x in got) and sum(x[0] > 0 for x in got) > 400


def test_overlaps_cover_all_bytes():
    """Random cuts, some tokens without bytes: intervals by single bytes, links by all pairs."""
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        a, b = (np.sort(np.concatenate([rng.integers(1, n + 1, rng.integers(0, n + 3)), [n]])) for _ in range(2))
        x = alignment.overlaps(a, b)
        owners = [(int(np.flatnonzero(a > k)[0]), int(np.flatnonzero(b > k)[0])) for k in range(n)]
        assert [(r.a, r.b) for r in x.itertuples() for _ in range(r.start, r.end)] == owners
        upto_a, upto_b, link_a, link_b = alignment.groups(a, b)
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert upto_a.tolist() == [int((a <= e).sum()) for e in both] and upto_b.tolist() == [int((b <= e).sum()) for e in both]


def test_pairs_are_bounded_by_the_vocabularies():
    side = lambda *entries: SimpleNamespace(entries=[e.encode() for e in entries])
    a, b = side("a", "ba", "c", "cba"), side("a", "a", "ba", "dba", "")
    want = sum(x.endswith(y) or y.endswith(x) for x in a.entries for y in b.entries)
    assert alignment.most_pairs(a, b) == want


# ---- 13 ------------------------------------------------------------------------------------------------------------------


def slow_components(rows, width=5, share=80):
    sets = []
    for _, t in rows:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append({b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    of = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            old, new = of[j], of[i]
            of = [new if x == old else x for x in of]
    names = {}
    for (i, _), x in zip(rows, of):
        names[x] = min((v for v in (i, names.get(x)) if v is not None), default=None)
    return sorted(((i, len(s), names[x]) for (i, _), s, x in zip(rows, sets, of)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_join_of_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert joined(ngram_join.join(awkward)) == slow_components(rows)
    assert ngram_join.join(awkward.where("1 = 0")).count() == 0


def test_join_of_copies(spark):
    """Chains and stars of copies near the threshold, a passage that many share, and a hot group."""
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    texts = [rng.choices(vocabulary, k=rng.randrange(4, 90)) for _ in range(40)]
    for t in list(texts):
        for _ in range(rng.randrange(5)):
            t = list(t)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
    texts += [rng.choices(vocabulary, k=rng.randrange(3, 14)) + passage for _ in range(40)]
    hot = rng.choices(vocabulary, k=70)
    for _ in range(60):
        t = list(hot)
        t[rng.randrange(70)] = rng.choice(vocabulary)
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = joined(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    want = slow_components(rows)
    assert got == want and 50 < len({c for _, _, c in want}) < len(rows) - 80


def test_folded_columns_never_discard_a_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        n = int(rng.integers(1, 700))
        a = rng.integers(-(2**62), 2**62, n)
        b = a.copy()
        b[: int(0.1 * n)] = rng.integers(-(2**62), 2**62, int(0.1 * n))
        b = b[: n - int(rng.integers(0, max(1, n // 40)))]
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            rows += [(k, *[(len(s), ngram_join.band_of(len(s)), len(s), len(s), ngram_join.folded(s).tolist()) for s in p]) for p in ((a, b), (b, a))]
    shape = "struct<n int, band int, least_n int, most_n int, bits array<long>>"
    df = spark.createDataFrame(rows, f"k int, q {shape}, g {shape}")
    assert len(rows) > 60 and df.where(ngram_join.may_hold("q", "g", 0.8)).count() == len(rows)


def test_shingle_sets_of_odd_words():
    """Equal shingles, and only those, have equal hashes: letters of either case, all blanks, bytes beyond ASCII, long words of patterns."""
    rng = random.Random(3)
    pattern = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    words = ["A", "a", "É", "é", "\x00", "\x00\x00", "ab", "ba", "\x1c", " ", "x" * 64, "x" * 65, "X" * 65, pattern, pattern.translate(str.maketrans("ab", "ba")), "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n ", "\x0b", "\x0c", "\r"]) for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 40, 400) for _ in range(6)] + ["", " ", "\n\t"]
    seen = {}
    for t in texts:
        w = t.encode().lower().split()
        plain = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        hashes = ngram_join.shingle_set(t)
        assert len(hashes) == len(plain) and (np.diff(hashes.astype(object)) > 0).all()
        seen[t] = plain, set(hashes.tolist())
    for (p, h), (q, g) in itertools.combinations(seen.values(), 2):
        assert len(p & q) == len(h & g)


def test_keys_are_dealt_out_once(spark, monkeypatch):
    """Where no table is short enough to be broadcast, the keys of all sets, which are most of what the join moves, are shuffled once."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(404))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    docs.count()
    monkeypatch.setattr(ngram_join, "crowded", lambda *a: np.zeros(1 << 18, dtype=np.int64))
    monkeypatch.setattr(ngram_join, "bounded", lambda df, *a: df)
    monkeypatch.setattr("gridlark.llm.near_copies.bounded", lambda df, *a: df)
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def dealt():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    start = dealt()
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert ngram_join.join(docs).where("doc_id = component_id").count() == 60
    keys = 60 * (400 - 320 + 1)
    assert keys <= dealt() - start < 1.5 * keys
    docs.unpersist()
