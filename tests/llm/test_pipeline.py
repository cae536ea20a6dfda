"""The pipeline's stages against brute force, on planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridlark.llm import bpe, near_copies, quality, simhash


def sets_of(text, width=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts with near copies on both sides of the threshold, a chain, a crowd of copies, and a passage that most texts share."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(60)]
    texts = ["", " \n", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for size in (100, 200, 400):
        for changes in (1, 2, 3, 4, 8, 12, 25):
            base = [word() for _ in range(size)]
            copy = list(base)
            for k in rng.sample(range(size), min(changes, size)):
                copy[k] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    chain = [word() for _ in range(120)]
    for k in range(8):
        chain[k * 14] = f"link{k}"
        texts.append(" ".join(chain))
    crowd = [word() for _ in range(150)]
    for k in range(30):
        texts.append(" ".join([*crowd[:70], f"n{k}", *crowd[71:]]))
    for k in range(30):
        texts.append(" ".join([*common, *[word() for _ in range(20 + 3 * k)]]))
    return texts


def brute_groups(texts):
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies(spark):
    texts = planted()
    want = brute_groups(texts)
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").withColumn("n", F.lit(1))
    got = {r.doc_id: r.component_id for r in near_copies.groups(df).collect()}
    assert got == dict(enumerate(want))
    left = corpus_pipeline.one_of_copies(spark, df, "")
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    # The fingerprints of such pairs are often further apart than four places.
    linked = [(a, b) for a in range(7, 49, 2) for b in (a + 1,) if want[a] == want[b]]
    assert len(linked) >= 9 and any((simhash.fingerprint(texts[a], 5) ^ simhash.fingerprint(texts[b], 5)).bit_count() > 4 for a, b in linked)
    assert near_copies.groups(df.where("1 = 0")).count() == 0


def test_fingerprints_link_copies_without_the_exact_search(spark, monkeypatch):
    """With no keys for the exact search, the pairs that SimHash links are left, if they are near copies; with them, all are there."""
    rng = random.Random(4)
    texts = []
    for size in (200, 400, 800):
        for _ in range(8):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(base), " ".join(["changed", *base[1:]])]
    texts += ["few words here", "few words here too", "a b c a b c a b c a b", "A  b c a b c a b c a b c"]
    prints, want, every = [simhash.fingerprint(t, 5) for t in texts], list(range(len(texts))), brute_groups(texts)
    for a in range(0, len(texts), 2):
        if (prints[a] ^ prints[a + 1]).bit_count() <= 4 and jaccard(sets_of(texts[a]), sets_of(texts[a + 1])) >= 0.8:
            want[a + 1] = a
    assert 8 < sum(a != k for k, a in enumerate(want)) < sum(a != k for k, a in enumerate(every))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.groups(df).collect()} == dict(enumerate(every))
    monkeypatch.setattr(near_copies, "keys_of", lambda h, crowds, share: h[:0])
    assert {r.doc_id: r.component_id for r in near_copies.groups(df).collect()} == dict(enumerate(want))


def test_near_copies_awkward(spark):
    rows = [(None, "x y z"), (4, "x y z"), (4, "X  y z"), (None, "alone"), (5, None), (6, "")]
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4), (4, 4), (4, 4), (None, None), (5, 5), (6, 5)], key=str)


def test_rows_of_one_id(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame([(i, t, len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, extra long")
    texts = lambda out: sorted((r.extra, r.text) for r in out.collect())

    for one in (3, None):
        got = corpus_pipeline.drop_lines(spark, docs([(one, "x\nz"), (one, "w\nx"), (one, "v")]), "")
        assert got.columns == ["doc_id", "text", "n_chars", "extra"] and all(r.n_chars == len(r.text) for r in got.collect())
        both = dict(texts(got))
        # Either row may count as the earlier one of equal ids; every line stays once.
        assert sorted("\n".join(both.values()).split("\n")) == ["v", "w", "x", "z"] and both[0].endswith("z") and both[1].startswith("w")

    got = texts(corpus_pipeline.one_of_copies(spark, docs([(7, "one text here"), (7, "one text here"), (None, "one text here"), (7, "another"), (None, "n"), (None, "n")]), ""))
    assert sorted(t for _, t in got) == ["another", "n", "one text here"]
    assert [k for k, t in got if t == "one text here"][0] in (0, 1)

    item = "q1 q2 q3 q4 q5 q6 q7"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {item} b"), (None, "clean"), (2, "q1 q2 q3 q4 q5 q6"), (2, "x q3 q4 q5 q6 q7"), (9, item), (9, "clean too")]
    # Neither row of id 2 has 80 % of the item's three shingles, only both together.
    assert [k for k, _ in texts(corpus_pipeline.drop_leaks(spark, docs(rows), str(tmp_path)))] == [1, 2, 3, 5]


def test_stages_keep_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns named like the stages' own stay as they are; empty tables, nulls and empty texts go through every stage."""
    names = ["_row", "_key", "_gone", "_id", "h", "at", "key", "item_id", "keep", "component_id"]
    rows = [(1, "same line\nx", 11, *range(10)), (2, "same line\ny", 11, *range(10)), (None, None, None, *range(10)), (3, "", 0, *range(10)), (4, "z " * 3000, 6000, *range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(1, "q1 q2 q3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(tuple(r)[3:] == tuple(range(10)) for r in got), name
            if name in ("quality", "leaks"):
                assert len(got) == df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()


def test_quality_and_tokens_by_row(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdlmnrst") + rng.choice("aeiou") for _ in range(2))
    rows, labels = [], []
    for k in range(200):
        text = " ".join(word() + ("###" if k % 3 == 0 else "") for _ in range(60))
        rows.append((k, text, len(text)))
        labels.append((k, int(k % 3 > 0), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect())
    assert kept == sorted(r.doc_id for r in quality.score_documents(docs, lab).collect() if r.score >= quality.THRESHOLD)
    assert sum(k % 3 > 0 for k in kept) > 120 and sum(k % 3 == 0 for k in kept) < 10
    enc = bpe.encoder(bpe.rank_bytes(), bpe.split_pattern())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs.limit(20), "").collect()}
    assert got == {k: len(enc.encode_ordinary(t)) for k, t, _ in rows if k in got} and len(got) == 20
