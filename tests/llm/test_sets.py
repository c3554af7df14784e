"""Near duplicates, benchmark passages, repeated substrings, embeddings and the pipeline against plain versions."""

import random
import re

import numpy as np
import pytest
from oracle import assert_same
from siftwell.llm import decontamination, embedding_dedup, jaccard_join, registry, substring_dedup
from siftwell.llm.components import components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name], SMALL)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("paired, block", [(64, 256), (2, 3), (1, 1)])
def test_jaccard_components_of_groups_at_the_limit(spark, paired, block):
    rng = random.Random(paired)
    rows = []
    for size in (1, 3, 4, 5, 6, 9, 25, 80, 200):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        rows += [(len(rows) + i, " ".join(edited(rng, base, s))) for i, s in enumerate([0, 0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.05, 0.2])]
        rows.append((len(rows), " ".join(base[: max(1, int(size * 0.85))]).upper()))
    rows += [(len(rows), ""), (len(rows) + 1, ""), (len(rows) + 2, " \t")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), paired, block).collect()}
    assert [got[i] for i, _ in rows] == plain_components(rows)


def test_jaccard_components_where_names_of_classes_collide(spark):
    rng = random.Random(8)
    rows = []
    for size in (3, 8, 30, 60):
        for _ in range(6):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
            rows += [(len(rows) + i, " ".join(edited(rng, base, s))) for i, s in enumerate([0, 0, 0.02, 0.05])]
    rows += [(len(rows), None), (len(rows) + 1, "")]

    def narrow(own):
        name, other = jaccard_join.class_of(own)
        return name % 5, other

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, name=narrow).collect()}
    assert [got[i] for i, _ in rows] == plain_components(rows)


def test_jaccard_edges(spark):
    rows = [(5, "A b c"), (2, "a B c"), (2, "a B c"), (None, "a b c"), (1, None), (3, ""), (4, "x"), (None, "lone words here"), (None, "lone words here")]
    df = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, key int, part string")
    found = jaccard_join.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted([(5, 1, 2), (2, 1, 2), (2, 1, 2), (None, 1, 2), (1, 0, 1), (3, 0, 3), (4, 1, 4), (None, 1, None), (None, 1, None)], key=str)
    assert len({r.key for r in found if r.kept and r.n_shingles}) == 3
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_signatures_are_shared_by_linked_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 17, 40, 160, 700):
        for _ in range(20):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            least = -(-80 * n // 100)
            b = np.concatenate([rng.permutation(a)[: rng.integers(least, n + 1)], rng.integers(0, 1 << 62, rng.integers(0, n // 8 + 1)).astype(np.uint64)])
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            h, owner, need = jaccard_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.cumsum([len(a), len(b)]))
            shared = len(np.intersect1d(h[owner == 0], h[owner == 1]))
            assert shared >= max(1, need.max()), (n, shared, need)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (201, 202), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alone", [0, 60, 1 << 20])
def test_components_in_rounds_and_in_one_task_are_the_same(spark, monkeypatch, alone):
    from siftwell.llm import components as by_links

    rng = random.Random(3)
    ids = [rng.randint(-(2**62), 2**62) for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(0, 80)] + [tuple(rng.sample(ids[100:], 2)) for _ in range(110)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        least, other = sorted((root[a], root[b]))
        root = {x: least if r == other else r for x, r in root.items()}
    monkeypatch.setattr(by_links, "ALONE", alone)
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()} == root


def test_few_jobs_find_components_and_documents_are_joined_once(spark):
    # the driver keeps account of every job, plan and task
    spark.sparkContext.setJobGroup("components-of-a-chain", "")
    try:
        df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8)
        assert components(df).where("component = 0").count() == 41
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-of-a-chain")) <= 10
    finally:
        for x in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(x, None)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3}") for i in range(9)], "doc_id long, text string")
    plan = jaccard_join.jaccard_components(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # with the hot classes, and with the others


@pytest.mark.parametrize("keys", [10_000, 3, 1])
def test_joins_with_hot_keys_give_the_rows_of_joins(spark, monkeypatch, keys):
    from siftwell.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", keys)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None) for i in range(200)], "i int, key string")
    keyed = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n").where("key <> 'k0'").selectExpr("key", "n", "length(key) as l", "key as again")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.join_hot(rows, keyed, "key", "n", how).select("i", "key", "l", "again").collect()), key=str)
        assert got == sorted(map(tuple, rows.join(keyed.drop("n"), "key", how).select("i", "key", "l", "again").collect()), key=str)


def test_scans_and_places_in_long_texts(spark):
    from pyspark.sql import functions as F
    from siftwell.llm import common

    rng = random.Random(2)
    arrays = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1000)]
    for values, r in zip(arrays, spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<bigint>").orderBy("i").select(common.scan(F.col("a"), F.lit(0).cast("long"), lambda x, y: x + y).alias("s"), common.scan(F.col("a"), F.lit(-99).cast("long"), F.greatest).alias("m")).collect(), strict=True):
        assert r.s == [sum(values[: i + 1]) for i in range(len(values))] and r.m == [max(values[: i + 1]) for i in range(len(values))]
    text = "".join(rng.choice("ab é😀\n") for _ in range(2000))
    spans = sorted({(a, a + rng.randint(0, 700)) for a in (rng.randint(0, 1999) for _ in range(50))})
    df = spark.createDataFrame([(text, [(a, min(b, 2000)) for a, b in spans])], "t string, s array<struct<start:bigint,end:bigint>>")
    df = df.withColumn("leaves", common.leaves(F.col("t")))
    got = df.select(F.transform("s", lambda x: common.piece(F.col("leaves"), x["start"], x["end"])).alias("p")).first().p
    assert got == [text[a : min(b, 2000)] for a, b in spans]
    for _ in range(30):
        covers = sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8))))
        cuts = sorted(rng.sample(range(70), 8))
        own = list(zip(cuts[::2], cuts[1::2], strict=True))
        kind = "array<struct<start:bigint,end:bigint,text:string>>"
        df = spark.createDataFrame([([(*x, "") for x in own], [(*x, "") for x in covers])], f"s {kind}, c {kind}")
        r = df.select(common.uncovered(F.col("s"), F.col("c")).alias("u"), common.apart(F.col("s"), F.col("c")).alias("a")).first()
        free = [(i, p) for i, (a, b) in enumerate(own) for p in range(a, b) if not any(c <= p < d for c, d in covers)]
        assert sorted((x.i, p) for x in r.u for p in range(x.start, x.end)) == free
        assert [(x.start, x.end) for x in r.a] == [(a, b) for a, b in own if not any(c < b and a < d for c, d in covers)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_edges(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", most)
    text = "A b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, text, "z"), (3, text, "z"), (None, "q a B! q a", "n"), (5, "a", "n")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("1", None), ("2", "..."), ("3", "B c d e f g h i j k l"), ("10", "q a b"), ("4", "q a b"), (None, "n m")], "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontamination.decontaminate(docs, items).collect()), key=str)
    assert got == sorted([(1, 0, 0, ()), (2, 0, 0, ()), (3, 14, 11, ("3",)), (3, 14, 11, ("3",)), (None, 5, 3, ("10", "4")), (5, 1, 0, ())], key=str)
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


def plain_substrings(rows):
    """rows: distinct (doc_id, text) in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = text.split(" ")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out[doc_id] = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


def test_substrings_with_passages_of_any_offset(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 29, 47)]
    rows = []
    for d in range(60):
        words = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) + [word() for _ in range(rng.randint(0, 25))]
        rows.append((d, " ".join(words) or "x"))
    rows.append((60, " ".join(["z"] * 70)))
    for parts in (1, 12):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(df, True).collect() if r.kept is not None}
        want = plain_substrings(rows)
        assert all(want[k] == v for k, v in got.items()) and all(len(want[k].split(" ")) == len(t.split(" ")) for k, t in rows if k not in got)


def test_substrings_whose_windows_collide_are_told_apart(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(n)] for n in (25, 40, 60)]
    rows = [(d, " ".join([word() for _ in range(15)] + rng.choice(passages) + [word() for _ in range(15)] + rng.choice(passages))) for d in range(40)]
    asked = []

    def narrow(words, seed, full=substring_dedup.window_hashes, used=spark.sparkContext.accumulator(0)):
        h, more = full(words, seed)
        used += 1 if seed else 0
        return (h, more) if seed else (h % np.uint64(7), more % np.uint32(2))

    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(df, True, hashes=narrow).collect() if r.kept is not None}
        want = plain_substrings(rows)
        assert got and all(want[k] == v for k, v in got.items())
        asked.append(narrow.__defaults__[1].value)
    assert asked[0] > 0 and asked[1] > asked[0]  # the hashes were changed


def test_substring_edges(spark):
    w = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, w, 0), (5, w, 0), (None, w, 0), (1, "a " + w + " b", 0), (2, None, 0), (3, "", 0), (4, " ".join("z" * 50), 0)], "doc_id long, text string, part int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()), key=str)
    assert got == sorted([(5, 30, 30), (5, 30, 30), (None, 30, 30), (1, 32, 0), (2, 0, 0), (3, 0, 0), (4, 50, 49)], key=str)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_embeddings_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 64))
    x = np.concatenate([c + rng.normal(size=(6, 64)) * np.linalg.norm(c) / 8 * s for c in centres for s in (0.05, 0.12, 0.19)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(9000 + i, x[0].tolist(), 0) for i in range(50)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(true, False)
    n = np.array([got[r[0]].n_links for r in rows])
    assert (n <= true.sum(1)).all() and n.sum() >= 0.9 * true.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def plain_embeddings(rows):
    """vec_id -> (n_links, component_id) by brute force."""
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    component = np.array([r[0] for r in rows])
    while True:
        least = np.minimum(component, np.where(link, component[None, :], component.max()).min(1))
        if (least == component).all():
            return {r[0]: (int(n), int(c)) for r, n, c in zip(rows, link.sum(1), component, strict=True)}
        component = least


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_components_of_groups_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(20, 64))
    x = np.concatenate([c + rng.normal(size=(n, 64)) * np.linalg.norm(c) / 8 * 0.04 for c, n in zip(centres, [60, *[4] * 19], strict=True)]).astype(np.float32)
    rows = [(i + 1, v.tolist(), i % 2) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist(), 0) for i in range(20)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == plain_embeddings(rows)


def test_recall_of_pairs_at_the_threshold_without_clusters(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.9801 * x + np.sqrt(1 - 0.9801**2) * y])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(both)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = got.where("n_links = 1").count() / len(rows)
    assert got.where("n_links > 1").count() == 0 and found >= 0.97, found


def test_vectors_that_share_their_id_are_not_one(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (8, [2.0, 0.01], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [], 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, label int, code int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False), None: (0, None, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11)}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as p
    from siftwell.llm.common import cut
    from test_texts import plain_secrets

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [decontamination_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES:
        before, names = now, docs.columns
        docs = cut(stage(spark, docs, SMALL), "test")
        if name == "token_ids":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(before)
            break
        assert docs.columns == names
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert now == before
        elif name == "near_duplicates":
            rows = sorted(before.items())
            assert set(now) == {r[0] for r, c in zip(rows, plain_components(rows), strict=True) if r[0] == c}
        elif name == "benchmark":
            windows = {tuple(w[i : i + 10]) for w in bench if w for i in range(max(1, len(w) - 9))}
            hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [decontamination_words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
            assert set(now) == {k for k, t in before.items() if not hit(t)}
        else:
            assert set(now) == set(before)
            assert all((now[k] != t) >= bool(plain_secrets(t)) and not plain_secrets(now[k]) for k, t in before.items())


def test_pipeline_drops_texts_without_a_main_language(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    clean = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_lang = {r.lang: r.text for r in clean.where("length(text) > 3000").collect()}
    assert len(by_lang) == 4
    foreign = "Съешь же ещё этих мягких французских булок да выпей чаю "
    even = "\n".join(re.sub(r"[^A-Za-z ]", "", by_lang[k])[:1000] for k in sorted(by_lang))
    gone = {-1: foreign * 20, -2: "天地玄黄宇宙洪荒 " * 20, -3: "السلام عليكم ورحمة الله " * 20, -4: foreign * 20 + by_lang["en"][:200], -5: even, -6: "12 $$", -7: None}
    stay = {-8: by_lang["en"][:1000] + foreign * 5, -9: by_lang["fr"][:800] + " " + by_lang["de"][:400]}
    first = clean.limit(1)
    planted = [first.withColumn("doc_id", F.lit(k).cast(clean.schema["doc_id"].dataType)).withColumn("text", F.lit(t).cast("string")).withColumn("lang", F.lit(None).cast("string")) for k, t in {**gone, **stay}.items()]
    for df in planted:
        clean = clean.unionByName(df)
    before = {r.doc_id for r in clean.collect()}
    assert before - {r.doc_id for r in p.language(spark, clean, SMALL).collect()} == set(gone)


def test_pipeline_stages_take_any_columns_and_rows(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F
    from siftwell.llm.common import cut

    first = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and length(text) > 500").limit(1).first()
    text, key = first.text, "token=abcdefgh1 "
    rows = [(1, text, "en"), (1, text, "en"), (None, text + " x", "en"), (None, text, "en"), (2, None, None), (3, "", "en"), (4, text[:400] + " " + key, "en"), (4, text[400:900], None)]
    names = ("score", "lang_pred", "base", "found", "own_id", "own_key", "own_spans", "nth", "key", "kept", "row", "a.b", "b`c", "kind", "class")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    kept = {"language": 6, "near_duplicates": 3, "benchmark": 3, "secrets": 3, "token_ids": 3}
    for name, stage in p.STAGES:
        made = cut(stage(spark, docs, SMALL), "test")
        assert made.count() == kept[name], name
        if name != "token_ids":
            assert made.columns == docs.columns and all(made.where(f"`{n.replace('`', '``')}` <> {i}").isEmpty() for i, n in enumerate(names))
            empty = stage(spark, docs.limit(0), SMALL)
            assert empty.count() == 0 and empty.columns == docs.columns
        docs = made if name != "language" else docs.where("text is not null and text <> ''")
        if name == "near_duplicates":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted([(1, text), (4, rows[6][1]), (4, rows[7][1])])
        if name == "secrets":
            assert [r.text for r in docs.where("doc_id = 4").collect() if "[SECRET]" in r.text] == [text[:400] + " [SECRET] "]
    # null and empty texts stay in all stages but the first
    odd = spark.createDataFrame([(2, None, None), (3, "", "en"), (None, None, None)], "doc_id long, text string, lang string")
    for name, stage in p.STAGES[1:]:
        assert stage(spark, odd, SMALL).count() == 3, name
    assert p.language(spark, odd, SMALL).count() == 0


def decontamination_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
