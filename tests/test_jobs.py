"""Forensic features, forward passes, image jobs, sinks and small operators."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siftwell.operators import attention, calibration, etl, evaluation, features, forensics, forward, leakage, pixels, planning, profile
from siftwell.plans import registry
from siftwell.sources import sinks

RNG = np.random.default_rng(5)


def test_filters_on_an_impulse():
    x = np.zeros((9, 9))
    x[4, 4] = 1
    for k in forensics.FILTERS.values():
        got = forensics.filtered(x, k)
        want = np.zeros((9, 9))
        h, w = k.shape
        want[4 - (h - 1) // 2 : 4 + h // 2 + 1, 4 - (w - 1) // 2 : 4 + w // 2 + 1] = k
        assert np.allclose(got, want)
    edge = np.arange(5.0)[None, :].repeat(5, 0)
    assert np.allclose(forensics.filtered(edge, np.ones((1, 3)) / 3)[0], [1 / 3, 1, 2, 3, 11 / 3])  # the edge itself is mirrored
    assert forensics.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(forensics.zigzag()) == list(range(64))


def test_wavelets_keep_energy_and_find_none_in_flat_images():
    x = RNG.normal(size=(32, 48))
    coarse, details = forensics.wavelet_step(x)
    assert np.isclose((x**2).sum(), (coarse**2).sum() + sum((d**2).sum() for d in details))
    assert all(np.allclose(d, 0) for d in forensics.wavelet_step(np.full((16, 16), 7.0))[1])
    assert forensics.wavelet_step(np.zeros((3, 15, 20)))[0].shape == (3, 7, 10)


def test_features_say_what_they_are_meant_to():
    noise = RNG.normal(128, 30, (256, 256)).clip(0, 255)
    doubled = np.kron(noise[:128, :128], np.ones((2, 2)))
    copies = slice(2 + 64 + 36 + 16, 2 + 64 + 36 + 16 + 3)
    plain, copied = (forensics.spectral(g[None])[0] for g in (noise, doubled))
    assert np.abs(plain[copies]).max() < 0.15 and np.abs(copied[:2]).sum() > 0
    blocky = pixels.compressed(np.repeat(noise[..., None], 3, 2).astype(np.uint8), 30)
    first, last = (forensics.dct(forensics.luma(i.astype(float))[None])[0] for i in (np.repeat(noise[..., None], 3, 2), blocky))
    assert last[128:192].mean() > first[128:192].mean()  # more coefficients are 0
    assert np.allclose(forensics.residual(np.full((1, 64, 64, 3), 9.0))[0, :125].sum(), 1)
    lattice = np.zeros((64, 64, 3))
    lattice[::2, ::2] = RNG.integers(0, 200, (32, 32, 1))
    assert forensics.color(lattice[None])[0, :4].max() > 0.3


def test_patches_are_aligned_and_apart():
    img = RNG.integers(0, 256, (700, 900, 3)).astype(np.float64)
    img[:300] = 100
    places = forensics.select_patches(img)
    assert len(places) == 8 and [p[3] for p in places] == [0] * 4 + [1] * 4
    assert all(y % 16 == 0 and x % 16 == 0 and s == 256 and y + s <= 700 and x + s <= 900 for y, x, s, _ in places)
    assert all(y <= 300 for y, _, _, kind in places if not kind)
    assert forensics.select_patches(np.zeros((40, 70, 3)))[0][2] == 64


def test_extraction_is_never_fatal(spark):
    img = RNG.integers(0, 256, (80, 100, 3)).astype(np.uint8)
    rows = [("a", bytearray(img.tobytes()), 100, 80), ("bad", bytearray(b"xx"), 100, 80), ("none", None, None, None)]
    got = {r.path: r for r in forensics.extract_with_valid(spark.createDataFrame(rows, "path string, content binary, width int, height int")).collect()}
    assert got["a"].valid and [len(got["a"][f]) for f in forensics.WIDTHS] == [8 * n for n in forensics.WIDTHS.values()]
    assert not got["bad"].valid and got["bad"].error and not any(got["bad"].spectral) and not got["none"].valid
    want = forensics.extract(img)
    assert np.allclose(got["a"]["global"], want["global"], rtol=1e-5) and np.allclose(got["a"].wavelet, want["wavelet"].ravel(), rtol=1e-4)


def test_statistics_are_guarded(spark, tmp_path):
    rows = spark.createDataFrame([("f", [1.0, 2.0], True), ("f", [3.0, 2.0], True), ("f", [9.0, 9.0], False)], "family string, values array<double>, valid boolean")
    path, calls = f"file://{tmp_path}/stats", []

    def compute():
        calls.append(1)
        return features.feature_stats(rows)

    for version in (1, 1, 2):
        got = {r.dim: (r["mean"], r["std"]) for r in features.guarded_stats(spark, path, {"n": 2}, version, compute).collect()}
        assert got == {0: (2.0, 1.0), 1: (2.0, 0.0)}
    assert len(calls) == 2
    with pytest.raises(ValueError):
        features.guarded_stats(spark, path, {"n": 3}, 2, compute)


def block(width, cross=False):
    layer = lambda a, b: (RNG.normal(size=(a, b)) / np.sqrt(b), RNG.normal(size=a) * 0.1)
    norm = (np.ones(width), np.zeros(width))
    return {"norm": norm, "q": layer(width, width), "k": layer(width, width), "v": layer(width, width), "up": layer(2 * width, width), "down": layer(width, 2 * width)} | ({"norm_x": norm} if cross else {})


def test_forward_passes(spark):
    x = RNG.normal(size=(2, 5, 8))
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    weights = {"latents": RNG.normal(size=(3, 8)), "blocks": [block(8), block(8, True)], "heads": 2, "every": 2, "head": [(RNG.normal(size=(4, 8)), np.zeros(4)), (RNG.normal(size=(1, 4)), np.zeros(1))]}
    prob, attn = forward.detector(weights)(x, mask)
    assert prob.shape == (2,) and np.allclose(attn.sum(1), 1) and np.allclose(attn[1, 3:], 0)
    # padding changes nothing
    alone = forward.detector(weights)(x[1:, :3])[0]
    assert np.isclose(alone[0], prob[1])
    with pytest.raises(ValueError):
        forward.qformer(x, weights["latents"], weights["blocks"][:1], 2, 2)
    rows = spark.createDataFrame([("a", x[0].ravel().tolist()), ("b", x[1, :3].ravel().tolist())], "path string, tokens array<double>")
    got = {r.path: r for r in forward.detected(rows, lambda: forward.detector(weights), 8).collect()}
    assert np.isclose(got["a"].prob, prob[0]) and np.isclose(got["b"].prob, prob[1]) and len(got["b"].attn) == 3
    q, k, v = (RNG.normal(size=(1, n, 8)) for n in (2, 6, 6))
    w = forward.weights_of(q, k, 2)
    out = np.einsum("bhqk,bkhd->bqhd", w, v.reshape(1, 6, 2, 4)).reshape(1, 2, 8)
    assert forward.checked_attention(q, k, v, out, 2)[1] < 1e-12 < forward.checked_attention(q, k, v, out + 1, 2)[1]


def test_tokens_of_features():
    sizes = {"spectral": 6, "color": 5, "global": 4}
    layer = lambda a, b: (RNG.normal(size=(a, b)), RNG.normal(size=a))
    weights = {"stats": {f: (np.zeros(n), np.ones(n)) for f, n in sizes.items()}, "projections": {f: ((np.ones(n), np.zeros(n)), layer(7, n), layer(8, 7)) for f, n in sizes.items()}, "kinds": RNG.normal(size=(3, 8)), "meta": layer(8, 4), "mask": RNG.normal(size=8), "norm": (np.ones(8), np.zeros(8))}
    given = {"spectral": RNG.normal(size=(2, 3, 6)), "color": RNG.normal(size=(2, 3, 5)), "global": RNG.normal(size=(2, 4)), "patch_meta": RNG.normal(size=(2, 3, 4)), "valid": np.array([1.0, 0.0])}
    got = forward.tokens_of(given, weights)
    assert got.shape == (2, 7, 8) and np.allclose(got[1, 0], got[1, 1]) and not np.allclose(got[0, 0], got[0, 1])
    with pytest.raises(KeyError):
        forward.tokens_of(given, weights | {"stats": {}})


def test_embedding_and_calls_give_rows_for_failures(spark):
    def build():
        return lambda content: np.frombuffer(bytes(content), np.uint8)[:2] if content != b"bad" else 1 / 0

    rows = [("a", bytearray([3, 4])), ("zero", bytearray([0, 0])), ("bad", bytearray(b"bad")), ("none", None)]
    got = {r.path: (r.ok, r.emb) for r in forward.embedded(spark.createDataFrame(rows, "path string, content binary"), build).collect()}
    assert got["a"][0] and np.allclose(got["a"][1], [0.6, 0.8]) and not any(got[k][0] for k in ("zero", "bad", "none"))

    def client():
        seen = {}

        def ask(message):
            seen[message] = seen.get(message, 0) + 1
            if message == "m0" or seen[message] < 2:
                raise OSError("busy")
            return message.upper()

        return ask

    asked = spark.createDataFrame([("0", "m0"), ("1", "m1")], "image_id string, messages string").coalesce(1)
    got = {r.image_id: tuple(r)[1:] for r in etl.called(asked, client, 3).collect()}
    assert got == {"0": (None, 3, "OSError: busy"), "1": ("M1", 2, None)}
    payload = json.loads(etl.messages(spark.createDataFrame([("i", "data:x")], "image_id string, url string"), "p", "q").first().messages)
    assert [m["role"] for m in payload] == ["system", "user"]


def test_image_jobs(spark):
    img = RNG.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    images = spark.createDataFrame([(s, 60, 40, bytearray(img.tobytes())) for s in ("a", "b")] + [("bad", 9, 9, bytearray(b"x"))], "stem string, width int, height int, content binary")
    plans = planning.plans(images)
    done = spark.createDataFrame([("a_a1.png",), ("a_a2.png",)], "file string")
    got = {r.file: r for r in pixels.augmented(images, plans, done).collect()}
    assert len(got) == 3 * 9 - 2 and "a_a1.png" not in got and got["bad_a3.png"].error and got["a_a6.png"].width == 48
    one = plans.where("stem = 'b' and idx = 4").first()
    want = pixels.applied(img, [(s.name, s.params) for s in one.steps])
    assert bytes(got["b_a4.png"].content) == want.tobytes()
    jobs = planning.crop_jobs(images.withColumnRenamed("stem", "src"), [(32, 16), (24, 24)], seed=2)
    made = {r.file: r for r in pixels.converted(images.withColumnRenamed("stem", "src"), jobs).collect()}
    for j in jobs.where("src <> 'bad'").collect():
        assert (made[f"{j.src}.png"].width, made[f"{j.src}.png"].height) == (j.size.w, j.size.h)
    steps = planning.round_steps(images.where("stem = 'a'"), planning.round_grid_frame(spark))
    rounds = pixels.compared(images, steps).collect()
    assert len(rounds) == 21 and not any(r.error for r in rounds)
    assert bytes(next(r for r in rounds if r.file == "a_r00").content) == img.tobytes()


def test_compression_loses_little_and_less_at_higher_quality():
    smooth = np.stack(np.meshgrid(np.arange(70), np.arange(50)), -1)
    img = np.concatenate([smooth * 2, smooth[..., :1] + 40], -1).astype(np.uint8)
    errors = [np.abs(pixels.compressed(img, q).astype(float) - img).mean() for q in (10, 50, 95)]
    assert pixels.compressed(img, 50).shape == img.shape and errors[0] > errors[1] > errors[2] and errors[2] < 2
    assert (pixels.quantisers(100)[0] == 1).all() and pixels.quantisers(50)[0][0, 0] == 16
    assert pixels.denormalised(np.array([-1, 0, 1])).tolist() == [0, 128, 255]
    assert pixels.unpatched(np.arange(4 * 12).reshape(4, 12), 2, 1, 2, 3).shape == (4, 2, 3)


def test_grids_are_maximal(spark):
    sizes = spark.createDataFrame([(w, h, 1 + w % 5) for w in (1, 17, 224, 640, 4000) for h in (1, 16, 225, 480, 3000)], "width int, height int, n int")
    found = profile.scale_profile(sizes)
    assert found.where(~profile.grid_is_maximal(F.col("width"), F.col("height"), F.col("rows"), F.col("cols"))).count() == 0
    assert found.where("tokens > 256").count() == 0
    shares = {r.direction: r.share for r in profile.scale_shares(found).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and set(shares) <= {"up", "down", "same"}
    assert profile.common_grids(found, 3).count() == 3
    assert [tuple(r)[:2] for r in profile.dataset_info(spark.createDataFrame([((1, "x"),)], "s struct<a:int,b:string>")).collect()] == [("s", "struct<a:int,b:string>"), ("s.a", "int"), ("s.b", "string")]


def test_sinks_resume_and_refuse(spark, tmp_path):
    path = f"file://{tmp_path}"
    shards = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "shard string")
    read = lambda left: left.select("shard", F.length("shard").alias("n"))
    assert sinks.scan(shards.limit(1), f"{path}/scan", read).count() == 1
    assert sinks.unscanned(shards, f"{path}/scan").count() == 2
    assert sinks.scan(shards, f"{path}/scan", read).count() == 3
    img = bytearray(b"12")
    rows = spark.createDataFrame([("a.bin", img, 1, 2), ("b.bin", img, 5, 5), ("../c", img, 1, 2)], "file string, content binary, width int, height int")
    got = {r.file: r.status for r in sinks.copied(rows, str(tmp_path / "out"), lambda c: (1, 2)).collect()}
    assert got["a.bin"] == "written" and got["b.bin"].startswith("error: is") and got["../c"].startswith("error")
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"12" and not (tmp_path / "c").exists()
    flags = spark.createDataFrame([("c", "x.png", 0.9, "v", "val", 0.9), ("c", "../y", 0.95, "w", "val", 0.95)], "class string, train_image string, cosine_sim double, matched_image string, matched_split string, best_val double")
    with pytest.raises(ValueError):
        leakage.guarded_deletes(flags, "/data/train")
    assert [r.status for r in leakage.guarded_deletes(leakage.sorted_removals(flags), "/data/train_toremove").collect()] == ["refused", "to delete"]
    sinks.with_summary(leakage.removal_lines(flags, ("val",)), flags.agg(F.count("*").alias("n")), f"{path}/removed")
    assert spark.read.csv(f"{path}/removed/rows", header=True).columns[-1] == "best_val" and spark.read.json(f"{path}/removed/summary").first().n == 2
    exported = sinks.exported(spark.createDataFrame([(0, img), (1, img)], "global_row long, content binary"), spark.createDataFrame([(1, "gen_000001_b1.jpg")], "global_row long, file string"), str(tmp_path / "exp"))
    assert [tuple(r) for r in exported.collect()] == [("gen_000001_b1.jpg", "written")]


def test_rounds_and_running_figures(spark):
    images = spark.createDataFrame([("a",), ("b",)], "path string")
    got = sorted(tuple(r) for r in calibration.seeded_rounds(images, 3, 10).collect())
    assert got == [(p, r, 9 + r) for p in "ab" for r in (1, 2, 3)]
    rows = evaluation.classify(spark.createDataFrame([(r, i % 2, (i * r % 7) / 7) for r in (1, 2) for i in range(20)], "round int, label int, prob double"))
    cells, histogram = calibration.round_tables(rows, 5)
    assert cells.count() == 2 and histogram.count() == 10 and histogram.agg(F.sum("count_real") + F.sum("count_aigen")).first()[0] == 40
    running = evaluation.running_accuracy(spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)], "batch int, pred int, label int")).orderBy("batch").collect()
    assert [(r.n, r.accuracy) for r in running] == [(2, 0.5), (4, 0.75)]
    timed = evaluation.with_throughput(spark.createDataFrame([("jpeg", "q", 10), ("none", "i", 4)], "augment string, variant string, total int"), spark.createDataFrame([("jpeg", "q", 2.0)], "augment string, variant string, seconds double"))
    assert {r.augment: r.images_per_second for r in timed.collect()} == {"jpeg": 5.0, "none": None}


def test_pairs_and_texts(spark):
    pairs = spark.createDataFrame([("s", "r.png", "f.png")], "stem string, real string, fake string")
    rows = attention.pair_rows(pairs, planning.draw_plans(pairs, 2))
    assert rows.count() == 6
    scored = rows.select("stem", "label", "variant", F.lit("p").alias("plan"), F.lit(2).alias("rows"), F.lit(3).alias("cols"), (F.col("label") * 0.5).alias("prob"), F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.3, 0.05, 0.05)]).alias("attn"))
    lines = attention.pair_summary(scored)
    first = lines.where("label = 1").first()
    assert (first.top_token, first.top_row, first.top_col, first.p_ai, first.border_mass) == (2, 0, 2, "0.500000", "1.0000")
    assert {r.label: r.p_ai for r in attention.pair_stats(lines).collect()} == {0: 0.0, 1: 0.5}
    records = spark.createDataFrame([("i", "SUBJECT: a cat\nnoise\nStyle : x: y\nSUBJECT: a dog"), ("j", None)], "image_id string, analysis string")
    assert {r.image_id: r.sections for r in etl.caption_sections(records).collect()} == {"i": {"SUBJECT": "a dog", "Style": "x: y"}, "j": {}}
    assert etl.out_dir("train", "x") == "train_detactify_x" and etl.counter_lines({"a": 1, "b": 3}).startswith("b: 3 (75.0%)")
    text = etl.grid_text([{"tol": 0.1, "max_share": 0.01, "images": 5}, {"tol": 0.2, "max_share": 0.01, "images": 7}], (0.2, 0.01), (0.2, 0.01))
    assert "7*" in text and "5+" in text
    files = spark.createDataFrame([("ab",), ("cd",)], "name string")
    assert attention.matching(files, "b").count() == 1 and attention.matching(files, "").count() == 2
    hashed = leakage.both_hashes(spark.createDataFrame([("a", bytearray(b"1x")), ("b", bytearray(b"2x")), ("c", None)], "name string, content binary"), lambda c: (1, 1, bytes(c)[1:]))
    assert [r.names for r in leakage.hash_groups(hashed).collect()] == [["a", "b"]]


def test_files_in_batches_and_samples(spark, tmp_path):
    from siftwell.sources import readers

    files = spark.createDataFrame([(f"d/{n}",) for n in ["a", "ab", "abc1", "abc2", *[f"x{i:02d}" for i in range(16)]]], "path string").repartition(5)
    ordered = sorted(r.path for r in files.collect())
    got = sorted((r.batch, r.place, r.path) for r in readers.batches_of(files, 6).collect())
    assert [g[2] for g in got] == ordered and [g[:2] for g in got] == [(i // 6, i % 6) for i in range(20)]
    mixed = [r.path for r in sorted(readers.batches_of(files, 6, 3).collect(), key=lambda r: (r.batch, r.place))]
    assert sorted(mixed) == ordered and mixed != ordered
    assert sorted(r.path for r in readers.sampled(files, 7).collect()) == [ordered[i * 20 // 7] for i in range(7)]
    assert readers.sampled(files, 50).count() == 20
    with pytest.raises(ValueError):
        readers.sampled(files.limit(0), 3)
    (tmp_path / "s1.csv").write_text("split,shard,row_group,row,stem,ext,width,height,format,nbytes,pooled,error\ntrain,s1,0,0,a,.png,5,6,PNG,9,1,\ntrain,s1,0,1,b,.png,,,,9,0,broken\n")
    rows, left = readers.scan_tables(spark, f"file://{tmp_path}", ["s1", "s2"])
    assert [r.stem for r in rows.collect()] == ["a"] and left == {"missing": ["s2"], "errors": 1}


def test_configs_are_checked():
    assert planning.validated(planning.Options()) == planning.Options()
    for bad in ({"quality": (0,)}, {"least": 4, "most": 3}, {"none": 0.7, "single": 0.5}, {"brightness": 2.0}, {"scale": ()}):
        with pytest.raises(ValueError):
            planning.validated(planning.Options(**bad))
    assert planning.run_name("base", {"run_name": "aug"}) == "aug" and planning.run_name("base", None) == "base"


def test_many_resolutions_are_joined_in_blocks(spark, monkeypatch):
    from siftwell.operators import resolution

    sizes = lambda seed: spark.createDataFrame([(int(w), int(h)) for w, h in np.random.default_rng(seed).integers(10, 400, (60, 2))], "width int, height int")
    candidates, reference = sizes(1), resolution.histogram(sizes(2))
    few = sorted(map(tuple, resolution.reference_shares(candidates, reference).collect()))
    monkeypatch.setattr(resolution, "BROADCAST_RESOLUTIONS", 1)
    monkeypatch.setattr(resolution, "BLOCK", 7)
    assert sorted(map(tuple, resolution.reference_shares(candidates, reference).collect())) == few
    assert resolution.radius(candidates, reference, 0.1).count() == candidates.distinct().count()


def test_leaks_don_t_depend_on_blocks(spark):
    x = np.random.default_rng(4).normal(size=(70, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("c" if i % 3 else "d", ["train", "val", "test"][i % 7 % 3], f"n{i}", v.tolist(), i != 5) for i, v in enumerate(x)]
    items = spark.createDataFrame(rows, '`class` string, split string, name string, emb array<double>, ok boolean')
    train, other = items.where("split = 'train'"), items.where("split <> 'train'")
    for f in (lambda b: leakage.cosine_pairs(train, other, 0.3, b), lambda b: leakage.cosine_pairs_sql(train, other, 0.3, b), lambda b: leakage.nearest(train, other, ("val", "test"), b)):
        one, two = (sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(b).collect()], key=str) for b in (1024, 3))
        assert one == two and one


def final_plan(df) -> str:
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()


def block_joins(df) -> list[str]:
    """The joins of blocks in the plan that ran."""
    return [line for line in final_plan(df).splitlines() if "Join [" in line and "left_at" in line]


def vectors_of(spark, rows: int):
    x = np.random.default_rng(5).normal(size=(rows, 6))
    items = spark.createDataFrame([("c", f"n{i}", v.tolist(), True) for i, v in enumerate(x)], "`class` string, name string, emb array<float>, ok boolean")
    return items.where("name < 'n5'"), items.where("name >= 'n5'"), x


def test_blocks_are_not_broadcast_by_cosine_pairs(spark):
    train, val, _ = vectors_of(spark, 40)
    joins = block_joins(leakage.cosine_pairs(train, val, 0.3, 2))
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_blocks_are_not_broadcast_by_built_in_cosine_pairs(spark, monkeypatch):
    train, val, x = vectors_of(spark, 40)
    odd = spark.createDataFrame([("c", "short", [1.0, 0.5], True), ("c", "gap", [9.0, None, 9.0, 9.0, 9.0, 9.0], True)], train.schema)
    want = sorted((r.train_image, r.val_image, round(r.cosine_sim, 9)) for r in leakage.cosine_pairs(train, val, 0.3).collect())
    for columns in (256, 3):
        monkeypatch.setattr(leakage, "COLUMNS", columns)
        pairs = leakage.cosine_pairs_sql(train.unionByName(odd), val.unionByName(odd.where("name = 'short'")), 0.3, 2)
        joins = block_joins(pairs)
        assert joins and all("SortMergeJoin" in x for x in joins)
        assert sorted((r.train_image, r.val_image, round(r.cosine_sim, 9)) for r in pairs.collect()) == sorted([*want, ("short", "short", 1.25)])


@pytest.mark.parametrize("name", ["merge_evidence", "sorted_leaks", "leak_summary"])
def test_blocks_are_not_broadcast_by_queries(spark, name):
    joins = block_joins(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert joins and all("SortMergeJoin" in x for x in joins)


@pytest.mark.parametrize("name", ["merge_evidence", "leak_summary", "sorted_leaks"])
def test_no_vectors_pass_the_driver(spark, name):
    plan = final_plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Join [" in plan and "BroadcastHashJoin" not in plan


def sent_to_driver(spark) -> dict[int, int]:
    """Bytes of the results of the tasks of each stage so far, what is broadcast among them."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    empty = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty)
    return {s.stageId(): s.resultSize() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", ["sorted_leaks", "leak_summary"])
def test_little_reaches_the_driver(spark, tmp_path, name):
    x = np.random.default_rng(6).normal(size=(20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(len(x), np.int32)}), f"{tmp_path}/embeddings.parquet")
    before = sent_to_driver(spark)
    assert registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert 0 < sum(n for stage, n in sent_to_driver(spark).items() if stage not in before) < 1 << 20


@pytest.mark.parametrize("name", ["merge_evidence", "leak_summary", "sorted_leaks"])
def test_classes_are_counted_without_products_of_partitions(spark, name):
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(was, ("false", "-1"), strict=True):
            spark.conf.set(c, v)
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan


def test_blocks_of_classes_on_one_side_or_none(spark):
    side = lambda rows: spark.createDataFrame(rows, "`class` string, name string, emb array<double>, ok boolean")
    train = side([("a", "t1", [1.0, 0.0], True), ("b", "t2", [1.0, 0.0], True), (None, "t3", [1.0, 0.0], True), ("d", "t4", [1.0, 0.0], False), ("a", "t5", [0.8, 0.6], True)])
    val = side([("a", "v1", [1.0, 0.0], True), ("c", "v2", [1.0, 0.0], True), (None, "v3", [1.0, 0.0], True), ("d", "v4", [1.0, 0.0], True)])
    for f in (leakage.cosine_pairs, leakage.cosine_pairs_sql):
        assert sorted((r["class"], r.train_image, r.val_image) for r in f(train, val, 0.5, 1).collect()) == [("a", "t1", "v1"), ("a", "t5", "v1")]


def test_squares_of_blocks_hold_all_pairs(spark):
    train, val, x = vectors_of(spark, 60)
    x = x.astype(np.float32).astype(np.float64)
    left, right = ([int(r.name[1:]) for r in df.collect()] for df in (train, val))
    want = {(f"n{i}", f"n{j}") for i in left for j in right if x[i] @ x[j] > 0.3}
    for block in (1, 2, 5, 1024):
        got = [(r.train_image, r.val_image) for r in leakage.cosine_pairs(train, val, 0.3, block).collect()]
        assert len(got) == len(want) and set(got) == want
    with pytest.raises(Exception, match="of one length"):
        leakage.cosine_pairs(train, val.unionByName(spark.createDataFrame([("c", "odd", [1.0], True)], val.schema)), 0.3).collect()


def test_weights_are_read_as_written(spark, tmp_path):
    weights = {"latents": RNG.normal(size=(3, 8)), "blocks": [block(8), block(8, True)], "heads": 2, "every": 2, "head": [(RNG.normal(size=(1, 8)), np.zeros(1))]}
    forward.write_weights(spark, weights, f"file://{tmp_path}/w")
    again = forward.read_weights(spark, f"file://{tmp_path}/w")
    x = RNG.normal(size=(2, 5, 8))
    assert np.allclose(forward.detector(weights)(x)[0], forward.detector(again)(x)[0]) and not forward.is_classical(again)
    assert forward.describe(again) == forward.describe(weights) and "2 blocks" in forward.describe(weights)


def test_removal_and_routes(spark):
    rows = [("c", "train", "a", [1.0, 0.0], True), ("c", "train", "b", [0.0, 1.0], True), ("c", "train", "bad", None, False), ("c", "val", "v", [1.0, 0.0], True), ("c", "test", "t", [0.8, 0.6], True)]
    items = spark.createDataFrame(rows, "`class` string, split string, name string, emb array<double>, ok boolean")
    job = leakage.removal(items.where("split = 'train'"), items.where("split <> 'train'"), 0.9, ("val", "test"))
    assert [(r.train_image, r.cosine_sim, r.matched_image) for r in job["removed"].collect()] == [("a", "1.000000", "v")]
    assert sorted(r.name for r in job["survivors"].collect()) == ["b", "bad"] and job["summary"].first().flagged == 1
    images = spark.createDataFrame([(1, 0, bytearray(b"\xff\xd8\xff0")), (2, 1, bytearray(b"GIF89a")), (3, 7, bytearray(b"x"))], "img_id int, label int, content binary")
    assert sorted(r.file for r in etl.routed_files(images, {0: "real", 1: "fake"}).collect()) == ["fake/2.gif", "real/1.jpg"]
    text = etl.table_text([{"round": "none", "f1": 0.5}, {"round": "jpeg", "f1": None}], ["round", "f1"])
    assert text.splitlines()[1].endswith("0.5000") and len({len(x) for x in text.splitlines()}) == 1
