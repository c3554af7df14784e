"""Plans, pixels, headers, leaks, samples, sources and streams on small inputs."""


import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftwell.functions import percentiles
from siftwell.operators import attention, features, leakage, pixels, planning, profile, resolution, sampling, scoring
from siftwell.sources import readers, sinks
from siftwell.streaming.calibration import update_histogram


def test_plans_depend_on_the_name_alone(spark):
    stems = spark.createDataFrame([("b",), ("a",), (None,)], "stem string")
    got = {(r.stem, r.idx): [(s.name, s.params) for s in r.steps] for r in planning.plans(stems.repartition(2)).collect()}
    assert len(got) == 18
    for stem in "ab":
        assert [[n for n, _ in got[stem, i + 1]] for i in range(6)] == [[a] for a in planning.AUGMENTS]
        chains = [frozenset(n for n, _ in got[stem, i]) for i in (7, 8, 9)]
        assert len(set(chains)) == 3 and all(2 <= len(c) <= 6 for c in chains)
        assert all(float(p["quality"]) in (90, 70, 50, 30) for steps in (got[stem, i] for i in range(1, 10)) for n, p in steps if n == "jpeg")
    only = planning.plans(stems, o=planning.Options(least=6, most=6)).where("idx > 6").collect()
    assert len(only) == 6 and all(len(r.steps) == 6 for r in only)  # there is one subset: chains repeat it


def test_online_plans_mix_as_asked(spark):
    stems = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("stem"))
    sizes = [len(r.steps) for r in planning.online_plans(stems).collect()]
    assert 230 < sizes.count(0) < 370 and 1080 < sizes.count(1) < 1320 and max(sizes) == 6
    assert min(len(r.steps) for r in planning.online_plans(stems, retry_identity=True).collect()) == 1
    drawn = planning.draw_plans(stems.limit(5), 2).collect()
    assert len(drawn) == 15 and all((r.variant == 0) == (not r.steps) for r in drawn)
    one, two = ({r.stem: str(r.steps) for r in planning.epoch_plans(stems, e).collect()} for e in (1, 2))
    assert one != two and one == {r.stem: str(r.steps) for r in planning.epoch_plans(stems.repartition(5), 1).collect()}


def test_grid_and_options():
    grid = planning.round_grid()
    assert len(grid) == 21 and [len([r for r in grid if r[0] == a]) for a in ("none", *planning.AUGMENTS)] == [1, 4, 3, 2, 3, 7, 1]
    assert len(planning.round_grid(planning.options(sets=["contrast=0"]))) == 19
    assert planning.options({"quality": 50}, ["scale=[0.5,0.1]", "distinct=false"]) == planning.Options(quality=(50,), scale=(0.5, 0.1), distinct=False)
    with pytest.raises(ValueError):
        planning.options({"qualty": 1})
    with pytest.raises(ValueError):
        planning.selected_rounds(grid, ["blurr"])


def test_seed_is_unsigned(spark):
    rows = spark.createDataFrame([("x",), (None,)], "s string").select(planning.image_seed_column(F.col("s"), F.lit(1)).cast("string").alias("n")).collect()
    assert rows[0].n == str(planning.image_seed("x", 1)) and rows[1].n is None


def test_crops_stay_inside(spark):
    rows = spark.createDataFrame([(f"i{i}", 40 + 13 * i, 700 - 11 * i) for i in range(50)], "src string, width int, height int")
    size = {r.src: (r.width, r.height) for r in rows.collect()}
    for r in planning.crop_jobs(rows, [(512, 256), (300, 300)], seed=3, min_cover=0.3).collect():
        w, h = size[r.src]
        assert 0 <= r.box.l < r.box.r <= w and 0 <= r.box.t < r.box.b <= h
        assert not r.feasible or r.cover >= 0.3


def test_pixels():
    img = np.random.default_rng(0).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert pixels.cropped(img, 0.8).shape == (32, 48, 3)
    assert (pixels.noised(img, 0.05, 7) == pixels.noised(img, 0.05, 7)).all()
    flat = np.full((20, 20, 3), 90, np.uint8)
    assert (pixels.blurred(flat, 1.0) == 90).all() and (pixels.rescaled(flat, 0.5) == 90).all()
    assert (pixels.jittered(flat, 1.0, 1.0, 1.0) == flat).all()
    assert pixels.applied(img, [("crop", {"fraction": "0.5"}), ("blur", {"sigma": "1.0"})]).shape == (20, 30, 3)
    with pytest.raises(ValueError):
        pixels.applied(img, [("sharpen", {"amount": "1"})])
    assert pixels.applied(img, [("jpeg", {"quality": "50"})]).shape == img.shape
    assert pixels.applied(img, [("crop", {"fraction": "0.5"})], resize_back=True).shape == img.shape
    dct = features.block_dct(flat[..., 0].astype(float))
    assert np.allclose(dct[:, 0, 0], 90 * 8) and np.allclose(dct.reshape(len(dct), -1)[:, 1:], 0)


def test_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 50, 3)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    rows = [("p", png), ("j", jpeg), ("g", gif), ("bad", b"junk"), ("none", None)]
    df = spark.createDataFrame([(n, bytearray(d) if d else None) for n, d in rows], "path string, content binary")
    got = {r.path: r for r in pixels.headers(df).collect()}
    assert (got["p"].width, got["p"].height, got["p"].format, got["p"].mode) == (640, 480, "PNG", "RGB")
    assert (got["j"].width, got["j"].height, got["j"].format) == (50, 30, "JPEG")
    assert (got["g"].width, got["g"].height) == (7, 9)
    assert got["bad"].error and got["none"].error and got["bad"].width is None


def test_headers_behind_long_metadata(spark):
    segment = b"\xff\xe2" + struct.pack(">H", 65_535) + b"x" * 65_533
    end = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 50, 3) + b"y" * 100
    rows = [(f"{n}", bytearray(b"\xff\xd8\xff" + (segment * n)[1:] + (end if n else end[1:]))) for n in (0, 1, 3, 20)]
    rows += [("cut", bytearray(b"\xff\xd8" + segment * 3)), ("junk", bytearray(b"z" * 200_000)), ("none", None)]
    df = spark.createDataFrame([(n, d, 7) for n, d in rows], "path string, content binary, other int")
    got = pixels.headers(df)
    assert got.columns == ["path", "other", "width", "height", "format", "mode", "error"]
    got = {r.path: r for r in got.collect()}
    assert all((got[n].width, got[n].height, got[n].format, got[n].error) == (50, 30, "JPEG", None) for n in ("0", "1", "3", "20"))
    assert all(got[n].error and got[n].width is None and got[n].other == 7 for n in ("cut", "junk", "none"))


def test_leaks_between_unreadable_and_empty_sides(spark):
    schema = "class string, name string, emb array<double>, ok boolean"
    train = spark.createDataFrame([("a", "t1", [1.0, 0.0], True), ("a", "t2", [0.0, 1.0], False), ("b", "t3", [1.0, 0.0], True)], schema)
    val = spark.createDataFrame([("a", "v1", [0.9, 0.1], True), ("a", "v2", [1.0, 0.0], True)], schema)
    got = {(r.train_image, r.val_image) for r in leakage.cosine_pairs(train, val, 0.9).collect()}
    assert got == {("t1", "v2")}  # 0.9 itself is not above 0.9
    near = {r.train_image: r for r in leakage.nearest(train, val.withColumn("split", F.lit("val")), ("val",)).collect()}
    assert near["t1"].matched_image == "v2" and near["t2"].cosine_sim == -1.0 and near["t3"].matched_image is None
    assert leakage.cosine_pairs(train, val.limit(0), 0.0).count() == 0


def test_percentiles_by_three_definitions(spark):
    for values in ([5], [1, 2], [1, 2, 3, 4], [2, 2, 2, 9, 9]):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
        low = {r.percent: r.value for r in percentiles.lower(df, ["g"], "v", (0, 50, 100)).collect()}
        xs = sorted(values)
        assert low == {p: xs[min(len(xs) - 1, int(p / 100 * len(xs)))] for p in (0, 50, 100)}
        lin = {r.percent: r.value for r in percentiles.linear(df, ["g"], "v").collect()}
        assert all(abs(lin[p] - np.percentile(values, p)) < 1e-9 for p in percentiles.PERCENTILES)


def test_radius_agrees_with_shares(spark):
    cand = spark.createDataFrame([(100 + 40 * i, 80 + 30 * j) for i in range(6) for j in range(6)], "width int, height int")
    ref = spark.createDataFrame([(100 + 25 * i, 300 - 20 * i, i + 1) for i in range(8)], "width int, height int, n int")
    rows = resolution.reference_shares(cand, ref, (0.2,)).join(resolution.radius(cand, ref, 0.1), ["width", "height"]).collect()
    assert len(rows) == 36 and all((r.radius > 0.2) == (r.share <= 0.1) for r in rows)
    with pytest.raises(ValueError):
        resolution.guard_pool(0.05, 0.01, 0.1, 0.01)


def test_coverage_keeps_the_bucket_that_crosses(spark):
    sizes = [(1, 1)] * 5 + [(2, 1)] * 3 + [(1, 2)] * 2
    df = spark.createDataFrame(sizes, "width int, height int")
    kept = lambda c: [(r.width, r.height) for r in profile.head_images(df, c).where("kept").orderBy("rank").collect()]
    assert kept(0.5) == [(1, 1)] and kept(0.51) == [(1, 1), (2, 1)] and kept(1.0) == [(1, 1), (2, 1), (1, 2)]
    assert profile.head_buckets(df, 0.01).where("kept").count() == 1


def test_samples_are_prefixes_and_even(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    small, large = ({r.k for r in sampling.sample_n(df, "k", n, 4).collect()} for n in (10, 30))
    assert len(small) == 10 and small < large
    got = sorted(r.k for r in sampling.even_sample(df.withColumn("g", F.lit(1)), ["g"], "k", 7).collect())
    assert got == [int(i * 100 / 7) for i in range(7)]
    assert sampling.shuffled_wrapped(df, "k", 250, 1).count() == 250 and sampling.shuffled_wrapped(df.limit(0), "k", 5, 1).count() == 0


def test_attention(spark):
    a = np.random.default_rng(1).random((2, 4, 4))
    a /= a.sum(-1, keepdims=True)
    assert np.allclose(attention.rollout(list(a)).sum(-1), 1)
    w = attention.softmax_attention(np.ones((1, 2, 3)), np.ones((1, 4, 3)), np.array([True, True, False, False]))
    assert np.allclose(w[0, 0], [0.5, 0.5, 0, 0])
    df = spark.createDataFrame([("i", a.ravel().tolist())], "image string, weights array<double>")
    assert np.allclose(attention.received(df, 4).first().attn, a.mean(0).mean(0))


def test_heads_and_scorer(spark):
    rng = np.random.default_rng(2)
    x, w, a, b = rng.random((5, 4)), rng.random((3, 4)), rng.random((2, 4)), np.zeros((3, 2))
    assert np.allclose(scoring.lora(x, w, a, b, 8), x @ w.T)
    assert scoring.mlp(x, [(rng.random((6, 4)), np.zeros(6)), (rng.random((1, 6)), np.zeros(1))]).shape == (5, 1)
    df = spark.createDataFrame([(i, int(i >= 20), [float(i >= 20), 1.0]) for i in range(40)], "id int, label int, emb array<float>")
    got = scoring.scored(df, scoring.logistic_baseline(df)).collect()
    assert all((r.prob > 0.5) == bool(r.label) for r in got)


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    for name in ("b.PNG", "a.jpg", "x.txt", "c_a1.png"):
        (folder / name).write_bytes(b"GIF89a")
    found = readers.image_dir(spark, str(folder))
    assert sorted(r.name for r in found.collect()) == ["a.jpg", "b.PNG", "c_a1.png"]
    assert readers.not_augmented(found).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.image_dir(spark, str(tmp_path / "none"))
    assert readers.image_dir(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    path = tmp_path / "set-train-00000-of-00001.arrow"
    table = pa.table({"caption": ["x", "y"], "label": pa.array([0, 1], pa.int32()), "other": [1.0, 2.0]})
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert readers.arrow_shards([str(path)]) == {"train": [str(path)]}
    assert [tuple(r) for r in readers.arrow_table(spark, [str(path)], "label int, caption string").collect()] == [(0, "x"), (1, "y")]
    df = spark.createDataFrame([("a/b.bin", bytearray(b"1")), ("../x", bytearray(b"2"))], "file string, content binary")
    status = {r.file: r.status for r in sinks.files(df, str(tmp_path / "out")).collect()}
    assert status["a/b.bin"] == "written" and status["../x"].startswith("error")
    assert {r.status for r in sinks.files(df.limit(1), str(tmp_path / "out")).collect()} == {"kept"}
    sinks.csv(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, p double"), str(tmp_path / "csv"), {"p": 6})
    assert sorted(r.p or "" for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["", "0.500000"]


def test_streamed_histogram_is_the_whole_one(spark, tmp_path):
    schema = "label int, prob double"
    for i in range(3):
        spark.createDataFrame([(i % 2, 0.1 * i), (1, 0.95)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    update_histogram(stream, str(tmp_path / "hist"), str(tmp_path / "check")).awaitTermination(120)
    total = spark.read.parquet(str(tmp_path / "hist")).agg(F.sum("count_real"), F.sum("count_aigen")).first()
    assert tuple(total) == (2, 4)
