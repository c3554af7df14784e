"""Scalar functions on the cases that the specification lists, and on edges."""

import pytest
from pyspark.sql import functions as F
from siftwell.functions import scalars as fn
from siftwell.operators import calibration, etl, evaluation

W25 = " ".join(f"word{i}" for i in range(25))
OUTPUTS = [
    (f"<think>hidden</think><analysis>MEDIUM: photo</analysis>\n<prompt>{W25}</prompt>", "ok", W25, "MEDIUM: photo", None),
    (f"<analysis>a</analysis><prompt>{W25}", "truncated", W25, "a", None),
    ("<error>NO_IMAGE</error>", "failed", None, None, "NO_IMAGE"),
    (f"<analysis>end with <prompt>...</prompt> as shown</analysis> <prompt>{W25}</prompt>", "ok", W25, "end with <prompt>...</prompt> as shown", None),
    ("<prompt>too few words</prompt>", "failed", "too few words", None, None),
    (None, "failed", None, None, None),
    ("", "failed", None, None, None),
]


def test_caption_outputs(spark):
    rows = spark.createDataFrame([(str(i), o[0]) for i, o in enumerate(OUTPUTS)], "image_id string, raw_output string")
    got = {int(r.image_id): r for r in etl.caption_records(rows).collect()}
    for i, (_, status, prompt, analysis, error) in enumerate(OUTPUTS):
        assert (got[i].status, got[i].prompt, got[i].analysis, got[i].error) == (status, prompt, analysis, error), i


@pytest.mark.parametrize(
    "size, planned",
    [((1024, 768), (1024, 768)), ((1024, 685), (1024, 672)), ((100, 50), (512, 256)), ((4000, 3000), (2048, 1536)), ((2048, 256), (2048, 256)), ((3000, 300), None), ((0, 5), None)],
)
def test_planned_sizes(spark, size, planned):
    row = spark.createDataFrame([size], "w int, h int").select(fn.planned_size(F.col("w"), F.col("h")).alias("s")).first().s
    assert ((row.width, row.height) if row.error is None else None) == planned


def test_names(spark):
    cases = {"/a/b.c/x.tar.gz": ("x.tar", ".gz"), ".hidden": (".hidden", ""), "x": ("x", ""), "d/x.PNG": ("x", ".PNG")}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", fn.stem(F.col("p")).alias("s"), fn.suffix(F.col("p")).alias("e"))
    assert {r.p: (r.s, r.e) for r in rows.collect()} == cases
    stems = {"x_a1": "x", "x_a12": "x", "x_a": "x_a", "x_a1_b": "x_a1_b", "a_a3": "a"}
    rows = spark.createDataFrame([(k,) for k in stems], "p string").select("p", fn.strip_augmented(F.col("p")).alias("s"))
    assert {r.p: r.s for r in rows.collect()} == stems


def test_formats_and_urls(spark):
    data = [(b"\xff\xd8\xff\xe0", "jpg"), (b"\x89PNG\r\n\x1a\n0", "png"), (b"RIFF1234WEBPVP8 ", "webp"), (b"GIF89a", "gif"), (b"BM1", "bmp"), (b"", "bin")]
    rows = spark.createDataFrame([(bytearray(a), b) for a, b in data], "c binary, want string").select("want", fn.sniffed_extension(F.col("c")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())
    urls = [("http://h/a.JPG?x=1", None, ".jpg"), ("http://h/a", "image/webp", ".webp"), ("http://h/a.txt", "text/plain", ".png"), (None, None, ".png")]
    rows = spark.createDataFrame(urls, "u string, c string, want string").select("want", fn.picked_extension(F.col("u"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_box_rounds_halves_to_even_and_grid_is_maximal(spark):
    row = spark.range(1).select(fn.centred_box(F.lit(10), F.lit(10), F.lit(1.0), F.lit(0.0625)).alias("b")).first().b
    assert (row.l, row.t, row.r, row.b) == (4, 4, 6, 6)
    for w, h in ((1024, 768), (100, 100), (5000, 20), (333, 777)):
        g = spark.range(1).select(fn.patch_grid(F.lit(w), F.lit(h)).alias("g")).first().g
        assert g.rows * g.cols <= 256
        step = min(g.rows * 16 / h, g.cols * 16 / w) * (1 + 1e-9) + 1e-12
        assert max(1, -(-h * step // 16)) * max(1, -(-w * step // 16)) > 256


def test_buckets_and_calibration_edges(spark):
    scores = [0.0, 0.1, 0.7, 0.95, 1.0]
    rows = spark.createDataFrame([(x,) for x in scores], "c double").select("c", fn.bucket_of(F.col("c"), 10).alias("b"))
    assert {r.c: r.b for r in rows.collect()} == {x: min(int(x * 10), 9) for x in scores}
    p = spark.createDataFrame([(0, 0.05), (1, 0.05), (1, 0.95)], "label int, prob double")
    got = {r.bucket: r for r in calibration.table(calibration.histogram(p, 10), 10, 0.5, 0.0).collect()}
    assert got[2].p_aigen_given_c is None and got[2].predicted_label is None and got[2].empirical_p_aigen is None
    assert got[10].predicted_label == "ai_gen" and got[10].confidence == 1.0
    empty = calibration.table(calibration.histogram(p.limit(0), 10), 10).collect()
    assert all(r.p_aigen_given_c == 0.5 and r.predicted_label == "ai_gen" for r in empty)


def test_rates_without_cases_are_zero(spark):
    p = spark.createDataFrame([("a", 0, 0.4), ("b", 0, 0.5)], "path string, label int, prob double")
    row = evaluation.metrics(evaluation.confusion(evaluation.classify(p, 0.6))).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (0, 0, 0, 2) and row.precision == 0.0 and row.f1 == 0.0 and row.real_accuracy == 1.0
    assert evaluation.classify(p, 0.5).where("pred = 1").count() == 1
    means = evaluation.mean_prob_by_class(p).first()
    assert means.mean_prob_aigen is None


def test_texts(spark):
    row = spark.createDataFrame([("```json\n a  b\n```", "a </think> b </THINK> c")], "x string, y string").select(fn.cleaned(F.col("x")).alias("x"), fn.without_thinking(F.col("y")).alias("y")).first()
    assert (row.x, row.y) == ("a b", " c")
    parts = spark.createDataFrame([('[{"type":"text","text":"a"},{"text":"b"}]',), ("plain",), (None,)], "c string").select(fn.content_text(F.col("c")).alias("t"))
    assert [r.t for r in parts.collect()] == ["a\nb", "plain", ""]
