"""Column functions: names, formats, sizes, scores and captions. All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# names ------------------------------------------------------------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; empty for none or for a name that only starts with a dot."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def strip_augmented(stem_: Column) -> Column:
    return F.regexp_replace(stem_, r"_a[0-9]+$", "")


def is_augmented(stem_: Column) -> Column:
    return F.regexp_like(stem_, F.lit(r"_a[0-9]+$"))


def seeded_order(seed: int, key: Column) -> Column:
    """A text whose order is a shuffle that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone (52 bits of a digest)."""
    return F.conv(F.substring(seeded_order(seed, key), 1, 13), 16, 10).cast("double") / float(1 << 52)


# formats ----------------------------------------------------------------------------------------------------------------
# Extensions by the first bytes of a file, in hexadecimal.
MAGIC = (("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"))
# The format that an extension promises.
EXTENSION_FORMATS = {".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".webp": "WEBP", ".gif": "GIF", ".bmp": "BMP", ".tif": "TIFF", ".tiff": "TIFF"}


def sniffed_extension(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
    for magic, ext in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), ext)
    return out.otherwise("bin")


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(content), "\r\n", ""))  # without line breaks


def picked_extension(url: Column, content_type: Column) -> Column:
    """The extension of a url's path if it is an image's, else the content type's, else .png."""
    ext = F.lower(suffix(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))
    by_type = F.when(content_type == "image/jpeg", ".jpg").when(content_type == "image/webp", ".webp").otherwise(".png")
    return F.when(ext.isin(".png", ".jpg", ".jpeg", ".webp"), ext).otherwise(by_type)


# sizes ------------------------------------------------------------------------------------------------------------------
def long_bucket(w: Column, h: Column) -> Column:
    # The names of the buckets, here and below.
    n = F.greatest(w, h)
    return F.when(n < 512, "long<512").when(n < 1024, "512<=long<1024").when(n == 1024, "long=1024").when(n < 2048, "1024<long<2048").otherwise("long>=2048")


def aspect_bucket(w: Column, h: Column) -> Column:
    return F.when(2 * w <= h, "w/h<=0.5").when(w < h, "portrait").when(w == h, "square").when(w < 2 * h, "landscape").otherwise("w/h>=2")


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").when(w < h, "portrait").otherwise("square")


def measures(w: Column, h: Column) -> dict[str, Column]:
    """The six measures of a size that profiles report."""
    w, h = w.cast("double"), h.cast("double")
    return {"width": w, "height": h, "short": F.least(w, h), "long": F.greatest(w, h), "aspect": w / h, "megapixels": w * h / 1e6}


def log2_distance(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.greatest(F.abs(F.log2(w1) - F.log2(w2)), F.abs(F.log2(h1) - F.log2(h2)))


def planned_size(w: Column, h: Column, least: int = 256, most: int = 2048, step: int = 32) -> Column:
    """struct(width, height, error): up to a short side of least, down to a long side of most, floored to a step."""
    w, h = w.cast("double"), h.cast("double")
    scale = F.least(F.greatest(F.lit(1.0), F.try_divide(F.lit(float(least)), F.least(w, h))), F.try_divide(F.lit(float(most)), F.greatest(w, h)))
    floored = lambda side: (F.floor(F.floor(side * scale) / step) * step).cast("int")
    valid = (w > 0) & (h > 0)
    fits = valid & (F.least(floored(w), floored(h)) >= least)
    error = F.when(~F.coalesce(valid, F.lit(False)), "invalid size").when(~fits, "aspect ratio too extreme")
    return F.struct(F.when(fits, floored(w)).alias("width"), F.when(fits, floored(h)).alias("height"), error.alias("error"))


def record_size(width: Column, height: Column) -> Column:
    """planned_size of a caption record's texts; 1024 x 1024 where they are missing or no positive whole numbers."""
    w, h = (F.coalesce(x.try_cast("int"), F.lit(0)) for x in (width, height))
    fallback = F.struct(F.lit(1024).alias("width"), F.lit(1024).alias("height"), F.lit(None).cast("string").alias("error"))
    return F.when((w > 0) & (h > 0), planned_size(w, h)).otherwise(fallback)


def downscaled(w: Column, h: Column, max_pixels: int) -> Column:
    """struct(width, height) of an image shrunk to max_pixels at most."""
    s = F.least(F.lit(1.0), F.sqrt(max_pixels / (w.cast("double") * h)))
    side = lambda x: F.when(s < 1, F.greatest(F.lit(1), F.floor(x * s).cast("int"))).otherwise(x.cast("int"))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def max_coverage(w: Column, h: Column, aspect: Column) -> Column:
    s = w.cast("double") / h
    return F.least(s / aspect, aspect / s)


def centred_box(w: Column, h: Column, aspect: Column, cover: Column) -> Column:
    """struct(l, t, r, b): a centred box of that aspect that covers that share; halves round to even."""
    cw = F.least(w.cast("int"), F.greatest(F.lit(1), F.bround(F.sqrt(cover * w * h * aspect)).cast("int")))
    ch = F.least(h.cast("int"), F.greatest(F.lit(1), F.bround(cw / aspect).cast("int")))
    left, top = F.floor((w - cw) / 2).cast("int"), F.floor((h - ch) / 2).cast("int")
    return F.struct(left.alias("l"), top.alias("t"), (left + cw).alias("r"), (top + ch).alias("b"))


def scale_direction(scale: Column, slack: float = 0.0005) -> Column:
    return F.when(scale > 1 + slack, "up").when(scale < 1 - slack, "down").otherwise("same")


def parsed_size(text: Column) -> Column:
    """struct(width, height) of a text such as 640x480."""
    part = lambda i: F.try_element_at(F.split(F.lower(text), "x"), F.lit(i)).try_cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def patch_grid(w: Column, h: Column, patch: int = 16, most: int = 256) -> Column:
    """struct(rows, cols): the largest grid of patches that keeps the aspect, with sides rounded up, within most patches.

    The grid only changes where one side gains a patch: the scales at which that happens are tried in closed form.
    """
    count = lambda x, s: F.greatest(F.lit(1), F.ceil(x * s / patch - 1e-9)).cast("int")
    steps = lambda x: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: k * float(patch) / x)
    best = F.array_max(F.filter(F.concat(steps(w), steps(h)), lambda s: count(h, s) * count(w, s) <= most))
    side = lambda x: count(x, best)
    return F.struct(F.coalesce(side(h), F.lit(1)).alias("rows"), F.coalesce(side(w), F.lit(1)).alias("cols"))


# scores -----------------------------------------------------------------------------------------------------------------
def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bucket_of(c: Column, buckets: int) -> Column:
    """0-based; 1.0 falls into the last bucket."""
    return F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")


def wrong_confidence(prob: Column, pred: Column) -> Column:
    return F.when(pred == 1, prob).otherwise(1 - prob)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# captions ---------------------------------------------------------------------------------------------------------------
def without_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)\A.*</think>", "")


def cleaned(text: Column) -> Column:
    # Fixed value: a line that opens or closes a block of code.
    plain = F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z0-9_-]*\s*$", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def parsed_output(text: Column) -> Column:
    """struct(prompt, analysis, error, truncated) of a model's answer: the last prompt tag counts, the first of the others."""
    body = without_thinking(F.coalesce(text, F.lit("")))
    opened = F.regexp_like(body, F.lit(r"(?i)<prompt(\s[^>]*)?>"))
    tail = F.regexp_extract(body, r"(?is)\A.*<prompt(?:\s[^>]*)?>(.*)\z", 1)
    closed = F.regexp_like(tail, F.lit(r"(?i)</prompt\s*>"))
    prompt = cleaned(F.regexp_replace(tail, r"(?is)</prompt\s*>.*\z", ""))
    tag = lambda name: F.when(F.regexp_like(body, F.lit(f"(?is)<{name}>.*?</{name}>")), F.regexp_replace(F.regexp_extract(body, f"(?is)<{name}>(.*?)</{name}>", 1), r"\A\s+|\s+\z", ""))
    return F.struct(F.when(opened & (prompt != ""), prompt).alias("prompt"), tag("analysis").alias("analysis"), tag("error").alias("error"), (opened & ~closed).alias("truncated"))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def caption_status(parsed: Column, min_words: int = 20) -> Column:
    short = parsed["prompt"].isNull() | (word_count(parsed["prompt"]) < min_words)
    return F.when(short, "failed").when(parsed["truncated"], "truncated").otherwise("ok")


def content_text(content: Column) -> Column:
    """The text of a chat message: itself, or the texts of a JSON list of parts, a line each."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parts.isNotNull(), joined).otherwise(F.coalesce(content, F.lit("")))


def step_label(step: Column) -> Column:
    """name(key=value,...) of an augmentation step; seeds are left out."""
    shown = F.filter(F.map_entries(step["params"]), lambda e: e["key"] != "seed")
    text = F.array_join(F.transform(shown, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.when(text == "", step["name"]).otherwise(F.concat(step["name"], F.lit("("), text, F.lit(")")))


def plan_label(steps: Column) -> Column:
    return F.when(F.size(steps) == 0, "identity").otherwise(F.array_join(F.transform(steps, step_label), " -> "))


def round_label(augment: Column, variant: Column) -> Column:
    return F.when(augment == "none", augment).otherwise(F.concat(augment, F.lit("("), variant, F.lit(")")))


def sample_name(rank: Column, w: Column, h: Column, i: Column, name: Column) -> Column:
    return F.format_string("r%d_%dx%d_%d_%s", rank, w, h, i, name)
