"""Dataset jobs: filters, merges, pairs, label and caption composition, export plans, caption records, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import caption_status, parsed_output, sniffed_extension
from .sampling import numbered


def filter_labels(df: DataFrame, label_a: int, label_b: int | None = None) -> DataFrame:
    rows = df.where(F.col("label_a") == label_a)
    return rows if label_b is None else rows.where(F.col("label_b") == label_b)


def merge_first(sources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each name, the first by (source, name); names that the target has are skipped."""
    first = Window.partitionBy("name").orderBy("source", "path")
    rows = sources.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows if existing is None else rows.join(existing.select("name"), "name", "left_anti")


def first_per_stem(files: DataFrame) -> DataFrame:
    """The first file of each stem by name, hidden ones left out, and how many it hides."""
    seen = files.where(~F.startswith(F.col("name"), F.lit(".")))
    here = Window.partitionBy("stem")
    return seen.withColumn("hidden", F.count("*").over(here) - 1).withColumn("__n", F.row_number().over(here.orderBy("name"))).where("__n = 1").drop("__n")


def last_per_stem(files: DataFrame) -> DataFrame:
    return files.groupBy("stem").agg(F.max("path").alias("path"))


def stem_pairs(real: DataFrame, fake: DataFrame) -> DataFrame:
    """stem, real, fake: files of both sides under one stem, the first by path of each."""
    first = lambda df, as_: df.groupBy("stem").agg(F.min("path").alias(as_))
    return first(real, "real").join(first(fake, "fake"), "stem")


def missing_stems(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.select("stem").distinct().join(known.select("stem"), "stem", "left_anti")


def label_pairs(df: DataFrame) -> DataFrame:
    """label_a, label_b, n, share and consistent: whether a pair keeps label_a = (label_b <> 0)."""
    counts = df.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), ((F.col("label_a") == 0) == (F.col("label_b") == 0)).alias("consistent"))


def composition(df: DataFrame, group: str, label: str, top: int | None = None) -> DataFrame:
    """composition (label x count, sorted by label) and the number of groups that have it, most frequent first."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("label"), "n"))), lambda x: F.concat_ws("x", x["label"], x["n"].cast("string"))), " ")
    out = counts.groupBy(group).agg(text.alias("composition")).groupBy("composition").agg(F.count("*").alias("groups"))
    return out if top is None else out.orderBy(F.desc("groups"), "composition").limit(top)


def block_order(df: DataFrame, shard: str, row: str, caption: str, label: str, size: int = 6) -> DataFrame:
    """ordered and blocks: how many runs of size rows have the labels 0, 1, ... in order and one caption; the last may be short."""
    rows = numbered(df, shard, row).withColumn("block", F.floor(F.col("global_row") / size))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("global_row", F.col(label).cast("int").alias("label")))).alias("rows"), F.count_distinct(caption).alias("captions"), F.count(caption).alias("with_caption"))
    right = (F.transform("rows", lambda x: x["label"]) == F.array(*[F.lit(i) for i in range(size)])) & (F.col("captions") == 1) & (F.col("with_caption") == size)
    return blocks.agg(F.count_if(right).alias("ordered"), F.count("*").alias("blocks"))


def resolution_by_label(df: DataFrame, label: str = "label", top: int = 3) -> DataFrame:
    """label, images, resolutions, square_share and the top resolutions as text."""
    counts = df.groupBy(label, "width", "height").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "width", "height"))), 1, top)
    text = F.array_join(F.transform(best, lambda x: F.concat(x["width"].cast("string"), F.lit("x"), x["height"].cast("string"))), " ")
    return counts.groupBy(label).agg(F.sum("n").alias("images"), F.count("*").alias("resolutions"), (F.sum(F.when(F.col("width") == F.col("height"), F.col("n")).otherwise(0)) / F.sum("n")).alias("square_share"), text.alias("top"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("duplicates"))


def route_labels(df: DataFrame, folders: dict[int, str]) -> DataFrame:
    """folder by label, null for labels without one."""
    known = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])
    return df.withColumn("folder", F.try_element_at(known, F.col("label")))


def routed_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("folder", F.lit("(unknown)")).alias("folder")).agg(F.count("*").alias("n"))


def export_names(df: DataFrame, alias: str, shard: str, row: str, ext: str, wanted) -> DataFrame:
    """global_row and file of the wanted rows; rows are numbered over the whole split, wanted or not."""
    every = numbered(df, shard, row)
    return every.where(wanted).withColumn("file", F.format_string(f"{alias}_%06d_b%d{ext}", "global_row", F.col("label_b").cast("int")))


def next_index(names: DataFrame, stem: str) -> DataFrame:
    """One past the largest number of names such as <stem>_000012.png; 1 if there is none."""
    n = F.regexp_extract("name", rf"\A{stem}_([0-9]{{6,}})\.", 1).try_cast("int")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def caption_records(outputs: DataFrame, min_words: int = 20) -> DataFrame:
    """image_id, status, prompt, analysis, error, truncated and n_words of raw outputs (image_id, raw_output)."""
    parsed = outputs.withColumn("parsed", parsed_output(F.col("raw_output")))
    words = F.when(F.col("parsed.prompt").isNull(), 0).otherwise(F.size(F.split("parsed.prompt", " ")))
    return parsed.select("image_id", caption_status(F.col("parsed"), min_words).alias("status"), "parsed.prompt", "parsed.analysis", "parsed.error", "parsed.truncated", words.alias("n_words"))


def usable(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("ok", "truncated") & (F.trim("prompt") != ""))


def todo(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items without a finished record; failed ones and errors are tried again."""
    done = records.where(F.col("status").isin("ok", "truncated")).select("image_id").distinct()
    return items.join(done, "image_id", "left_anti")


def without_output(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items for which no file <id>.* exists, notes of errors left out."""
    made = files.where(~F.endswith(F.col("name"), F.lit(".error.txt"))).select(F.regexp_extract("name", r"\A(.*?)\.[^.]*\z", 1).alias("image_id")).distinct()
    return items.join(made, "image_id", "left_anti")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def last_attempts(attempts: DataFrame) -> DataFrame:
    """The status of each image's last attempt, whatever an earlier one found."""
    return attempts.groupBy("image_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))


def next_turns(turns: DataFrame) -> DataFrame:
    """User turns with the assistant's next turn."""
    u = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def caption_sections(records: DataFrame) -> DataFrame:
    """image_id and sections: the KEY: value lines of each analysis as a map; of a repeated key the last line counts."""
    lines = F.filter(F.split(F.coalesce("analysis", F.lit("")), r"\n"), lambda x: F.regexp_like(x, F.lit(r"\A\s*[A-Za-z][A-Za-z0-9 _/-]*:")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"\A([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"\A[^:]*:(.*)", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return records.select("image_id", F.map_from_entries(last).alias("sections"))


def messages(images: DataFrame, prompt: str, question: str) -> DataFrame:
    """image_id and the chat payload (JSON) of rows (image_id, url: of the image, inline or not)."""
    system = F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.to_json(F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.lit(question).alias("text"))), F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(F.col("url")).alias("image_url"))))).alias("content"))
    return images.select("image_id", F.to_json(F.array(system, user)).alias("messages"))


def called(requests: DataFrame, build, attempts: int = 3) -> DataFrame:
    """image_id, raw_output, attempts, error of requests (image_id, messages). build gives, once for each task, a client: a function from messages to an answer.

    A failing call is tried again; a request whose last try fails is a row with the error.
    """
    import pyarrow as pa

    def run(batches):
        client = build()
        for batch in batches:
            rows = []
            for image_id, message in zip(batch.column("image_id").to_pylist(), batch.column("messages").to_pylist(), strict=True):
                for n in range(1, attempts + 1):
                    try:
                        rows.append((image_id, client(message), n, None))
                        break
                    except Exception as e:  # the client's failures are rows
                        if n == attempts:
                            rows.append((image_id, None, n, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["image_id", "raw_output", "attempts", "error"])

    return requests.select("image_id", "messages").mapInArrow(run, "image_id string, raw_output string, attempts int, error string")


def out_dir(prefix: str, alias: str) -> str:
    return f"{prefix}_detactify_{alias}"


def title(text: str, width: int = 100) -> str:
    """A section's title between two lines."""
    return "\n".join(["", "=" * width, text, "=" * width])


def counter_lines(counts: dict[str, int], top: int = 10) -> str:
    """name: n (share), the most frequent first."""
    total = max(1, sum(counts.values()))
    ordered = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:top]
    return "\n".join(f"{k}: {n} ({n / total:.1%})" for k, n in ordered)


def grid_text(cells: list[dict], current: tuple[float, float], pool: tuple[float, float]) -> str:
    """A table of images by tol (rows) and max_share (columns): * marks the current setting, + those outside of the pool."""
    tols, shares = sorted({c["tol"] for c in cells}), sorted({c["max_share"] for c in cells})
    found = {(c["tol"], c["max_share"]): c["images"] for c in cells}

    def shown(tol: float, share: float) -> str:
        mark = "*" if (tol, share) == current else "+" if tol < pool[0] or share > pool[1] else ""
        return f"{found.get((tol, share), 0)}{mark}".rjust(10)

    return "\n".join(["tol".rjust(6) + "".join(f"{s:.1%}".rjust(10) for s in shares), *[f"{t:.2f}".rjust(6) + "".join(shown(t, s) for s in shares) for t in tols]])


def routed_files(df: DataFrame, folders: dict[int, str]) -> DataFrame:
    """file and content of rows (img_id, label, content): <folder of the label>/<img_id>.<extension that the bytes say>. Rows of unknown labels are left out (routed_counts counts them); repeated ids stay, each with its file."""
    routed = route_labels(df, folders).where("folder is not null")
    return routed.select(F.concat("folder", F.lit("/"), F.col("img_id").cast("string"), F.lit("."), sniffed_extension(F.col("content"))).alias("file"), "content")


def table_text(rows: list[dict], columns: list[str], digits: int = 4) -> str:
    """Rows as lines of columns, numbers to the right."""
    shown = [[f"{r[c]:.{digits}f}" if isinstance(r[c], float) else "" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(c), *(len(s[i]) for s in shown)) if shown else len(c) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(c.rjust(w) for c, w in zip(cells, widths, strict=True))
    return "\n".join([line(columns), *map(line, shown)])
