"""6. Benchmark decontamination by a prefix-filtered set join, with built-in functions alone.

An item's windows are its runs of 10 consecutive words (an item of fewer is one window). A window is a set of shingles, all
of which a document must hold; with the shingles in a global order, rarest first, the prefix that a containing document
cannot miss is one shingle long. Documents' shingles are joined with these prefixes; a hit is kept if the window, placed
by the shingle's position in both, lies inside the document (length and positional bounds) and its words are the
document's words there (verification).

The prefixes are broadcast while the windows are fewer than a documented bound, and joined by a shuffle beyond it.

Null and empty texts have no words, are not hit and hit nothing. Items without words make no window. Items of equal text
are each listed. Rows with the same id or text stay separate rows, a null id stays null (a null item id is not listed), and
columns other than the ids and the texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words in a window.
WINDOW = 10
#: Words in a shingle, at most: windows of fewer words are one shingle.
SHINGLE = 5
#: Distinct windows up to which their prefixes are broadcast: 200,000 of about 150 bytes are some 30 MB.
BROADCAST_WINDOWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of that many words, in order."""
    last = F.size(words) - (size - 1)
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.lit(size), *[F.element_at(words, i + k) for k in range(size)]))
    return F.when(last >= 1, hashed).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of items (item_id, words): window_id, window (its words), shingles, item_ids."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    each = items.where(n > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, F.lit(window)))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def prefixes(windows: DataFrame) -> DataFrame:
    """One row for each window: window_id, window, key (its rarest shingle), size (that shingle's words), offset (in the window)."""
    windows = windows.withColumn("window_id", F.xxhash64("window"))
    by_size = None
    for size in range(SHINGLE, 0, -1):
        own = F.size("window") >= SHINGLE if size == SHINGLE else F.size("window") == size
        some = windows.where(own).select("window_id", "window", F.posexplode(_shingles(F.col("window"), size)).alias("offset", "key"), F.lit(size).alias("size"))
        by_size = some if by_size is None else by_size.unionByName(some)
    counts = by_size.groupBy("key", "size").agg(F.count("*").alias("windows"))
    return by_size.join(counts, ["key", "size"]).groupBy("window_id", "window").agg(F.min(F.struct("windows", "key", "size", "offset")).alias("rarest")).select("window_id", "window", "rarest.key", "rarest.size", "rarest.offset")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, n_words, n_hit, item_ids (sorted as strings) and spans (of words hit) of every row of docs."""
    names, keep = keep, tuple(f"kept_{i}" for i in range(len(keep)))
    docs = docs.select(*[F.col(x).alias(k) for x, k in zip(names, keep, strict=True)], F.col("text").cast("string").alias("text"))
    items = items.select("item_id", words(F.col("text").cast("string")).alias("words"))
    windows = cut(windows_of(items, window), "benchmark-windows")
    wanted = cut(prefixes(windows.select("window")), "benchmark-prefixes")
    found = wanted.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    keys = wanted.select("key", "offset", "window", "window_id")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, words(F.col("text")).alias("words"))
    # the document's own row comes first, as a shingle that no window has, so that documents without a hit stay
    marked = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("key"))), *[F.transform(_shingles(F.col("words"), s), lambda h, i: F.struct(i.alias("at"), h.alias("key"))) for s in sorted(found["sizes"])])
    if found["n"] <= BROADCAST_WINDOWS:
        joined = rows.select("row", *keep, "words", F.inline(marked)).join(F.broadcast(keys), "key", "left")
    else:  # the shingles travel without the texts; the texts of documents with a candidate are joined afterwards
        rows = cut(rows, "benchmark-rows")  # a row's number is told once
        probes = rows.select("row", F.inline(marked)).where("key is not null")
        near = probes.join(keys.drop("window"), "key").select("row", "at", "offset", "window_id")
        near = rows.join(near, "row").join(keys.select("window_id", "window"), "window_id")
        own = rows.withColumns({"at": F.lit(-1), "offset": F.lit(0), "window_id": F.lit(None).cast("bigint"), "window": F.lit(None).cast("array<string>")})
        joined = near.unionByName(own)
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.when(fits, F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("window"), F.lit(1))) == F.col("window")).otherwise(False)
    joined = joined.where((F.col("at") == -1) | F.coalesce(same, F.lit(False)))
    hit = F.when(F.col("at") >= 0, F.struct(start.cast("int").alias("start"), (start + F.size("window")).cast("int").alias("end"), "window_id"))
    hits = joined.groupBy("row", *keep).agg(F.max(F.when(F.col("at") == -1, F.size("words"))).cast("long").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"))
    hits = cut(hits, "benchmark-hits")

    def cover(acc: Column, x: Column) -> Column:
        more = F.greatest(x["end"] - F.greatest(acc["end"], x["start"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda a: a["n"].cast("long"))
    spans = F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    hits = hits.select("row", *keep, "n_words", covered.alias("n_hit"), F.array_distinct(spans).alias("spans"), F.array_distinct(F.transform("hits", lambda x: x["window_id"])).alias("window_ids"))
    listed = windows.select(F.xxhash64("window").alias("window_id"), F.explode("item_ids").alias("item_id"))
    per_doc = hits.select("row", F.explode("window_ids").alias("window_id")).join(listed, "window_id").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    none = F.array().cast("array<string>")
    return hits.join(per_doc, "row", "left").select(*[F.col(k).alias(x) for x, k in zip(names, keep, strict=True)], "n_words", "n_hit", F.coalesce("item_ids", none).alias("item_ids"), "spans")


def op6_decontamination(spark, sf_dir):
    from .common import table

    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same rows in DuckDB: windows as joined words, compared with every run of as many words of a document.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM v),
p AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, s WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM p JOIN v ON v.k = p.k AND v.win = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
