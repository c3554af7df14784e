"""The queries of the library's own operators on stand-in tables, and SQL that gives the same rows.

Predictions are lineitems (the score is ten times the discount), sizes are (quantity, line number), files are documents
(format: language, mode: source, bytes: characters), leaks are looked for between documents' sources and embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import percentiles as pct
from ..functions import scalars as fn
from ..operators import attention, calibration, etl, evaluation, features, leakage, planning, profile, resolution, sampling, scoring

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

K, DIGITS = 10, 6


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Sums of fractions depend on their order: results are compared to six digits."""
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Registers a query under its function's name; doubles are the columns that sql rounds."""

    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            shown = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if shown else sql
        return f

    return register


# stand-ins --------------------------------------------------------------------------------------------------------------
def predictions(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem")
    path = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.select(path.alias("path"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("prob"), F.col("l_linestatus").alias("augment"), F.col("l_linenumber").cast("string").alias("variant"))


PRED = "(SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS path, CAST(l_returnflag = 'R' AS INT) AS label, l_discount * 10 AS prob, CAST(l_discount * 10 >= 0.5 AS INT) AS pred, l_linestatus AS augment, CAST(l_linenumber AS VARCHAR) AS variant FROM lineitem)"


def headers(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_quantity").cast("int").alias("width"), F.col("l_linenumber").cast("int").alias("height"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"))


DIMS = "(SELECT l_returnflag AS split, CAST(l_quantity AS INT) AS width, CAST(l_linenumber AS INT) AS height, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS path FROM lineitem)"


def files(spark, d) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("."), F.col("lang")).alias("ext"), F.col("source").alias("mode"), F.col("lang").alias("format"), F.col("n_chars").alias("bytes"))


def items(spark, d) -> DataFrame:
    """Documents as files: the bytes are the text, its picture is the text with each run of blanks as one."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    picture = F.regexp_replace("text", r"[ \t\r\n]+", " ")
    return t(spark, d, "documents").select(F.col("lang").alias("class"), F.when(n < 16, "train").otherwise("val").alias("split"), F.col("doc_id").cast("string").alias("name"), leakage.content_hash(F.col("text")).alias("byte_hash"), leakage.content_hash(picture).alias("pixel_hash"))


ITEMS = "(SELECT lang AS class, CASE WHEN CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) < 16 THEN 'train' ELSE 'val' END AS split, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS byte_hash, sha256(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS pixel_hash FROM documents)"
EXACT = f"(SELECT t.class, t.name AS train_image, v.name AS val_image, CASE WHEN t.byte_hash = v.byte_hash THEN 'byte' ELSE 'pixel' END AS match_type FROM {ITEMS} t JOIN {ITEMS} v ON t.class = v.class AND t.pixel_hash = v.pixel_hash WHERE t.split = 'train' AND v.split = 'val')"


def vectors(spark, d) -> DataFrame:
    part = F.col("vec_id") % 5
    split = F.when(part == 0, "val").when(part == 1, "test").otherwise("train")
    size = leakage.dot(F.col("embedding"), F.col("embedding"))
    ok = F.coalesce((size > 0) & (size < float("inf")), F.lit(False))  # readable: finite and not all 0
    return t(spark, d, "embeddings").select(F.lit("all").alias("class"), split.alias("split"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("emb"), ok.alias("ok"), "vec_id", "label")


READABLE = "coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 AND isfinite(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), false)"
VEC = f"(SELECT 'all' AS class, CASE vec_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, CAST(vec_id AS VARCHAR) AS name, CAST(embedding AS DOUBLE[]) AS emb, {READABLE} AS ok FROM embeddings)"
COSINE, THRESHOLD = "list_dot_product(t.emb, v.emb)", 0.4
SIMILAR = f"(SELECT t.class, t.name AS train_image, v.name AS val_image, {COSINE} AS cosine_sim FROM {VEC} t JOIN {VEC} v ON t.class = v.class WHERE t.split = 'train' AND v.split = 'val' AND t.ok AND v.ok AND {COSINE} > {THRESHOLD})"


# evaluation -------------------------------------------------------------------------------------------------------------
CELLS = "count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND label = 0) AS tn"
RATES = "coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0.0) AS real_accuracy, coalesce(tp / nullif(tp + fn, 0), 0.0) AS aigen_accuracy"
NAMES = " ".join(evaluation.METRICS)


@query(f"SELECT {CELLS} FROM {PRED}")
def confusion(spark, d):
    return evaluation.confusion(evaluation.classify(predictions(spark, d)))


@query(f"SELECT *, {RATES} FROM (SELECT {CELLS} FROM {PRED})", NAMES)
def classification_metrics(spark, d):
    return evaluation.metrics(evaluation.confusion(evaluation.classify(predictions(spark, d))))


@query("SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def label_agreement(spark, d):
    return t(spark, d, "labels").where("quality is not null and toxic is not null").groupBy(F.col("quality").alias("label"), F.col("toxic").alias("pred")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (WHERE label = 0) AS real, count(*) FILTER (WHERE label = 1) AS ai_gen, count(*) AS total FROM {PRED}")
def class_counts(spark, d):
    return evaluation.class_counts(predictions(spark, d))


@query(f"SELECT avg(prob) FILTER (WHERE label = 0) AS mean_prob_real, avg(prob) FILTER (WHERE label = 1) AS mean_prob_aigen FROM {PRED}", "mean_prob_real mean_prob_aigen")
def mean_prob_by_class(spark, d):
    return evaluation.mean_prob_by_class(predictions(spark, d))


ROUNDS = f"(SELECT *, {RATES}, augment || '(' || variant || ')' AS round FROM (SELECT augment, variant, {CELLS}, count(*) FILTER (WHERE label = 0) AS real, count(*) FILTER (WHERE label = 1) AS ai_gen, count(*) AS total, avg(prob) FILTER (WHERE label = 0) AS mean_prob_real, avg(prob) FILTER (WHERE label = 1) AS mean_prob_aigen FROM {PRED} GROUP BY augment, variant))"


@query(f"SELECT * FROM {ROUNDS}", NAMES + " mean_prob_real mean_prob_aigen")
def round_result(spark, d):
    return evaluation.round_results(evaluation.classify(predictions(spark, d)))


@query(f"SELECT augment, {', '.join(f'avg({m}) AS {m}' for m in evaluation.METRICS)}, count(*) AS rounds FROM {ROUNDS} GROUP BY augment", NAMES)
def mean_metrics(spark, d):
    return evaluation.mean_metrics(evaluation.round_results(evaluation.classify(predictions(spark, d))))


FAIL = f"(SELECT path, label, CASE label WHEN 1 THEN 'ai_gen' ELSE 'real' END AS label_name, pred, CASE pred WHEN 1 THEN 'ai_gen' ELSE 'real' END AS pred_name, prob AS prob_aigen, CASE pred WHEN 1 THEN prob ELSE 1 - prob END AS confidence, CAST(row_number() OVER (PARTITION BY label ORDER BY CASE pred WHEN 1 THEN prob ELSE 1 - prob END DESC, path) AS INT) AS order_in_label FROM {PRED} WHERE pred <> label)"


@query(f"SELECT * FROM {FAIL}", "prob_aigen confidence")
def failures(spark, d):
    return evaluation.failures(evaluation.classify(predictions(spark, d)))


@query(f"SELECT * FROM {FAIL} WHERE order_in_label <= 20", "prob_aigen confidence")
def topk_failures(spark, d):
    return evaluation.top_failures(evaluation.classify(predictions(spark, d)), 20)


@query(f"SELECT path, label, prob FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY path, prob, augment, variant) AS n FROM {PRED}) WHERE n <= 50", "prob")
def limit_per_class(spark, d):
    return evaluation.limit_per_class(predictions(spark, d), 50).select("path", "label", "prob")


@query(f"WITH s AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {PRED} GROUP BY prob), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM s) SELECT sum(p * (lower + n / 2)) / nullif(sum(p) * sum(n), 0) AS auroc FROM c", "auroc")
def auroc(spark, d):
    return evaluation.auroc(predictions(spark, d))


# calibration ------------------------------------------------------------------------------------------------------------
HIST = f"(SELECT i.idx, coalesce(r, 0) AS count_real, coalesce(a, 0) AS count_aigen FROM (SELECT CAST(range AS INT) AS idx FROM range({K})) i LEFT JOIN (SELECT CAST(least(floor(prob * {K}), {K - 1}) AS INT) AS idx, count(*) FILTER (WHERE label = 0) AS r, count(*) FILTER (WHERE label = 1) AS a FROM {PRED} GROUP BY 1) c ON c.idx = i.idx)"
TABLE = f"(SELECT idx + 1 AS bucket, idx / {K} AS lower, (idx + 1) / {K} AS upper, count_real, count_aigen, lr AS p_c_given_real, la AS p_c_given_aigen, 1 - post AS p_real_given_c, post AS p_aigen_given_c, count_aigen / nullif(count_real + count_aigen, 0) AS empirical_p_aigen, CASE WHEN post >= 0.5 THEN 'ai_gen' WHEN post < 0.5 THEN 'real' END AS predicted_label, greatest(post, 1 - post) AS confidence FROM (SELECT *, la * prior / nullif(la * prior + lr * (1 - prior), 0) AS post FROM (SELECT *, (count_real + 1) / (sum(count_real) OVER () + {K}) AS lr, (count_aigen + 1) / (sum(count_aigen) OVER () + {K}) AS la, sum(count_aigen) OVER () / (sum(count_real) OVER () + sum(count_aigen) OVER ()) AS prior FROM {HIST})))"
TABLE_DOUBLES = "lower upper p_c_given_real p_c_given_aigen p_real_given_c p_aigen_given_c empirical_p_aigen confidence"


@query(f"SELECT * FROM {HIST}")
def bucket_histogram(spark, d):
    return calibration.histogram(predictions(spark, d), K)


@query(f"SELECT * FROM {HIST}")
def merge_histogram(spark, d):
    return calibration.merged(calibration.histogram(predictions(spark, d), K, ("variant",)))


@query(f"SELECT * FROM {TABLE}", TABLE_DOUBLES)
def calibration_table(spark, d):
    return calibration.table(calibration.histogram(predictions(spark, d), K), K)


@query(f"SELECT p.path, p.label, p.prob, CAST(least(floor(p.prob * {K}), {K - 1}) AS INT) + 1 AS bucket, c.predicted_label, c.confidence FROM {PRED} p JOIN {TABLE} c ON c.bucket = CAST(least(floor(p.prob * {K}), {K - 1}) AS INT) + 1", "prob confidence")
def calibration_lookup(spark, d):
    p = predictions(spark, d).select("path", "label", "prob")
    return calibration.lookup(p, calibration.table(calibration.histogram(p, K), K), K)


# profiles ---------------------------------------------------------------------------------------------------------------
P = pct.PERCENTILES
MEASURES = "(SELECT split, unnest(['width', 'height', 'short', 'long', 'aspect', 'megapixels']) AS measure, unnest([width::DOUBLE, height::DOUBLE, least(width, height)::DOUBLE, greatest(width, height)::DOUBLE, width::DOUBLE / height, width::DOUBLE * height / 1000000.0]) AS value FROM " + DIMS + ")"
QUANTILES = ", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in P)
PS = " ".join(f"p{p}" for p in P)


@query(f"SELECT split, measure, avg(value) AS mean, {QUANTILES} FROM {MEASURES} GROUP BY split, measure", "mean " + PS)
def profile_dims(spark, d):
    return profile.dims_profile(headers(spark, d))


@query(f"SELECT split, count(*) AS images, count(DISTINCT (width, height)) AS resolutions, avg(CASE WHEN width > height THEN 1.0::DOUBLE ELSE 0 END) AS landscape, avg(CASE WHEN width < height THEN 1.0::DOUBLE ELSE 0 END) AS portrait, avg(CASE WHEN width = height THEN 1.0::DOUBLE ELSE 0 END) AS square FROM {DIMS} GROUP BY split", "landscape portrait square")
def orientation_shares(spark, d):
    return profile.orientation_shares(headers(spark, d))


@query(f"SELECT split, count(*) AS images, count(DISTINCT (width, height)) AS resolutions, avg(CASE WHEN width > height THEN 1.0::DOUBLE ELSE 0 END) AS landscape, avg(CASE WHEN width < height THEN 1.0::DOUBLE ELSE 0 END) AS portrait, avg(CASE WHEN width = height THEN 1.0::DOUBLE ELSE 0 END) AS square, median(width::DOUBLE) AS median_width, median(height::DOUBLE) AS median_height, median(least(width, height)::DOUBLE) AS median_short, median(greatest(width, height)::DOUBLE) AS median_long, median(width::DOUBLE / height) AS median_aspect, median(width::DOUBLE * height / 1000000.0) AS median_megapixels FROM {DIMS} GROUP BY split", "landscape portrait square median_width median_height median_short median_long median_aspect median_megapixels")
def compare_splits(spark, d):
    return profile.compare_splits(headers(spark, d))


@query(f"SELECT * FROM (SELECT split, width, height, count(*) AS n, CAST(row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, width, height) AS INT) AS rank FROM {DIMS} GROUP BY split, width, height) WHERE rank <= 10")
def top_resolutions(spark, d):
    return profile.top_resolutions(headers(spark, d))


@query(f"SELECT width, height, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share FROM {DIMS} GROUP BY width, height ORDER BY n DESC, width, height LIMIT 10", "share")
def most_common_k(spark, d):
    return profile.most_common(headers(spark, d), ["width", "height"], 10)


@query("SELECT lang AS format, source AS mode, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source", "share")
def profile_format(spark, d):
    return profile.value_shares(files(spark, d), "format", "mode")


@query("SELECT source AS mode, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def format_crosstab(spark, d):
    return profile.crosstab(files(spark, d), "mode", "format", ["de", "en", "es", "fr"])


@query("SELECT format, count(*) AS n, sum(bytes) / 1e6 AS total_mb, avg(bytes) / 1e3 AS mean_kb, " + ", ".join(f"quantile_cont(bytes / 1e3, {p / 100}) AS p{p}_kb" for p in P) + " FROM (SELECT lang AS format, n_chars AS bytes FROM documents) GROUP BY format", "total_mb mean_kb " + " ".join(f"p{p}_kb" for p in P))
def format_sizes(spark, d):
    return profile.format_sizes(files(spark, d))


@query("SELECT '.' || lang AS ext, lang AS format, count(*) AS n, min(CAST(doc_id AS VARCHAR)) AS example FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang")
def ext_format_mismatch(spark, d):
    return profile.mismatches(files(spark, d), {".en": "en", ".de": "de", ".fr": "en"})


@query("SELECT o_orderstatus AS split, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS good, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS bad FROM orders GROUP BY o_orderstatus")
def filter_errors(spark, d):
    o = t(spark, d, "orders")
    return profile.good_and_bad(o.select(F.col("o_orderstatus").alias("split"), F.when(F.col("o_orderpriority") == "5-LOW", "unreadable").alias("error")))


@query(f"SELECT measure, avg(value) AS mean, {QUANTILES} FROM {MEASURES} GROUP BY measure", "mean " + PS)
def profile_weighted(spark, d):
    return profile.weighted_profile(resolution.histogram(headers(spark, d)))


@query(f"SELECT CASE WHEN g < 512 THEN 'long<512' WHEN g < 1024 THEN '512<=long<1024' WHEN g = 1024 THEN 'long=1024' WHEN g < 2048 THEN '1024<long<2048' ELSE 'long>=2048' END AS long, CASE WHEN width / height <= 0.5 THEN 'w/h<=0.5' WHEN width < height THEN 'portrait' WHEN width = height THEN 'square' WHEN width / height < 2 THEN 'landscape' ELSE 'w/h>=2' END AS aspect, CAST(count(*) AS BIGINT) AS images FROM (SELECT 40 * width AS width, 200 * height AS height, greatest(40 * width, 200 * height) AS g FROM {DIMS}) GROUP BY ALL")
def size_buckets(spark, d):
    h = headers(spark, d).select((F.col("width") * 40).alias("width"), (F.col("height") * 200).alias("height"))
    return profile.size_buckets(resolution.histogram(h))


RANKED = f"(SELECT CAST(row_number() OVER (ORDER BY n DESC, width, height) AS INT) AS rank, width, height, n AS count, sum(n) OVER (ORDER BY n DESC, width, height ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cum_share, sum(n) OVER (ORDER BY n DESC, width, height ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total, count(*) OVER () AS buckets FROM (SELECT width, height, count(*) AS n FROM {DIMS} GROUP BY width, height))"


@query(f"SELECT rank, width, height, count, cum_share, before < 0.9 * total AS kept FROM {RANKED}", "cum_share")
def keep_head_images(spark, d):
    return profile.head_images(headers(spark, d), 0.9)


@query(f"SELECT rank, width, height, count, cum_share, rank <= greatest(1, ceil(0.25 * buckets)) AS kept FROM {RANKED}", "cum_share")
def keep_head_buckets(spark, d):
    return profile.head_buckets(headers(spark, d), 0.25)


@query("SELECT o_orderstatus, p AS percent, quantile_cont(o_totalprice, p / 100) AS value FROM orders, (SELECT unnest([0, 5, 25, 50, 75, 95, 100]) AS p) GROUP BY o_orderstatus, p".replace("quantile_cont(o_totalprice, p / 100)", "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(o_totalprice, {p / 100})" for p in P) + " END"), "value")
def percentile_linear(spark, d):
    return pct.linear(t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")


@query("SELECT split, percent, v[least(len(v) - 1, CAST(floor(percent * len(v) / 100) AS INT)) + 1] AS value FROM (SELECT split, list_sort(list(width)) AS v FROM " + DIMS + " GROUP BY split), (SELECT unnest([0, 10, 50, 90, 100]) AS percent)")
def percentile_lower(spark, d):
    return pct.lower(headers(spark, d), ["split"], "width")


@query("SELECT split, percent, min(value) AS value FROM (SELECT split, value, sum(n) OVER (PARTITION BY split ORDER BY value) AS upto, sum(n) OVER (PARTITION BY split) AS total FROM (SELECT split, width AS value, sum(height) AS n FROM " + DIMS + " GROUP BY split, width)), (SELECT unnest([0, 5, 25, 50, 75, 95, 100]) AS percent) WHERE upto >= percent * total / 100 GROUP BY split, percent")
def percentile_weighted(spark, d):
    return pct.weighted(headers(spark, d), ["split"], "width", "height")


# leakage ----------------------------------------------------------------------------------------------------------------
def split_of(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


@query(f"SELECT * FROM {EXACT}")
def join_exact_hash(spark, d):
    i = items(spark, d)
    return leakage.exact_pairs(split_of(i, "train"), split_of(i, "val"))


@query(f"SELECT class, split, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT class, split, pixel_hash, count(*) AS n FROM {ITEMS} WHERE pixel_hash IS NOT NULL GROUP BY ALL) GROUP BY class, split")
def dup_within_split(spark, d):
    return leakage.duplicates_within(items(spark, d))


@query(f"SELECT * FROM {SIMILAR}", "cosine_sim")
def join_cosine_threshold(spark, d):
    v = vectors(spark, d)
    return leakage.cosine_pairs(split_of(v, "train"), split_of(v, "val"), THRESHOLD, block=256)


@query(f"SELECT * FROM {SIMILAR}", "cosine_sim")
def join_cosine_builtin(spark, d):
    v = vectors(spark, d)
    return leakage.cosine_pairs_sql(split_of(v, "train"), split_of(v, "val"), THRESHOLD)


FORCED = f"(SELECT t.class, t.name AS train_image, v.name AS val_image, 'pixel' AS match_type, CASE WHEN t.ok AND v.ok THEN {COSINE} ELSE 0 END AS cosine_sim FROM {VEC} t JOIN {VEC} v ON CAST(t.name AS INT) = CAST(v.name AS INT) + 2 WHERE v.split = 'val')"


def _forced(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of every val vector and the train vector two ids on, as if their content were equal."""
    v = vectors(spark, d)
    train, val = split_of(v, "train"), split_of(v, "val")
    pairs = val.select("class", (F.col("vec_id") + 2).cast("string").alias("train_image"), F.col("name").alias("val_image"), F.lit("pixel").alias("match_type")).join(train.select(F.col("name").alias("train_image")).hint("merge"), "train_image", "left_semi")
    return leakage.backfilled(pairs, train, val), train, val


@query(f"SELECT * FROM {FORCED}", "cosine_sim")
def backfill_cosine(spark, d):
    return _forced(spark, d)[0]


MERGED = f"(SELECT class, train_image, val_image, coalesce(e.match_type, 'siglip') AS match_type, coalesce(e.cosine_sim, s.cosine_sim) AS cosine_sim FROM {FORCED} e FULL JOIN {SIMILAR} s USING (class, train_image, val_image))"


@query(f"SELECT * FROM {MERGED}", "cosine_sim")
def merge_evidence(spark, d):
    exact, train, val = _forced(spark, d)
    return leakage.merged_evidence(exact, leakage.cosine_pairs(train, val, THRESHOLD))


@query(f"SELECT class, count(*) FILTER (WHERE match_type = 'byte') AS byte, count(*) FILTER (WHERE match_type = 'pixel') AS pixel, count(*) FILTER (WHERE match_type = 'siglip') AS siglip, count(DISTINCT train_image) AS train_images, count(DISTINCT val_image) AS val_images FROM {MERGED} GROUP BY class")
def leak_summary(spark, d):
    return leakage.leak_summary(merge_evidence(spark, d))


@query(f"SELECT class, match_type, printf('%.6f', cosine_sim) AS cosine_sim, train_image, val_image FROM {MERGED} ORDER BY CASE match_type WHEN 'byte' THEN 1 WHEN 'pixel' THEN 2 ELSE 3 END, cosine_sim DESC, train_image, val_image LIMIT 20")
def sorted_leaks(spark, d):
    return leakage.leak_lines(leakage.sorted_leaks(merge_evidence(spark, d)).limit(20))


NEAR = f"(SELECT t.class, t.name AS train_image, coalesce(max(c.cos), -1) AS cosine_sim, arg_min(c.ref, (-c.cos, c.o, c.ref)) AS matched_image, arg_min(c.split, (-c.cos, c.o, c.ref)) AS matched_split, coalesce(max(c.cos) FILTER (WHERE c.split = 'val'), -1) AS best_val, coalesce(max(c.cos) FILTER (WHERE c.split = 'test'), -1) AS best_test FROM {VEC} t LEFT JOIN (SELECT t.name, v.name AS ref, v.split, CASE v.split WHEN 'val' THEN 1 ELSE 2 END AS o, {COSINE} AS cos FROM {VEC} t JOIN {VEC} v ON t.class = v.class WHERE t.split = 'train' AND v.split <> 'train' AND t.ok AND v.ok) c ON c.name = t.name WHERE t.split = 'train' GROUP BY t.class, t.name)"


def near(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return leakage.nearest(split_of(v, "train"), v.where("split <> 'train'"), ("val", "test"))


@query(f"SELECT * FROM {NEAR}", "cosine_sim best_val best_test")
def join_nearest(spark, d):
    return near(spark, d)


@query(f"SELECT * FROM {NEAR} WHERE cosine_sim > {THRESHOLD}", "cosine_sim best_val best_test")
def flag_removals(spark, d):
    return leakage.flagged(near(spark, d), THRESHOLD)


@query(f"SELECT class, count(*) AS train_images, count(*) FILTER (WHERE cosine_sim > {THRESHOLD}) AS flagged, count(*) FILTER (WHERE best_val > {THRESHOLD}) AS hits_val, count(*) FILTER (WHERE best_test > {THRESHOLD}) AS hits_test, count(*) FILTER (WHERE best_val > {THRESHOLD} AND best_test > {THRESHOLD}) AS hits_all, avg(CASE WHEN cosine_sim > {THRESHOLD} THEN 1.0::DOUBLE ELSE 0 END) AS proportion FROM {NEAR} GROUP BY class", "proportion")
def removal_summary(spark, d):
    return leakage.removal_summary(near(spark, d), THRESHOLD, ("val", "test"))


@query(f"SELECT class, name FROM {VEC} WHERE split = 'train' AND name NOT IN (SELECT train_image FROM {NEAR} WHERE cosine_sim > {THRESHOLD})")
def survivors(spark, d):
    train = split_of(vectors(spark, d), "train")
    return leakage.survivors(train, leakage.flagged(near(spark, d), THRESHOLD)).select("class", "name")


CACHED = "vec_id IN (SELECT doc_id FROM labels)"


def cached(spark, d) -> tuple[DataFrame, DataFrame]:
    """All vectors, and a cache of those whose number is a labelled document's."""
    v = vectors(spark, d)
    return v, v.join(t(spark, d, "labels").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select("name", "emb", "ok")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS name FROM embeddings WHERE NOT {CACHED}")
def embedding_cache_todo(spark, d):
    v, cache = cached(spark, d)
    return leakage.cache_split(v.select("name"), cache)[1]


@query(f"SELECT CAST(vec_id AS VARCHAR) AS name, {READABLE} AS ok FROM embeddings WHERE {CACHED}")
def embedding_cache_hits(spark, d):
    v, cache = cached(spark, d)
    return leakage.cache_split(v.select("name"), cache)[0].select("name", "ok")


# resolutions ------------------------------------------------------------------------------------------------------------
def candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    h = headers(spark, d)
    return split_of(h, "N"), resolution.histogram(split_of(h, "A"))


TOLS = ", ".join(map(str, resolution.TOLERANCES))
DIST = f"(SELECT c.width, c.height, r.n, greatest(abs(log2(c.width) - log2(r.width)), abs(log2(c.height) - log2(r.height))) AS d FROM (SELECT DISTINCT width, height FROM {DIMS} WHERE split = 'N') c, (SELECT width, height, count(*) AS n FROM {DIMS} WHERE split = 'A' GROUP BY width, height) r)"
SHARE = f"(SELECT width, height, tol, coalesce(sum(n) FILTER (WHERE d <= tol), 0) / sum(n) AS share FROM {DIST}, (SELECT unnest([{TOLS}])::DOUBLE AS tol) GROUP BY width, height, tol)"
RADIUS = f"(SELECT width, height, min(d) AS radius FROM (SELECT width, height, d, sum(n) OVER (PARTITION BY width, height ORDER BY d) / sum(n) OVER (PARTITION BY width, height) AS share FROM {DIST}) WHERE share > 0.01 GROUP BY width, height)"
IMAGES = f"(SELECT path AS stem, width, height, height < 7 AS pooled FROM {DIMS} WHERE split = 'N')"
USED = "(SELECT DISTINCT CAST(o_orderkey AS VARCHAR) || '-1' AS stem FROM orders WHERE o_orderstatus = 'F')"
QUALIFIED = f"(SELECT i.stem, i.width, i.height, i.pooled, s.share, r.radius, u.stem IS NOT NULL AS excluded, s.share <= 0.01 AS qualifying, s.share <= 0.01 AND u.stem IS NULL AS eligible FROM {IMAGES} i JOIN {SHARE} s ON s.width = i.width AND s.height = i.height AND s.tol = 0.2 JOIN {RADIUS} r ON r.width = i.width AND r.height = i.height LEFT JOIN {USED} u ON u.stem = i.stem)"


@query(f"SELECT * FROM {SHARE}", "tol share")
def join_ref_range(spark, d):
    return resolution.reference_shares(*candidates(spark, d))


@query(f"SELECT * FROM {RADIUS}", "radius")
def radius_at_share(spark, d):
    return resolution.radius(*candidates(spark, d), 0.01)


def images(spark, d) -> tuple[DataFrame, DataFrame]:
    i = candidates(spark, d)[0].select(F.col("path").alias("stem"), "width", "height", (F.col("height") < 7).alias("pooled"))
    marked = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1_a"), (F.col("o_orderkey") % 9).cast("string")).alias("stem"))
    return i, resolution.used_stems(marked)


def qualified(spark, d) -> DataFrame:
    c, ref = candidates(spark, d)
    i, used = images(spark, d)
    return resolution.qualified(i, resolution.reference_shares(c, ref, (0.2,)), resolution.radius(c, ref, 0.01), used, 0.01)


@query(f"SELECT * FROM {QUALIFIED}", "share radius")
def filter_eligible(spark, d):
    return qualified(spark, d)


@query(f"SELECT count(*) FILTER (WHERE excluded) AS excluded, count(*) FILTER (WHERE qualifying) AS qualifying, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND NOT pooled) AS eligible_not_pooled FROM {QUALIFIED}")
def qualification_counts(spark, d):
    return resolution.qualification_counts(qualified(spark, d))


@query(f"SELECT tol, max_share, CAST(coalesce(sum(n) FILTER (WHERE share <= max_share), 0) AS BIGINT) AS images FROM (SELECT i.width, i.height, count(*) AS n FROM {IMAGES} i WHERE i.stem NOT IN (SELECT stem FROM {USED}) GROUP BY i.width, i.height) JOIN {SHARE} USING (width, height), (SELECT unnest([{', '.join(map(str, resolution.SHARES))}])::DOUBLE AS max_share) GROUP BY tol, max_share", "tol max_share")
def setting_grid(spark, d):
    i, used = images(spark, d)
    return resolution.setting_grid(i, resolution.reference_shares(*candidates(spark, d)), used)


@query(f"SELECT stem, radius FROM {QUALIFIED} WHERE eligible AND pooled ORDER BY md5('7:' || stem), stem LIMIT 40", "radius")
def sample_random_n(spark, d):
    return resolution.chosen(qualified(spark, d), 40, 7).select("stem", "radius")


@query(f"SELECT stem, width, height, printf('%.6f', share) AS ref_share, printf('%.4f', radius) AS radius, 'planned' AS status FROM (SELECT * FROM {QUALIFIED} WHERE eligible AND pooled ORDER BY round(radius, 9) DESC, md5('7:' || stem), stem LIMIT 40)")
def sample_farthest_n(spark, d):
    return resolution.manifest(resolution.chosen(qualified(spark, d).withColumn("radius", F.round("radius", 9)), 40, 7, farthest=True))


# samples and splits -----------------------------------------------------------------------------------------------------
@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 7 OR i IN (SELECT CAST(floor(k * n / 7) AS BIGINT) FROM range(7) r(k))".replace("i IN (SELECT CAST(floor(k * n / 7) AS BIGINT) FROM range(7) r(k))", "list_contains([CAST(floor(k * n / 7) AS BIGINT) FOR k IN [0, 1, 2, 3, 4, 5, 6]], i)"))
def scan_even_sample(spark, d):
    return sampling.even_sample(t(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 7)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 5")
def scan_prefix(spark, d):
    return sampling.prefix(t(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 5)


@query("SELECT doc_id FROM documents ORDER BY md5('1234:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def sample_pairs(spark, d):
    return sampling.sample_n(t(spark, d, "documents").select("doc_id"), "doc_id", 100, 1234)


@query(f"SELECT width, height, path, sample_index FROM (SELECT width, height, path, CAST(row_number() OVER (PARTITION BY width, height ORDER BY md5('3:' || path), path) AS INT) AS sample_index FROM {DIMS}) WHERE sample_index <= 3")
def sample_per_bucket(spark, d):
    return sampling.sample_per_group(headers(spark, d).select("width", "height", "path"), ["width", "height"], "path", 3, 3)


@query("SELECT CAST(k AS INT) AS replica, n_nationkey FROM nation, range(3) r(k) ORDER BY k, md5('5:' || CAST(n_nationkey AS VARCHAR)), n_nationkey LIMIT 60")
def shuffle_prefix(spark, d):
    return sampling.shuffled_wrapped(t(spark, d, "nation").select("n_nationkey"), "n_nationkey", 60, 5)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents ORDER BY md5('9:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50) THEN 'val' ELSE 'train' END AS split FROM documents")
def move_split(spark, d):
    return sampling.assign_split(t(spark, d, "documents").select("doc_id"), "doc_id", 50, 9)


@query("SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS global_row FROM documents")
def global_row_id(spark, d):
    return sampling.numbered(t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "global_row")


RANGES = f"(SELECT width, height, sum(n) OVER (ORDER BY width, height ROWS UNBOUNDED PRECEDING) - n AS first, sum(n) OVER (ORDER BY width, height ROWS UNBOUNDED PRECEDING) AS after, sum(n) OVER () AS total FROM (SELECT width, height, count(*) AS n FROM {DIMS} GROUP BY width, height))"


@query(f"SELECT doc_id, width, height FROM (SELECT doc_id, CAST('0x' || md5('11:' || CAST(doc_id AS VARCHAR))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents) JOIN {RANGES} ON floor(u * total) >= first AND floor(u * total) < after")
def sample_dim_with_replacement(spark, d):
    keys = t(spark, d, "documents").select("doc_id")
    return sampling.sample_joint(keys, "doc_id", resolution.histogram(headers(spark, d)), 11)


# dataset jobs -----------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0")
def filter_labels(spark, d):
    rows = t(spark, d, "labels").select("doc_id", F.col("quality").alias("label_a"), F.col("toxic").alias("label_b"))
    return etl.filter_labels(rows, 1, 0).select("doc_id", F.col("label_a").alias("quality"), F.col("label_b").alias("toxic"))


@query("SELECT md5(text) AS name, source, CAST(doc_id AS VARCHAR) AS path FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source, CAST(doc_id AS VARCHAR)) AS n FROM documents) WHERE n = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src19')")
def merge_copy(spark, d):
    rows = t(spark, d, "documents").select(F.md5("text").alias("name"), "source", F.col("doc_id").cast("string").alias("path"))
    return etl.merge_first(rows, rows.where("source = 'src19'"))


@query("SELECT c.c_nationkey AS stem, min(c.c_name) AS real, min(s.s_name) AS fake FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey GROUP BY c.c_nationkey")
def join_stem_pairs(spark, d):
    return etl.stem_pairs(t(spark, d, "customer").select(F.col("c_nationkey").alias("stem"), F.col("c_name").alias("path")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("stem"), F.col("s_name").alias("path")))


@query("SELECT c_custkey AS stem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_stem_check(spark, d):
    return etl.missing_stems(t(spark, d, "customer").select(F.col("c_custkey").alias("stem")), t(spark, d, "orders").select(F.col("o_custkey").alias("stem")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_used(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT quality AS label_a, toxic AS label_b, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, (quality = 0) = (toxic = 0) AS consistent FROM labels GROUP BY quality, toxic", "share")
def label_pairs(spark, d):
    return etl.label_pairs(t(spark, d, "labels").select(F.col("quality").alias("label_a"), F.col("toxic").alias("label_b")))


@query("SELECT composition, count(*) AS groups FROM (SELECT o_custkey, string_agg(o_orderstatus || 'x' || CAST(n AS VARCHAR), ' ' ORDER BY o_orderstatus) AS composition FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey) GROUP BY composition")
def caption_composition(spark, d):
    return etl.composition(t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT count(*) FILTER (WHERE labels = [0, 1, 2, 3, 4, 5] AND captions = 1) AS ordered, count(*) AS blocks FROM (SELECT floor(i / 6) AS b, list(l_linenumber - 1 ORDER BY i) AS labels, count(DISTINCT l_orderkey) AS captions FROM (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS i FROM lineitem) GROUP BY 1)")
def block_order_check(spark, d):
    li = t(spark, d, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber")).withColumn("label", F.col("l_linenumber") - 1)
    return etl.block_order(li, "l_returnflag", "row", "l_orderkey", "label")


@query(f"SELECT split AS label, CAST(sum(n) AS BIGINT) AS images, count(*) AS resolutions, sum(n) FILTER (WHERE width = height) / sum(n) AS square_share, array_to_string(list(width || 'x' || height ORDER BY n DESC, width, height)[1:3], ' ') AS top FROM (SELECT split, width, height, count(*) AS n FROM {DIMS} GROUP BY ALL) GROUP BY split", "square_share")
def resolution_by_label(spark, d):
    return etl.resolution_by_label(headers(spark, d).withColumnRenamed("split", "label"))


@query("SELECT count(user_id) - count(DISTINCT user_id) AS duplicates FROM events")
def dup_id_count(spark, d):
    return etl.duplicate_ids(t(spark, d, "events"), "user_id")


@query("SELECT CASE l_linenumber WHEN 1 THEN 'real' WHEN 2 THEN 'ai' ELSE '(unknown)' END AS folder, count(*) AS n FROM lineitem GROUP BY 1")
def route_unknown_label(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("label"))
    return etl.routed_counts(etl.route_labels(rows, {1: "real", 2: "ai"}))


@query("SELECT global_row, printf('gen_%06d_b%d.jpg', global_row, toxic) AS file FROM (SELECT l.toxic, d.doc_id, row_number() OVER (ORDER BY d.source, d.doc_id) - 1 AS global_row FROM documents d JOIN labels l USING (doc_id)) WHERE toxic = 1")
def export_names(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id").select("source", "doc_id", F.col("toxic").alias("label_b"))
    return etl.export_names(rows, "gen", "source", "doc_id", ".jpg", F.col("label_b") == 1).select("global_row", "file")


@query("SELECT u.conv_id, u.turn, length(u.text) AS question, length(a.text) AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def turn_pairs(spark, d):
    return etl.next_turns(t(spark, d, "conversations")).select("conv_id", "turn", F.length("question").alias("question"), F.length("answer").alias("answer"))


def raw_outputs(spark, d) -> DataFrame:
    """Answers as a caption model gives them, from the turns of conversations."""
    n = F.col("conv_id") % 4
    body = F.when(n == 0, F.concat(F.lit("<think>x</think><analysis>A: b</analysis>\n<prompt>"), "text", F.lit("</prompt>"))).when(n == 1, F.concat(F.lit("<analysis>a <prompt></analysis><prompt kind='x'>"), "text")).when(n == 2, F.lit("<error>NO_IMAGE</error>")).otherwise(F.col("text"))
    return t(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), body.alias("raw_output"))


PROMPT = "nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')"


@query(f"SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS image_id, CASE WHEN conv_id % 4 IN (2, 3) OR len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 20 THEN 'failed' WHEN conv_id % 4 = 1 THEN 'truncated' ELSE 'ok' END AS status, CASE WHEN conv_id % 4 IN (0, 1) THEN {PROMPT} END AS prompt, CASE conv_id % 4 WHEN 0 THEN 'A: b' WHEN 1 THEN 'a <prompt>' END AS analysis, CASE conv_id % 4 WHEN 2 THEN 'NO_IMAGE' END AS error, conv_id % 4 = 1 AS truncated, CAST(CASE WHEN conv_id % 4 IN (0, 1) AND {PROMPT} IS NOT NULL THEN len(string_split({PROMPT}, ' ')) ELSE 0 END AS INT) AS n_words FROM conversations")
def parse_output(spark, d):
    return etl.caption_records(raw_outputs(spark, d))


@query("SELECT CASE WHEN conv_id % 4 IN (2, 3) OR len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 20 THEN 'failed' WHEN conv_id % 4 = 1 THEN 'truncated' ELSE 'ok' END AS status, count(*) AS n FROM conversations GROUP BY 1")
def status_counts(spark, d):
    return etl.status_counts(etl.caption_records(raw_outputs(spark, d)))


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS image_id FROM conversations WHERE conv_id % 4 IN (2, 3) OR len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 20")
def filter_resume(spark, d):
    raw = raw_outputs(spark, d)
    return etl.todo(raw.select("image_id"), etl.caption_records(raw))


PLANNED = "(SELECT o_orderkey, w, h, greatest(1.0, 256.0 / least(w, h)) AS up FROM (SELECT o_orderkey, 1 + o_orderkey * 37 % 4001 AS w, 1 + o_orderkey * 91 % 3001 AS h FROM orders))"


@query(f"SELECT o_orderkey, CASE WHEN ok THEN pw END AS width, CASE WHEN ok THEN ph END AS height, CASE WHEN NOT ok THEN 'aspect ratio too extreme' END AS error FROM (SELECT *, least(pw, ph) >= 256 AS ok FROM (SELECT o_orderkey, CAST(floor(floor(w * s) / 32) * 32 AS INT) AS pw, CAST(floor(floor(h * s) / 32) * 32 AS INT) AS ph FROM (SELECT o_orderkey, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, least(CAST(up AS DOUBLE), 2048 / CAST(greatest(w, h) AS DOUBLE)) AS s FROM (SELECT o_orderkey, w, h, greatest(1.0::DOUBLE, 256 / CAST(least(w, h) AS DOUBLE)) AS up FROM {PLANNED}))))")
def plan_resolution(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") * 37 % 4001).alias("w"), (1 + F.col("o_orderkey") * 91 % 3001).alias("h"))
    return o.select("o_orderkey", fn.planned_size(F.col("w"), F.col("h")).alias("s")).select("o_orderkey", "s.width", "s.height", "s.error")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT doc_id, sha256(text) AS byte_hash, length(text) AS chars FROM documents")
def byte_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", leakage.content_hash(F.col("text")).alias("byte_hash"), F.length("text").alias("chars"))


# scores, plans and features ---------------------------------------------------------------------------------------------
@query(f"SELECT family, CAST(dim - 1 AS INT) AS dim, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT CAST(label AS VARCHAR) AS family, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS dim FROM embeddings WHERE {READABLE}) GROUP BY family, dim", "mean std")
def feature_stats(spark, d):
    return features.feature_stats(vectors(spark, d).select(F.col("label").cast("string").alias("family"), F.col("emb").alias("values"), F.col("ok").alias("valid")))


FEATURES = f"(SELECT vec_id, CAST(label AS VARCHAR) AS family, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings WHERE {READABLE})"


@query(f"SELECT vec_id, CAST(dim AS INT) AS dim, greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 0.001::DOUBLE))) AS value FROM {FEATURES} WINDOW w AS (PARTITION BY family, dim)", "value")
def standardise(spark, d):
    rows = vectors(spark, d).select("vec_id", F.col("label").cast("string").alias("family"), F.col("emb").alias("values"), F.col("ok").alias("valid"))
    return features.standardised(rows, features.feature_stats(rows)).select("vec_id", F.posexplode("values").alias("dim", "value"))


def grids(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.lit(6).alias("rows"), F.lit(10).alias("cols"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("attn"))


TOKENS = "(SELECT image, token, CAST(floor(token / 10) AS INT) AS row, CAST(token % 10 AS INT) AS col, least(floor(token / 10), 5 - floor(token / 10), token % 10, 9 - token % 10) AS ring, score FROM (SELECT vec_id AS image, unnest(generate_series(0, 63)) AS token, abs(unnest(CAST(embedding AS DOUBLE[]))) AS score FROM embeddings) WHERE token < 60)"


@query(f"SELECT * FROM (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY score DESC, token) AS INT) AS rank, CAST(token AS INT) AS token, row, col, score FROM {TOKENS}) WHERE rank <= 5", "score")
def topk_patches(spark, d):
    return attention.top_patches(grids(spark, d), 5)


@query(f"SELECT image, coalesce(sum(score) FILTER (WHERE ring = 0), 0) AS mass, avg(CASE WHEN ring = 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM {TOKENS} GROUP BY image", "mass share")
def border_mass(spark, d):
    return attention.ring_mass(grids(spark, d))


@query(f"SELECT image, CAST(token AS INT) AS token, score / sum(score) OVER (PARTITION BY image) AS score FROM {TOKENS} WHERE ring >= 1", "score")
def noborder(spark, d):
    return attention.without_border(grids(spark, d)).select("image", "token", "score")


@query("SELECT image, CAST(token AS INT) AS token, avg(score) AS score FROM (SELECT label AS image, unnest(generate_series(0, 63)) AS token, unnest(CAST(embedding AS DOUBLE[])) AS score FROM embeddings) GROUP BY image, token", "score")
def mean_attention(spark, d):
    return attention.mean_attention(t(spark, d, "embeddings").select(F.col("label").alias("image"), F.transform("embedding", lambda x: x.cast("double")).alias("attn")))


@query()
def image_seeds(spark, d):
    return t(spark, d, "documents").select("doc_id", planning.image_seed_column(F.col("doc_id").cast("string"), F.lit(1234)).cast("string").alias("seed"))


def u_sql(*key: str) -> str:
    """The draw that planning.drawn gives under seed 1234."""
    return f"CAST('0x' || md5('1234:' || {" || ':' || ".join(key)})[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE"


def step_sql(key: str) -> str:
    """The label of the step of augmentation number i, with its parameters drawn under a key."""
    o = planning.Options()
    pick = lambda name, what, values: f"'{name}({what}=' || [{', '.join(repr(str(v)) for v in values)}][CAST(floor({u_sql(key, repr(name), repr(what))} * {len(values)}) AS INT) + 1] || ')'"
    axes = " || ',".join([""] + [f"{a}=' || printf('%.4f', {1 - getattr(o, a)}::DOUBLE + {2 * getattr(o, a)}::DOUBLE * {u_sql(key, repr('jitter'), repr(a))})" for a in planning.AXES])[len(" || ',") :]
    cases = [pick("jpeg", "quality", o.quality), pick("blur", "sigma", o.blur_sigma), pick("resize", "scale", o.scale), pick("noise", "sigma", o.noise_sigma), f"'jitter({axes} || ')'", pick("crop", "fraction", o.fraction)]
    return "CASE i " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


STEMS = "(SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents)"
NAMES_SQL = "(SELECT unnest(range(6)) AS i, unnest(['jpeg', 'blur', 'resize', 'noise', 'jitter', 'crop']) AS name)"
TRIED = f"(SELECT stem, t, list(i ORDER BY u, i)[1:any_value(2 + CAST(floor({u_sql('stem', chr(39) + 'try' + chr(39) + ' || CAST(t AS VARCHAR)', repr('size'))} * 5) AS INT))] AS chosen FROM (SELECT stem, t, i, {u_sql('stem', chr(39) + 'try' + chr(39) + ' || CAST(t AS VARCHAR)', 'name')} AS u FROM {STEMS}, (SELECT unnest(range(16)) AS t), {NAMES_SQL}) GROUP BY stem, t)"
CHAINS = f"(SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY n > 1, t) AS INT) + 6 AS idx, chosen FROM (SELECT *, row_number() OVER (PARTITION BY stem, list_sort(chosen) ORDER BY t) AS n FROM {TRIED}))"
ORDERS = f"(SELECT stem, idx, unnest(chosen) AS i, unnest(range(len(chosen))) AS place FROM (SELECT * FROM {CHAINS} WHERE idx <= 9 UNION ALL SELECT stem, i + 1 AS idx, [i] AS chosen FROM {STEMS}, {NAMES_SQL}))"


@query(f"SELECT stem, CAST(idx AS INT) AS idx, string_agg(label, ' -> ' ORDER BY place) AS plan FROM (SELECT stem, idx, place, {step_sql('stem || chr(58) || CAST(idx AS VARCHAR)')} AS label FROM {ORDERS}) GROUP BY stem, idx")
def augmentation_plans(spark, d):
    stems = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    return planning.plans(stems).select("stem", "idx", fn.plan_label(F.col("steps")).alias("plan"))


ONLINE = f"(SELECT stem, {u_sql('stem', repr('kind'))} AS u, CAST(floor({u_sql('stem', repr('one'))} * 6) AS INT) AS one, [{', '.join(map(str, planning.subsets(2, 6)))}][CAST(floor({u_sql('stem', repr('subset'))} * {len(planning.subsets(2, 6))}) AS INT) + 1] AS mask FROM {STEMS})"


@query(f"SELECT stem, coalesce(string_agg(label, ' -> ' ORDER BY place) FILTER (WHERE label IS NOT NULL), 'identity') AS plan FROM (SELECT stem, CASE WHEN u < 0.1 THEN NULL WHEN u < 0.5 AND i <> one THEN NULL WHEN u >= 0.5 AND (mask >> i) & 1 = 0 THEN NULL ELSE {step_sql('stem')} END AS label, {u_sql('stem', repr('order'), 'name')} AS place FROM {ONLINE}, {NAMES_SQL}) GROUP BY stem")
def online_plans(spark, d):
    stems = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    return planning.online_plans(stems).select("stem", fn.plan_label(F.col("steps")).alias("plan"))


GRID = "(VALUES " + ", ".join(f"({i}, '{a}', '{fn_label}')" for i, (a, fn_label) in enumerate((a, "identity" if a == "none" else "" if p.get("random") else a + "(" + ",".join(f"{k}={x}" for k, x in p.items()) + ")") for a, _, p in planning.round_grid())) + ") g(round, augment, label)"


@query(f"SELECT stem, CAST(round AS INT) AS round, CASE WHEN label = '' THEN {step_sql('stem').replace('CASE i', 'CASE 4')} ELSE label END AS label FROM {STEMS}, {GRID}")
def grid_rounds(spark, d):
    """Images under every round of the grid, with their steps."""
    stems = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    steps = planning.round_steps(stems, planning.round_grid_frame(spark))
    return steps.select("stem", "round", fn.plan_label(F.col("steps")).alias("label"))


def crop_u(*key: str) -> str:
    return u_sql("src", *key).replace("1234:", "1:")


CROPS = f"(SELECT DISTINCT path AS name, path || '|' || CAST(width * 40 AS VARCHAR) || '|' || CAST(height * 200 AS VARCHAR) AS src, width * 40 AS w, height * 200 AS h FROM {DIMS})"
TARGETS = f"(SELECT src, name, w, h, t, CAST(greatest(1, round_even(tw + z * cos(a) * 8.0, 0)) AS INT) AS tw, CAST(greatest(1, round_even(th + z * sin(a) * 8.0, 0)) AS INT) AS th FROM (SELECT src, name, w, h, t, [1024, 512, 640][k] AS tw, [768, 512, 1280][k] AS th, sqrt(-2.0::DOUBLE * ln(1 - {crop_u('CAST(t AS VARCHAR)', repr('size'))})) AS z, {crop_u('CAST(t AS VARCHAR)', repr('angle'))} * 2 * pi() AS a FROM (SELECT *, CAST(floor({crop_u('CAST(t AS VARCHAR)', repr('dims'))} * 3) AS INT) + 1 AS k FROM {CROPS}, (SELECT unnest(range(21)) AS t))))"
COVERS = f"(SELECT *, least(w::DOUBLE / h / (tw::DOUBLE / th), (tw::DOUBLE / th) / (w::DOUBLE / h)) AS plain, CASE WHEN tw = th THEN -1.0::DOUBLE ELSE least(w::DOUBLE / h / (th::DOUBLE / tw), (th::DOUBLE / tw) / (w::DOUBLE / h)) END AS turned FROM {TARGETS})"
TURNS = f"(SELECT *, CASE WHEN turn THEN turned ELSE plain END AS most FROM (SELECT *, CASE WHEN least(plain, turned) >= 0.5 THEN {crop_u('CAST(t AS VARCHAR)', repr('turn'))} >= 0.5 ELSE turned > plain END AS turn FROM {COVERS}))"
BEST = f"(SELECT * FROM (SELECT *, most >= 0.5 AS feasible, CASE WHEN most >= 0.5 THEN 0.5::DOUBLE + (most - 0.5) * {crop_u('CAST(t AS VARCHAR)', repr('cover'))} ELSE most END AS cover FROM {TURNS}) QUALIFY row_number() OVER (PARTITION BY src, w, h ORDER BY feasible DESC, CASE WHEN feasible THEN t ELSE -cover END, t) = 1)"
BOXED = f"(SELECT *, CAST(least(w, greatest(1, round_even(sqrt(cover * w * h * a), 0))) AS INT) AS cw FROM (SELECT *, CASE WHEN turn THEN th::DOUBLE / tw ELSE tw::DOUBLE / th END AS a FROM {BEST}))"


@query(f"SELECT name AS src, w AS width, h AS height, tw, th, (w - cw) // 2 AS l, (h - ch) // 2 AS t, (w - cw) // 2 + cw AS r, (h - ch) // 2 + ch AS b, CASE WHEN turn THEN [90, 270][CAST(floor({crop_u(repr('rotation'))} * 2) AS INT) + 1] END AS rotation, turn AS transpose, cover, feasible, CASE WHEN feasible THEN tries ELSE 20 END AS resamples FROM (SELECT * EXCLUDE (t), CAST(t AS INT) AS tries, CAST(least(h, greatest(1, round_even(cw / a, 0))) AS INT) AS ch FROM {BOXED})", "cover")
def crop_jobs(spark, d):
    rows = headers(spark, d).select(F.col("path").alias("src"), (F.col("width") * 40).alias("width"), (F.col("height") * 200).alias("height")).distinct()
    jobs = planning.crop_jobs(rows.withColumn("src", F.concat_ws("|", "src", F.col("width").cast("string"), F.col("height").cast("string"))), [(1024, 768), (512, 512), (640, 1280)], seed=1, sigma=8.0)
    size = F.split("src", r"\|")
    return jobs.select(size[0].alias("src"), size[1].cast("int").alias("width"), size[2].cast("int").alias("height"), F.col("target.w").alias("tw"), F.col("target.h").alias("th"), "box.l", "box.t", "box.r", "box.b", "rotation", "transpose", "cover", "feasible", "resamples")


@query()
def score_embeddings(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").alias("emb"))
    learned = F.pmod(F.xxhash64("vec_id"), F.lit(4)) != 0  # a quarter is kept from the fit
    return scoring.scored(rows, scoring.logistic_baseline(rows.where(learned)))




# smaller operators ------------------------------------------------------------------------------------------------------
@query(f"SELECT path, CAST(r AS INT) AS round, CAST(41 + r AS BIGINT) AS seed FROM {PRED}, (SELECT unnest([1, 2, 3]) AS r)")
def rounds_seed(spark, d):
    return calibration.seeded_rounds(predictions(spark, d).select("path"), 3, 42)


ROUND = f"(SELECT *, CAST(variant AS INT) AS round FROM {PRED})"


@query(f"SELECT round, {CELLS}, count(*) FILTER (WHERE label = 0) AS real, count(*) FILTER (WHERE label = 1) AS ai_gen, count(*) AS total FROM {ROUND} GROUP BY round")
def calibration_round(spark, d):
    rows = evaluation.classify(predictions(spark, d)).withColumn("round", F.col("variant").cast("int"))
    return calibration.round_tables(rows, K)[0].drop(*NAMES.split())


@query(f"SELECT i.round, i.idx, coalesce(count_real, 0) AS count_real, coalesce(count_aigen, 0) AS count_aigen FROM (SELECT round, idx FROM (SELECT DISTINCT round FROM {ROUND}), (SELECT CAST(unnest(range({K})) AS INT) AS idx)) i LEFT JOIN (SELECT round, CAST(least(floor(prob * {K}), {K - 1}) AS INT) AS idx, count(*) FILTER (WHERE label = 0) AS count_real, count(*) FILTER (WHERE label = 1) AS count_aigen FROM {ROUND} GROUP BY 1, 2) c ON c.round = i.round AND c.idx = i.idx")
def calibration_round_histogram(spark, d):
    rows = evaluation.classify(predictions(spark, d)).withColumn("round", F.col("variant").cast("int"))
    return calibration.round_tables(rows, K)[1]


@query(f"SELECT batch, CAST(sum(n) OVER w AS BIGINT) AS n, sum(correct) OVER w / sum(n) OVER w AS accuracy FROM (SELECT CAST(variant AS INT) AS batch, count(*) AS n, count(*) FILTER (WHERE pred = label) AS correct FROM {PRED} GROUP BY 1) WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)", "accuracy")
def running_accuracy(spark, d):
    return evaluation.running_accuracy(evaluation.classify(predictions(spark, d)).withColumn("batch", F.col("variant").cast("int")))


@query(f"SELECT augment, variant, total, CAST(variant AS DOUBLE) * 2 AS seconds, total / (CAST(variant AS DOUBLE) * 2) AS images_per_second FROM {ROUNDS}", "seconds images_per_second")
def round_throughput(spark, d):
    rounds = evaluation.round_results(evaluation.classify(predictions(spark, d)))
    seconds = predictions(spark, d).select("augment", "variant").distinct().withColumn("seconds", F.col("variant").cast("double") * 2)
    return evaluation.with_throughput(rounds, seconds).select("augment", "variant", "total", "seconds", "images_per_second")


@query(f"SELECT class, train_image, printf('%.6f', cosine_sim) AS cosine_sim, matched_image, matched_split, printf('%.6f', best_val) AS best_val, printf('%.6f', best_test) AS best_test FROM {NEAR} WHERE cosine_sim > {THRESHOLD}")
def removed_lines(spark, d):
    return leakage.removal_lines(leakage.flagged(near(spark, d), THRESHOLD), ("val", "test"))


@query(f"SELECT '/data/toremove/' || train_image AS path, 'to delete' AS status FROM {NEAR} WHERE cosine_sim > {THRESHOLD}")
def delete_guarded(spark, d):
    return leakage.guarded_deletes(leakage.flagged(near(spark, d), THRESHOLD), "/data/toremove")


@query(f"SELECT pixel_hash, array_to_string(list_sort(list(name)), ',') AS names FROM {ITEMS} WHERE pixel_hash IS NOT NULL GROUP BY pixel_hash")
def hash_dir(spark, d):
    return leakage.hash_groups(items(spark, d)).select("pixel_hash", F.array_join("names", ",").alias("names"))


@query(f"SELECT i.stem, i.width, i.height, s.share <= 0.01 AS pooled FROM {IMAGES} i JOIN {SHARE} s ON s.width = i.width AND s.height = i.height AND s.tol = 0.1")
def pool_prefilter(spark, d):
    c, ref = candidates(spark, d)
    shares = resolution.reference_shares(c, ref, (0.1,))
    return resolution.pooled(images(spark, d)[0].select("stem", "width", "height"), shares, 0.01).select("stem", "width", "height", "pooled")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS image_id FROM conversations WHERE conv_id % 4 IN (0, 1) AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 20")
def filter_usable_status(spark, d):
    return etl.usable(etl.caption_records(raw_outputs(spark, d))).select("image_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def filter_existing_output(spark, d):
    made = t(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"))
    return etl.without_output(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id")), made)


NAMED = "(SELECT source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.PNG' WHEN lang = 'de' THEN '_a1.tar.gz' ELSE '' END AS path, lang, CAST(doc_id AS VARCHAR) AS id FROM documents)"


def named(spark, d) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".PNG").when(F.col("lang") == "de", "_a1.tar.gz").otherwise("")
    return t(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), ext).alias("path"))


@query(f"SELECT path, lang || '_' || id || CASE WHEN lang = 'de' THEN '_a1.tar' ELSE '' END AS stem, CASE lang WHEN 'en' THEN '.PNG' WHEN 'de' THEN '.gz' ELSE '' END AS suffix, lang || '_' || id || CASE WHEN lang = 'de' THEN '_a1.tar' ELSE '' END AS source_stem FROM {NAMED}")
def stems(spark, d):
    p = named(spark, d)
    return p.select("path", fn.stem(F.col("path")).alias("stem"), fn.suffix(F.col("path")).alias("suffix"), fn.strip_augmented(fn.stem(F.col("path"))).alias("source_stem"))


@query(f"SELECT path FROM {NAMED} WHERE contains(path, 'en_1')")
def filter_match(spark, d):
    return attention.matching(named(spark, d).withColumn("name", F.col("path")), "en_1").select("path")


@query(f"SELECT path, 'r' || CAST(height AS VARCHAR) || '_' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || '_1_' || path AS name FROM {DIMS}")
def sample_name(spark, d):
    h = headers(spark, d)
    return h.select("path", fn.sample_name(F.col("height"), F.col("width"), F.col("height"), F.lit(1), F.col("path")).alias("name"))


@query("SELECT doc_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM documents")
def data_url(spark, d):
    return t(spark, d, "documents").select("doc_id", fn.data_url(F.encode("text", "utf-8")).alias("url"))


SIZED = "(SELECT o_orderkey, CAST(1 + o_orderkey * 37 % 4001 AS INT) AS w, CAST(1 + o_orderkey * 91 % 3001 AS INT) AS h FROM orders)"


def sized(spark, d) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") * 37 % 4001).cast("int").alias("w"), (1 + F.col("o_orderkey") * 91 % 3001).cast("int").alias("h"))


@query(f"SELECT o_orderkey, CASE WHEN s < 1 THEN greatest(1, CAST(floor(w * s) AS INT)) ELSE w END AS width, CASE WHEN s < 1 THEN greatest(1, CAST(floor(h * s) AS INT)) ELSE h END AS height, CASE WHEN s < 0.9995 THEN 'down' ELSE 'same' END AS direction FROM (SELECT *, least(1.0::DOUBLE, sqrt(500000 / (w::DOUBLE * h))) AS s FROM {SIZED})")
def downscale_to_max_pixels(spark, d):
    s = F.least(F.lit(1.0), F.sqrt(500000 / (F.col("w").cast("double") * F.col("h"))))
    rows = sized(spark, d).select("o_orderkey", fn.downscaled(F.col("w"), F.col("h"), 500000).alias("to"), fn.scale_direction(s).alias("direction"))
    return rows.select("o_orderkey", "to.width", "to.height", "direction")


@query(f"SELECT o_orderkey, w AS width, h AS height FROM {SIZED}")
def parse_size(spark, d):
    text = F.concat(F.col("w").cast("string"), F.lit("X"), F.col("h").cast("string"))
    return sized(spark, d).select("o_orderkey", fn.parsed_size(text).alias("s")).select("o_orderkey", "s.width", "s.height")


@query(f"SELECT o_orderkey, least(w::DOUBLE / h / 1.5, 1.5 / (w::DOUBLE / h)) AS cover, 1 / (1 + exp(-(w - h) / 1000.0::DOUBLE)) AS score FROM {SIZED}", "cover score")
def max_coverage(spark, d):
    return sized(spark, d).select("o_orderkey", fn.max_coverage(F.col("w"), F.col("h"), F.lit(1.5)).alias("cover"), fn.sigmoid((F.col("w") - F.col("h")) / 1000.0).alias("score"))


@query(f"SELECT o_orderkey, CASE WHEN ok THEN pw END AS width, CASE WHEN ok THEN ph END AS height FROM (SELECT *, least(pw, ph) >= 256 AS ok FROM (SELECT o_orderkey, CAST(floor(floor(w * s) / 32) * 32 AS INT) AS pw, CAST(floor(floor(h * s) / 32) * 32 AS INT) AS ph FROM (SELECT *, least(greatest(1.0::DOUBLE, 256::DOUBLE / least(w, h)), 2048::DOUBLE / greatest(w, h)) AS s FROM {SIZED})))")
def record_size(spark, d):
    size = fn.record_size(F.col("w").cast("string"), F.col("h").cast("string"))
    return sized(spark, d).select("o_orderkey", size.alias("s")).select("o_orderkey", "s.width", "s.height")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS image_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def clean_text(spark, d):
    return t(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), fn.cleaned(F.col("text")).alias("text"))


@query("SELECT stem, min(name) AS name, max(name) AS last FROM (SELECT source AS stem, source || '.' || CAST(doc_id AS VARCHAR) AS name FROM documents) GROUP BY stem")
def scan_first_stem(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("stem"), F.concat("source", F.lit("."), F.col("doc_id").cast("string")).alias("name"))
    first = leakage.first_per_key(rows, ["stem"], ["name"])
    return first.join(rows.groupBy("stem").agg(F.max("name").alias("last")), "stem")


SCORED = f"(SELECT vec_id AS stem, CAST(label < 5 AS INT) AS label, CAST(label AS DOUBLE) / 10 AS prob FROM embeddings)"
PAIRED = f"(SELECT s.stem, s.label, printf('%.6f', s.prob) AS p_ai, printf('%.6f', t.score) AS attn_max, CAST(t.token AS INT) AS top_token, printf('%.4f', m.mass) AS border_mass, printf('%.4f', m.share) AS border_share FROM {SCORED} s JOIN (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, token) AS n FROM {TOKENS}) t ON t.image = s.stem AND t.n = 1 JOIN (SELECT image, coalesce(sum(score) FILTER (WHERE ring = 0), 0) AS mass, avg(CASE WHEN ring = 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM {TOKENS} GROUP BY image) m ON m.image = s.stem)"


def paired(spark, d) -> DataFrame:
    scored = t(spark, d, "embeddings").select(F.col("vec_id").alias("stem"), (F.col("label") < 5).cast("int").alias("label"), F.lit(0).alias("variant"), F.lit("identity").alias("plan"), (F.col("label").cast("double") / 10).alias("prob"))
    return attention.pair_summary(scored.join(grids(spark, d).withColumnRenamed("image", "stem"), "stem"))


@query(f"SELECT * FROM {PAIRED}")
def pair_summary(spark, d):
    return paired(spark, d).select("stem", "label", "p_ai", "attn_max", "top_token", "border_mass", "border_share")


@query(f"SELECT label, count(*) AS variants, avg(CAST(p_ai AS DOUBLE)) AS p_ai, avg(CAST(border_mass AS DOUBLE)) AS border_mass, avg(CAST(border_share AS DOUBLE)) AS border_share FROM {PAIRED} GROUP BY label", "p_ai border_mass border_share")
def pair_summary_stats(spark, d):
    return attention.pair_stats(paired(spark, d))


@query(f"SELECT label, avg(mass) FILTER (WHERE layer = 1) AS \"1\", avg(mass) FILTER (WHERE layer = 2) AS \"2\" FROM (SELECT l_returnflag AS label, l_linenumber AS layer, l_discount AS mass FROM lineitem) GROUP BY label", '"1" "2"')
def layer_table(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("layer"), F.col("l_discount").cast("double").alias("mass"))
    return attention.layer_table(rows, [1, 2])


@query(f"SELECT count(*) AS jobs, count(*) FILTER (WHERE transpose) AS transposed, count(*) FILTER (WHERE resamples > 0) AS resampled, count(*) FILTER (WHERE NOT feasible) AS under_covered, min(cover) AS min_cover, max(cover) AS max_cover FROM ({ORACLE_SQL['crop_jobs']})", "min_cover max_cover")
def job_summary(spark, d):
    rows = headers(spark, d).select(F.concat_ws("|", "path", (F.col("width") * 40).cast("string"), (F.col("height") * 200).cast("string")).alias("src"), (F.col("width") * 40).alias("width"), (F.col("height") * 200).alias("height")).distinct()
    return planning.job_summary(planning.crop_jobs(rows, [(1024, 768), (512, 512), (640, 1280)], seed=1, sigma=8.0)).drop("upscaled")


@query("SELECT 'i' AS stem, CAST(max(doc_id) + 1 AS INT) AS next FROM documents WHERE doc_id >= 1")
def next_indexed_path(spark, d):
    names = t(spark, d, "documents").select(F.format_string("i_%06d.png", "doc_id").alias("name"))
    return etl.next_index(names, "i").select(F.lit("i").alias("stem"), "next")
