"""A training corpus from documents: language, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
docs needs doc_id and text (the language stage, to learn from, lang too); all columns are carried along, whatever their
names. Empty tables give empty results. A null id stays null. What stages do with null texts, ties and repeated rows stands
at each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.byte_bpe import byte_bpe_encode
from siftwell.llm.common import columns, cut, done, free_name, table
from siftwell.llm.decontamination import decontaminate
from siftwell.llm.jaccard_join import jaccard_components
from siftwell.llm.language_id import UND, fit, held_out, judge
from siftwell.llm.secrets import masked, spans_in
from siftwell.sources.session import ship

#: A document goes unless its main language covers more of its letters than this many even shares of all languages, or than
#: the largest share that is asked for where there are few languages.
EVEN_SHARES, MOST_ASKED = 1.2, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language. Null texts and texts without letters of a learned script go; a tie of languages goes
    too, if neither covers enough; repeated rows are judged alike. Where no row has a label, nothing can be told and all rows go.
    """
    ship(spark)
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    least = min(MOST_ASKED, EVEN_SHARES / max(1, len(model.langs)))
    found = free_name(docs, "found")
    judged = docs.withColumn(found, judge(model, with_spans=False)(F.col("text").cast("string")))
    return judged.where((F.col(found)["lang_pred"] != UND) & (F.col(found)["score"] > least)).select(columns(docs))


def _identity(docs: DataFrame) -> tuple[str, str, DataFrame]:
    """docs with what tells a document: its id and a hash of its id and text, under names that docs doesn't have."""
    own_id, key = free_name(docs, "own_id"), free_name(docs, "own_key")
    number = F.col("doc_id").cast("long")
    return own_id, key, docs.withColumns({own_id: number, key: F.xxhash64(number, F.col("text").cast("string"))})


#: Documents up to which a list of them is broadcast (16 bytes each); a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _listed(rows: DataFrame, own_id: str, key: str, listed: DataFrame, how: str) -> DataFrame:
    """rows whose id (a null one too) and key are among listed's first two columns (left_semi), or aren't (left_anti)."""
    listed = listed.toDF("listed_id", "listed_key")
    same = rows[own_id].eqNullSafe(listed["listed_id"]) & (rows[key] == listed["listed_key"])
    return rows.join(F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed, same, how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id (null ids come last; among texts of one id,
    the smallest hash). Null texts and texts without words are no duplicates and stay. Rows of equal id and text are one
    document, of which one row stays.
    """
    ship(spark)
    own_id, key, rows = _identity(docs)
    found = cut(jaccard_components(docs).select("doc_id", "key", "kept"), "pipeline-found")
    gone = cut(found.where("not kept").select("doc_id", "key").distinct(), "pipeline-gone")
    rest = _listed(rows, own_id, key, gone, "left_anti")
    # texts travel only where rows repeat
    repeated = cut(found.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key"), "pipeline-repeated")
    if repeated.isEmpty():
        return rest.select(columns(docs))
    nth = free_name(rest, "nth")
    first = F.row_number().over(Window.partitionBy(own_id, key).orderBy(key))
    once = _listed(rest, own_id, key, repeated, "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return _listed(rest, own_id, key, repeated, "left_anti").unionByName(once).select(columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts stay; repeated rows stay or go together."""
    ship(spark)
    own_id, key, rows = _identity(docs)
    hit = decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=(own_id, key)).where("n_hit > 0").select(own_id, key)
    return _listed(rows, own_id, key, cut(hit.distinct(), "pipeline-hit"), "left_anti").select(columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars, if there is one, told anew. Null texts stay null."""
    ship(spark)
    text = F.col("text").cast("string")
    spans, new = free_name(docs, "own_spans"), free_name(docs, "masked")
    rows = docs.withColumn(spans, spans_in(text))
    every = F.array_sort(F.concat(F.col(spans)["base"], F.col(spans)["found"]))
    rows = rows.withColumn(new, F.when(text.isNotNull(), masked(text, every)))
    told = {"text": F.col(new), "n_chars": F.length(F.col(new))}
    return rows.select(*[told[c].cast(docs.schema[c].dataType).alias(c) if c in told else x for c, x in zip(docs.columns, columns(docs), strict=True)])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the decoded bytes, of every row. A null text has no tokens."""
    import public_tokenizers

    ship(spark)
    return byte_bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("token_ids", token_ids)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        done(last)
    return docs
