"""9. URL filters: rules first, then naive Bayes over the words of segmented hosts and paths.

A unigram lexicon is counted over the text of all pages. Runs of letters in host names and paths are split into words by
Viterbi over the lexicon: the substrings of distinct runs are joined to it. Nobody has labelled the pages, so the classifier
is trained on weak labels that have nothing to do with the rules: a host that has one of a short list of seed words among
its words is an example of a blocked one, all others are examples of allowed ones. Multinomial naive Bayes learns from them
how much every word of a host, counted once for each distinct host, and every word of a path, counted once for each page
and apart from the words of hosts, speaks for one or the other. The classes' word frequencies are smoothed by those of all
words together, so that rare words of the larger class aren't taken for the smaller one's. A page's score is the log odds of
the classes among hosts, plus what its host's words add, which equal hosts share, and its path's; above 0 it is blocked.

Lexicon, class counts and weights hold all words, as written tables; nothing but a few sums is collected. Runs and words may
have any length.

A null url or one without :// has an empty host and path and, as no rule fits and it has no words, is allowed; so is a tie.
Numbers are no words. Pages without text add nothing to the lexicon. Empty tables give empty results. Rows with the same id
or url stay separate rows, a null id stays null, and columns other than the id, the url and the html are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, join_hot

# Rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words that make a host an example of a blocked one.
SEEDS = "adult ads bet bets betting casino cheap farm free gambling loan loans lottery pharma pills poker porn sex spam viagra xxx".split()
#: Letters of the longest word that is found as a whole among the substrings of a run; a longer one is found by so many first letters.
ANCHOR = 24
#: Words of so many letters are in so many runs that their rows are dealt to this many keys each.
SHORT, SALTS = 2, 32
#: Words that each class is given besides its own, in the proportions of all words together.
SMOOTHING = 50.0

_TAG = re.compile(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
RUN = r"\p{L}+"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _page_words(batches):
    for _, texts in chunks(batches, "html", 2 << 20, 4096):
        counts = Counter()
        for x in texts:
            if x:
                counts.update(_WORD.findall(_TAG.sub(" ", x).lower()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})


class Segmenter:
    """Splits a run of letters into the words with the highest product of unigram probabilities; of equal ones, that with the longest last word.

    counts are those of all words, or of those alone that the run holds, with the total of all words. A word that isn't
    known is ten times less likely with each letter.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = max(1, sum(counts.values()) if total is None else total)
        self.costs = {w: -math.log(n / total) for w, n in counts.items()}
        self.rare, self.letter = math.log(total), math.log(10)
        self.longest = max(ANCHOR, max(map(len, counts), default=0))

    def split(self, run: str) -> list[str]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        # of the unknown words that end somewhere the best one is that which extends the best unknown word so far
        open_cost, open_start = math.inf, 0
        for end in range(1, n + 1):
            if best[end - 1] + self.rare < open_cost:
                open_cost, open_start = best[end - 1] + self.rare, end - 1
            open_cost += self.letter
            best[end], back[end] = open_cost, open_start
            for start in range(max(0, end - self.longest), end):
                cost = self.costs.get(run[start:end])
                if cost is not None and best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]


def _candidates(batches):
    """The substrings of each run that can be words of the lexicon, or the first letters of longer ones."""
    made = lambda rows: pa.RecordBatch.from_pydict({"run": pa.array([r for r, _ in rows], pa.string()), "word": pa.array([w for _, w in rows], pa.string())})
    for batch in batches:
        rows = []
        for run in batch.column("run").to_pylist():
            rows += [(run, w) for w in sorted({run[a:b] for a in range(len(run)) for b in range(a + 1, min(len(run), a + ANCHOR) + 1)})]
            if len(rows) >= 50_000:
                yield made(rows)
                rows = []
        yield made(rows)


def _split(total: int):
    def run(batches):
        for batch in batches:
            runs, found = batch.column("run").to_pylist(), batch.column("found").to_pylist()
            words = [Segmenter({x["word"]: x["n"] for x in own or ()}, total).split(r) for r, own in zip(runs, found, strict=True)]
            yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.string()), "words": pa.array(words, pa.list_(pa.string()))})

    return run


def lexicon_of(pages: DataFrame) -> tuple[DataFrame, int]:
    """word and n of all words of the pages' texts and of the seeds, as a written table, and the sum of n. A seed that no text has is as frequent as the median word."""
    counted = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_page_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted, "url-words")
    middle, total = counted.agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long"), F.coalesce(F.sum("n"), F.lit(0))).first()
    middle = max(1, middle or 1)
    seen = {r.word for r in counted.where(F.col("word").isin(SEEDS)).select("word").collect()}
    missing = [(w, middle) for w in SEEDS if w not in seen]
    if missing:
        counted = counted.unionByName(pages.sparkSession.createDataFrame(missing, "word string, n bigint"))
    return counted, total + middle * len(missing)


def segmented(runs: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """run and words of every row of runs (run, distinct)."""
    salt = F.when(F.length("word") <= SHORT, F.pmod(F.hash("run"), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.length("key") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = runs.mapInArrow(_candidates, "run string, word string").select("run", F.col("word").alias("key"), salt.alias("salt"))
    known = lexicon.select(F.substring("word", 1, ANCHOR).alias("key"), "word", "n").select("*", F.explode(salts).alias("salt"))
    # a word longer than its key is in the run or not: that of its first letters alone isn't enough
    matched = asked.join(known, ["key", "salt"]).where((F.length("word") <= ANCHOR) | F.contains("run", F.col("word")))
    matched = matched.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return runs.join(matched, "run", "left").mapInArrow(_split(total), "run string, words array<string>")


def _weights(counts: DataFrame) -> DataFrame:
    """word and weight (above 0: speaks for blocking) of counts (word, block, allow)."""
    block, allow = counts.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    share = (F.col("block") + F.col("allow")) * (SMOOTHING / max(1, block + allow))
    return counts.select("word", (F.log((F.col("block") + share) / (block + SMOOTHING)) - F.log((F.col("allow") + share) / (allow + SMOOTHING))).alias("weight"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of naive Bayes, null under a rule) of every row of pages (page_id, url, html)."""
    host, path = parts(F.col("url").cast("string"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    urls = cut(urls, "url-parts")
    lexicon, total = lexicon_of(pages)

    # the distinct hosts, and the distinct runs of letters of hosts and paths with their words
    runs_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit(RUN), F.lit(0))
    hosts = cut(urls.groupBy("host").agg(F.count("*").alias("pages")), "url-hosts")
    of_host = hosts.select("host", F.posexplode(runs_of("host")).alias("at", "run"))
    of_path = urls.select("row", "host", F.posexplode(runs_of("path")).alias("at", "run"))
    sizes = of_host.groupBy("run").agg(F.count("*").alias("in_hosts")).join(of_path.groupBy("run").agg(F.count("*").alias("in_paths")), "run", "full")
    runs = cut(segmented(sizes.select("run"), lexicon, total).join(sizes, "run"), "url-runs")

    # hosts with their words, and the weak label that these give
    words = join_hot(of_host, runs.where("in_hosts is not null").select("run", "words", F.col("in_hosts").alias("n")), "run", "n")
    words = words.groupBy("host").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "words")))["words"]).alias("words"))
    words = words.withColumn("block", F.arrays_overlap("words", F.array(*map(F.lit, SEEDS))))
    hosts = cut(hosts.join(words, "host", "left").withColumns({"words": F.coalesce("words", F.array().cast("array<string>")), "block": F.coalesce("block", F.lit(False))}), "url-labels")

    # how often words are in hosts, and in paths of pages, of either label
    of = lambda label: F.count_if(F.col("block") == F.lit(label)).alias("block" if label else "allow")
    in_hosts = hosts.select("block", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(of(True), of(False))
    labelled = join_hot(of_path.select("host", "run"), hosts.select("host", "block", "pages"), "host", "pages")
    by_run = labelled.groupBy("run").agg(of(True), of(False)).join(runs.select("run", "words"), "run")
    in_paths = by_run.select("block", "allow", F.explode("words").alias("word")).groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    blocked, every = hosts.agg(F.count_if("block"), F.count("*")).first()
    odds = math.log((blocked + 1) / (every - blocked + 1))
    host_weights, path_weights = cut(_weights(in_hosts), "url-host-weights"), cut(_weights(in_paths), "url-path-weights")

    # scores of hosts, of the runs of paths, and of pages
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    each = hosts.select("host", F.posexplode("words").alias("at", "word"))
    sizes = each.groupBy("word").agg(F.count("*").alias("n"))
    scored = join_hot(each, host_weights.join(sizes, "word"), "word", "n")
    scored = scored.groupBy("host").agg(summed(F.array_sort(F.collect_list(F.struct("at", "weight")))["weight"]).alias("host_score"))
    hosts = cut(hosts.select("host", "pages").join(scored, "host", "left"), "url-host-scores")
    of_run = runs.where("in_paths is not null").select("run", F.posexplode("words").alias("at", "word"))
    sizes = of_run.groupBy("word").agg(F.count("*").alias("n"))
    of_run = join_hot(of_run, path_weights.join(sizes, "word"), "word", "n").groupBy("run").agg(summed(F.array_sort(F.collect_list(F.struct("at", "weight")))["weight"]).alias("weight"))
    of_run = cut(of_run.join(runs.select("run", F.col("in_paths").alias("n")), "run"), "url-run-weights")
    paths = join_hot(of_path.select("row", "at", "run"), of_run, "run", "n").groupBy("row").agg(summed(F.array_sort(F.collect_list(F.struct("at", "weight")))["weight"]).alias("path_score"))
    judged = join_hot(urls, hosts, "host", "pages").join(paths, "row", "left")
    found = F.when(F.coalesce("host_score", "path_score").isNotNull(), F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)) + odds)
    score = F.when(F.col("verdict").isNull(), F.coalesce(found, F.lit(0.0)))
    judged = judged.withColumn("score", score)
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark, sf_dir):
    from .common import table

    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
