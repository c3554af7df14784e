"""4. Personal data by bootstrapped contextual extraction, with built-in functions alone.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers: the seeds. Every other string that looks
like an identifier (five digits, spaced or bracketed numbers, an @) is a candidate. The word before a span, and it together
with the word after, are its lexical patterns; patterns and instances make a bipartite graph, on which Spark scores both
sides in turn: a pattern by the share of its instances that are known, an instance by the patterns that propose it. How
much a candidate's form is like that of the pattern's known instances (digits, @, size) lowers its score, and decides
between their kinds. Candidates with a high score, through a pattern that enough known instances induced, are known from
then on and induce patterns themselves, until a round finds nothing. Base spans always stay.

All texts are searched whole, in time that grows with their length; words and identifiers may be of any length. Patterns
and instances that very many rows share are joined by broadcast, and all others by a shuffle.

Null texts count as empty and have no spans; their digest is that of an empty string. Rows with the same id or text stay
separate rows, a null id stays null, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, digest, join_hot, leaves, piece, scan, spans_of

# The base rules. Possessive quantifiers match as greedy ones do here, in linear time and constant stack; a
# match starts where a run of its first class starts or the last match ended, which any leftmost match does.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Candidates: runs of identifier characters with a digit in them, spaced or bracketed numbers, strings with an @.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])[A-Za-z@._+-]*+[0-9][A-Za-z0-9@._+-]*+"
SPACED = r"(?<![A-Za-z0-9@._+-])[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?![A-Za-z0-9@_+])"
AT = r"(?<![A-Za-z0-9@._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
#: A word of a pattern: a run of letters or of digits; the one before a span is taken with the marks that follow it.
BEFORE = r"((?:(?<!\p{L})\p{L}++|(?<!\p{N})\p{N}++)[^\p{L}\p{N}\s]*+)\s*+\z"
AFTER = r"\A[^\p{L}\p{N}]*+(\p{L}++|\p{N}++)"
#: Code points in which a word next to a span is looked for first, then next; at last it is looked for in the whole text.
REACH = (64, 4096, 262_144)
#: Rounds of bootstrapping, at most; they end when one finds nothing.
ROUNDS = 4
#: Known instances that must have induced a pattern, least score of a pattern, least score of an instance.
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 5, 0.8, 0.8
#: Share of an instance's score that hangs on its form.
FORM = 0.3
#: Code points up to which an instance is told by its text; a longer one is told by its digest.
TOLD = 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit checks the others: every second digit from the right counts double, less 9 if over 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, r"\A0++(?=[0-9])", "")
    return (F.length(short) <= 3) & (short.cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """The base rules' spans, by kind as listed, then start: array of (order, start, end, kind, text)."""

    def mark(spans: Column, kind: str) -> Column:
        order = KINDS.index(kind) + 1
        return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))

    email = spans_of(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(spans_of(text, IP), lambda s: F.forall(F.split(s["text"], r"\."), _part_fits))
    card = F.filter(spans_of(text, CARD), lambda s: F.length(_digits(s["text"])).between(13, 19))
    card = F.filter(card, lambda s: _luhn(_digits(s["text"])))
    phone = F.filter(spans_of(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["text"])).between(9, 15))
    return F.concat(mark(email, "email"), mark(ip, "ip"), mark(card, "card"), mark(phone, "phone"))


def _beside(cut_up: Column, size: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The words before and after a span, lower-cased; empty where there is none."""

    def before(reach: tuple[int, ...]) -> Column:
        if not reach:
            return F.regexp_extract(piece(cut_up, F.lit(0).cast("long"), start), BEFORE, 1)
        near = piece(cut_up, F.greatest(start - reach[0], F.lit(0)), start)
        whole = F.regexp_extract(near, r"(?<=[\s\S])" + BEFORE, 1)  # not cut off by the window
        return F.when(start <= reach[0], F.regexp_extract(near, BEFORE, 1)).when(whole != "", whole).otherwise(before(reach[1:]))

    def after(reach: tuple[int, ...]) -> Column:
        if not reach:
            return F.regexp_extract(piece(cut_up, end, size), AFTER, 1)
        near = piece(cut_up, end, F.least(end + reach[0], size))
        whole = F.regexp_extract(near, AFTER + r"(?=[\s\S])", 1)
        return F.when(end + reach[0] >= size, F.regexp_extract(near, AFTER, 1)).when(whole != "", whole).otherwise(after(reach[1:]))

    return F.lower(before(REACH)), F.lower(after(REACH))


def _instance(cut_up: Column, size: Column, s: Column, kind: Column) -> Column:
    """A span as an instance with its form and its lexical patterns: the word before, and that together with the word after."""
    before, after = _beside(cut_up, size, s["start"], s["end"])
    told = F.when(F.length(s["text"]) <= TOLD, s["text"]).otherwise(F.sha2(s["text"], 256))
    form = [F.length(_digits(s["text"])).alias("digits"), F.length(F.regexp_replace(s["text"], "[^A-Za-z0-9]", "")).alias("size"), F.contains(s["text"], F.lit("@")).cast("int").alias("at")]
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), told.alias("instance"), *form, before.alias("before"), after.alias("after"), kind.alias("kind"))


def _edges(instances: DataFrame) -> DataFrame:
    """instances with each of their patterns."""
    pair = F.when(F.col("after") != "", F.concat_ws(" ", "before", "after"))
    each = F.filter(F.array(F.concat("before", F.lit(" ")), pair), lambda x: x.isNotNull())
    return instances.where("before <> ''").select("*", F.explode(each).alias("pattern")).drop("before", "after")


def _patterns(edges: DataFrame) -> DataFrame:
    """pattern, kinds (what is known of each kind that enough known instances are of), pattern_score and n (its instances)."""

    def known(kind: str) -> Column:
        mine = F.col("kind") == kind
        return F.struct(F.lit(kind).alias("kind"), F.count_if(mine).alias("seeds"), *[F.sum(F.when(mine, F.col(c))).alias(c) for c in ("digits", "size", "at")])

    found = edges.groupBy("pattern").agg(F.array(*map(known, KINDS)).alias("kinds"), (F.sum("score") / F.count("*")).alias("pattern_score"), F.count("*").alias("n"))
    found = found.withColumn("kinds", F.filter("kinds", lambda k: k["seeds"] >= MIN_SEEDS))
    return found.where((F.size("kinds") > 0) & (F.col("pattern_score") >= MIN_PATTERN))


def _fit() -> Column:
    """How well an instance's form fits that of the known instances of a pattern, and their kind: the best of the pattern's kinds."""

    def fit(k: Column) -> Column:
        share = 1 - F.abs(F.col("digits") / F.greatest("size", F.lit(1)) - k["digits"] / F.greatest(k["size"], F.lit(1)))
        usual = k["size"] / k["seeds"]
        like = share * (1 - F.abs(F.col("at") - k["at"] / k["seeds"])) * F.least(F.col("size"), usual) / F.greatest(F.col("size"), usual, F.lit(1))
        return F.struct((1 - FORM + FORM * like).alias("fit"), k["kind"].alias("kind"))

    return F.array_max(F.transform("kinds", fit))


def bootstrapped(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, instance, kind, rows of what patterns discover. edges: distinct pattern and instance, digits, size, at, rows (that have it), kind (of a seed, else null).

    Each round scores patterns by the scores of their instances (known ones have some, others 0), and unknown instances by
    the best pattern that proposes them; those with a high score are known from then on, with that score, and induce
    patterns of their own in the next round.
    """
    edges = cut(edges.withColumns({"score": F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0), "seed": F.col("kind").isNotNull()}), "personal-data-edges")
    for _ in range(rounds):
        patterns = cut(_patterns(edges), "personal-data-patterns")
        judged = join_hot(edges.where("kind is null").drop("kind"), patterns, "pattern", "n").withColumn("form", _fit())
        judged = judged.groupBy("instance").agg(F.max(F.struct((F.col("pattern_score") * F.col("form")["fit"]).alias("score"), F.col("form")["kind"].alias("kind"))).alias("top"))
        new = cut(judged.where(F.col("top")["score"] >= MIN_INSTANCE).select("instance", F.col("top")["score"].alias("new_score"), F.col("top")["kind"].alias("new_kind")), "personal-data-found")
        if new.isEmpty():
            break
        sizes = edges.groupBy("instance").agg(F.count("*").alias("n"))  # combined within tasks: no instance is gathered in one
        told = join_hot(edges, new.join(sizes, "instance"), "instance", "n", "left")
        edges = cut(told.select("pattern", "instance", "digits", "size", "at", "rows", F.coalesce("kind", "new_kind").alias("kind"), F.when(F.col("kind").isNull(), F.coalesce("new_score", "score")).otherwise(F.col("score")).alias("score"), "seed"), "personal-data-edges")
    found = edges.where("kind is not null and not seed").select("pattern", "instance", "kind", "rows")
    return join_hot(found, _patterns(edges).select("pattern", "n"), "pattern", "n")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and found of every row of docs (doc_id, text): arrays of spans by kind, then start."""
    text = F.col("text")
    likely = F.filter(spans_of(text, CANDIDATE, F.regexp_like(text, F.lit("[0-9]"))), lambda s: F.length(_digits(s["text"])) >= 5)
    spaced = F.filter(spans_of(text, SPACED), lambda s: F.length(_digits(s["text"])).between(7, 19) & F.regexp_like(s["text"], F.lit("[\\x20()]")))
    every = F.concat(likely, spaced, spans_of(text, AT, F.contains(text, F.lit("@"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("*", base_spans(text).alias("base"), every.alias("likely"))
    rows = rows.select("row", "doc_id", "base", apart(F.col("likely"), F.col("base")).alias("likely"), F.when((F.size("likely") > 0) | (F.size("base") > 0), leaves(text)).alias("leaves"), F.length("text").cast("long").alias("size"))
    known = lambda spans, kind: F.transform(spans, lambda s: _instance(F.col("leaves"), F.col("size"), s, kind(s)))
    rows = rows.select("row", "doc_id", "base", known(F.col("likely"), lambda s: F.lit(None).cast("string")).alias("likely"), known(F.col("base"), lambda s: s["kind"]).alias("seeds"))
    rows = cut(rows, "personal-data")

    every = _edges(rows.select(F.inline(F.concat("seeds", "likely"))))
    edges = every.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("digits", "size", "at")])
    accepted = cut(bootstrapped(edges, rounds), "personal-data-accepted")
    hits = _edges(rows.select("row", F.inline("likely")).drop("kind")).withColumn("edge", F.struct("pattern", "instance"))
    hits = join_hot(hits, accepted.select(F.struct("pattern", "instance").alias("edge"), "kind", "rows"), "edge", "rows")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", (-F.col("end")).alias("minus"), order.alias("order"), "end", "kind", "text")
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("found"))
    reach = lambda f: scan(F.transform(f, lambda s: s["end"]), F.lit(-1).cast("long"), F.greatest)
    # by start, the longest first: a span lies within a wider one if an earlier one reaches as far
    outer = F.zip_with("found", F.concat(F.array(F.lit(-1).cast("long")), F.slice(reach(F.col("found")), F.lit(1), F.size("found") - 1)), lambda s, r: F.when(s["end"] > r, s))
    outer = F.transform(F.filter(outer, lambda s: s.isNotNull()), lambda s: F.struct(*[s[c].alias(c) for c in ("order", "start", "end", "kind", "text")]))
    found = found.select("row", F.array_sort(outer).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return rows.select("row", "doc_id", "base").join(found, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def _written(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def op4_personal_data(spark, sf_dir):
    from .common import table

    rows = personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "found"))
    return rows.select("doc_id", *map(of, KINDS), digest(_written(F.col("base"))).alias("base_sha256"), F.array_join(_written(every), ",").alias("spans"))
