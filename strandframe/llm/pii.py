"""PII: base patterns, and bootstrapped contexts that discover further identifiers. No Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.state import cut, table

KINDS = ("email", "ip", "card", "phone", "context")

# The patterns below match what the plain ones in their comments match, from the same places, but
# step over each character a bounded number of times and never recurse, whatever the text.
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-])(?!\.[A-Za-z0-9-])"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9])(?![\x20-][0-9])"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates for discovery are runs without white space, of any length. Plain ones hold letters (and what
# is not ASCII) between punctuation at the edges, and no @: none touches a base span, so they are
# read only if a pattern of such a shape has its seeds elsewhere. Runs of punctuation alone are none.
_PLAIN = r"[\p{Punct}&&[^@]]*+[^\s\p{Punct}0-9]*+[\p{Punct}&&[^@]]*+(?!\S)"
CANDIDATE = rf"(?<!\S)(?!{_PLAIN})\S++"
PLAIN = rf"(?<!\S)(?={_PLAIN})\p{{Punct}}*+[^\s\p{{Punct}}]\S*+"
PLAIN_SHAPE = "^[aAu]+$"

#: Characters of the gap before a candidate in which its left word is sought.
LEFT = 48
ROUNDS = 3
#: Every pattern is used in which so many distinct seeds stand and whose score reaches the bound.
LEAST_SEEDS, LEAST_SCORE = 3, 0.8
#: Characters up to which patterns, shapes or discovered spans are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CHARS = 8_000_000
#: Weight of the doubt that every pattern starts with, in instances.
DOUBT = 0.5


#: Spans of a text that are replaced at once; keeps the work near linear in the text.
MASKED = 64
#: Matches whose running lengths are added up at once; keeps the work linear in their number.
CHUNK = 256


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")


def _chunk_totals(lengths: str) -> Column:
    """Running totals of an array column within each CHUNK of its numbers."""

    def totals(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + v)))

    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / CHUNK), F.lit(0)).cast("int"))
    return F.transform(chunks, lambda k: totals(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))))


def located(df: DataFrame, out: str, text: str, pattern: str, may: Column) -> DataFrame:
    """`df` with `out`: the matches as (start, end, found, before), in code points.

    `before` has the last LEFT characters since the start of the match before. None where `may` is false.
    Arrays become columns step by step, as a lambda makes what it closes over anew each time.
    """
    t = F.col(text)
    df = df.withColumn("__found", F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__gaps", F.when(F.size("__found") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__lengths", F.zip_with("__found", F.slice("__gaps", 1, F.size("__found")), lambda m, g: F.length(m) + F.length(g)))
    df = df.withColumn("__local", _chunk_totals("__lengths"))
    sums = F.transform("__local", lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))
    zero = F.array().cast("array<int>")
    before = F.aggregate(sums, F.struct(F.lit(0).alias("at"), zero.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    df = df.withColumn("__before", before)
    df = df.withColumn("__ends", F.flatten(F.zip_with("__local", "__before", lambda x, o: F.transform(x, lambda v: v + o))))
    df = df.withColumn("__last", F.concat(F.array(F.lit("")), F.transform("__found", lambda m: F.substring(m, -LEFT, LEFT))))
    df = df.withColumn("__left", F.zip_with("__last", "__gaps", lambda m, g: F.substring(F.concat(m, F.coalesce(g, F.lit(""))), -LEFT, LEFT)))
    pairs = F.zip_with("__found", F.slice("__left", 1, F.size("__found")), lambda m, b: F.struct(m.alias("found"), b.alias("before")))
    spans = F.zip_with(pairs, "__ends", lambda p, e: F.struct((e - F.length(p["found"])).alias("start"), e.alias("end"), p["found"].alias("found"), p["before"].alias("before")))
    spans = F.when(F.size("__found") > 0, spans).otherwise(_empty())
    return df.withColumn(out, spans).drop("__found", "__gaps", "__lengths", "__local", "__before", "__ends", "__last", "__left")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int"))
    value = F.transform(each, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with an array of located spans in each of the columns email, ip, card and phone."""
    t = F.col(text)
    small = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
    part_fits = lambda p: small(p) & (F.when(small(p), p).try_cast("decimal(38,0)").cast("double") <= 255)
    ip_fits = lambda x: F.forall(F.split(F.regexp_replace(x["found"], r"(^|\.)0+(?=[0-9])", "$1"), r"\."), part_fits)
    card_fits = lambda x: F.length(_digits(x["found"])).between(16, 19) & F.when(F.length(_digits(x["found"])).between(16, 19), luhn(_digits(x["found"]))).otherwise(False)
    phone_fits = lambda x: F.length(_digits(x["found"])).between(8, 15)
    df = located(df, "email", text, EMAIL, t.contains("@"))
    for kind, pattern, may, fits in (("ip", IP, t.rlike(r"[0-9]\.[0-9]"), ip_fits), ("card", CARD, t.rlike(r"[0-9][\x20-]?[0-9]"), card_fits), ("phone", PHONE, t.contains("+"), phone_fits)):
        df = located(df, f"__{kind}", text, pattern, may).withColumn(kind, F.filter(f"__{kind}", fits)).drop(f"__{kind}")
    return df


def _all_base() -> Column:
    return F.concat("email", "ip", "card", "phone")


def candidates(df: DataFrame, text: str = "text", pattern: str = CANDIDATE) -> DataFrame:
    """`df`, after base_spans, with `cand`: (start, end, token, shape, pattern, seed) of each candidate.

    The token is the run without the punctuation at its edges, of 6 characters or more; its
    pattern is the word on its left, lower-cased, and the token's shape; seed tells that it
    touches a base span.
    """
    bare = lambda x: F.regexp_replace(x, r"^\p{Punct}++(?!$)|(?<!\p{Punct})\p{Punct}++$", "")
    df = located(df, "runs", text, pattern, F.lit(True)).withColumn("spans0", _all_base())

    def one(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["found"], r"^(\p{Punct}*+)(?!$)", 1))
        token = bare(x["found"])
        begin = x["start"] + lead
        left = F.lower(F.regexp_extract(x["before"], r"(\S{1,40})\s{1,3}$", 1))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]++", "a"), "[A-Z]++", "A"), "[0-9]", "9"), r"[^\x21-\x7e]++", "u")
        seed = F.exists("spans0", lambda s: (s["start"] < begin + F.length(token)) & (begin < s["end"]))
        return F.struct(begin.alias("start"), (begin + F.length(token)).alias("end"), token.alias("token"), shape.alias("shape"), F.concat_ws(" ", left, shape).alias("pattern"), seed.alias("seed"), (left != "").alias("has_left"))

    cand = F.when(F.size("runs") > 0, F.filter(F.transform("runs", one), lambda c: c["has_left"] & (F.length(c["token"]) >= 6)))
    return df.withColumn("cand", cand).drop("runs", "spans0")


def near(df: DataFrame, *texts: str) -> DataFrame:
    """`df`, marked for broadcast if its texts are few."""
    size = df.agg(F.sum(sum((F.length(t) + 40 for t in texts), F.lit(0)))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_CHARS else df


def _held(source: DataFrame, pattern: str) -> DataFrame:
    # An outer generator: for an inner one Spark adds a filter on the array, works the whole chain of
    # span columns into it, and computes them many times over.
    return candidates(base_spans(source), pattern=pattern).select("digest", F.inline_outer("cand")).where("token is not null").drop("has_left")


def learn_patterns(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pattern, score, seeds) of the patterns that hold mostly known identifiers, and the candidates.

    Pattern and instance (token) form a bipartite graph over the whole table. Seeds have
    confidence 1. In each round a pattern's score is the mean confidence of its distinct
    instances, with half an instance of doubt, and an unknown instance's confidence is the mean
    score of its distinct patterns; patterns with few seeds score 0. Only aggregates and joins
    on patterns and instances run; both sides of a join are tables that Spark can split. A
    token's patterns all end in its shape, so shapes in which no pattern has its seeds are left
    out of the graph without a change to a score.
    """
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    held = table(_held(source, CANDIDATE), "candidates")
    seeded = held.where("seed").groupBy("shape", "pattern").agg(F.count_distinct("token").alias("n")).where(F.col("n") >= LEAST_SEEDS)
    shapes = table(seeded.select("shape").distinct(), "shapes")
    if not shapes.where(F.col("shape").rlike(PLAIN_SHAPE)).isEmpty():
        held = held.unionByName(table(_held(source, PLAIN), "plain"))
    held = held.join(near(shapes, "shape"), "shape", "left_semi")
    edges = table(held.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
    known = cut(edges.groupBy("token").agg(F.max(F.col("seed").cast("int")).cast("double").alias("belief")))
    support = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"))
    belief = known
    for _ in range(ROUNDS):
        scores = edges.join(belief, "token").groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + DOUBT)).alias("score"))
        scores = cut(scores.join(support, "pattern").withColumn("score", F.when(F.col("seeds") >= LEAST_SEEDS, F.col("score")).otherwise(0.0)))
        heard = edges.join(scores, "pattern").groupBy("token").agg(F.avg("score").alias("heard"))
        belief = cut(known.join(cut(heard), "token").select("token", F.greatest("belief", "heard").alias("belief")))
    return scores.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("score") >= LEAST_SCORE)), held


def _with_context(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with base span columns and `context`: spans that confident patterns discover.

    Equal texts have equal spans: discovered spans are gathered by the text's digest.
    """
    good, held = learn_patterns(docs, text_col)
    new = held.where("not seed").join(near(table(good.select("pattern"), "patterns"), "pattern"), "pattern", "left_semi").select("digest", "start", "end", "token").distinct()
    span = F.struct("start", "end", F.col("token").alias("found"), F.lit("").alias("before"))
    spans = table(new.groupBy("digest").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.sum(F.length("token") + 24).alias("size")), "contexts")
    size = spans.agg(F.sum("size")).first()[0] or 0
    spans = spans.select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans0"))
    df = docs.withColumn("text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__digest", F.md5("text"))
    df = df.join(F.broadcast(spans) if size <= BROADCAST_CHARS else spans, "__digest", "left")
    return base_spans(df).withColumn("context", F.coalesce("__spans0", _empty())).drop("__spans0", "__digest")


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context for every row of `docs`.

    Spans are kind:start:end in code points, ends exclusive, by kind and then start. Base kinds
    are leftmost and do not overlap within a kind; matches that fail their check are dropped.
    `context` spans are tokens of 6 characters or more that touch no base span and stand in a
    pattern learned from the whole table: a left word and a shape that hold mostly known
    identifiers. Null and empty texts have no span and the digest of "". Null ids and
    repeated rows come back as they are; other columns are not read.
    """
    df = _with_context(docs.select(F.col(id_col), F.col(text_col)), text_col)
    base = F.concat(*map(_listed, KINDS[:4]))
    out = df.withColumn("base", F.array_join(base, ",")).withColumn("more", F.array_join(_listed("context"), ","))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    spans = F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "more")))
    return out.select(id_col, *sizes, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size("context").cast("long").alias("n_context"))


def mask(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span of its texts replaced by its kind in brackets.

    Spans that overlap become one, named for the first. A null text stays null. `count_col`, if
    it is a column, gets the new text's length. All other columns, whatever their names, and the
    columns' order stay as they are. Texts are put together MASKED spans at a time.
    """
    names = docs.columns
    inner = [f"__column_{i}" for i in range(len(names))]  # no name of a column can clash with those of the spans
    original = inner[names.index(text_col)]
    df = _with_context(docs.toDF(*inner), original)

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    df = df.withColumn("__spans", F.array_sort(F.concat(*map(tagged, KINDS))))
    lots = F.sequence(F.lit(0), F.greatest(F.floor((F.size("__spans") - 1) / MASKED), F.lit(0)).cast("int"))
    df = df.withColumn("__lots", F.when(F.size("__spans") > 0, F.transform(lots, lambda k: F.slice("__spans", k * MASKED + 1, F.lit(MASKED)))))
    t = F.col("text")

    def put(lot: Column, begin: Column, part: Column) -> Column:
        """The part of the text from `begin` with the lot's spans replaced."""

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            piece = F.concat(F.substr(part, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(lot, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def on(acc: Column, lot: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(lot, lambda s: s["end"])))
        part = F.substr(t, acc["at"] + 1, end - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(put(lot, acc["at"], part))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate("__lots", start, on, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(t, acc["at"] + 1, F.length(t))))
    df = df.withColumn("__new", F.when(F.col(original).isNull() | (F.size("__spans") == 0), F.col(original)).otherwise(masked))
    length = F.length("__new")
    out = [F.col("__new") if c == original else F.when(F.size("__spans") > 0, length.cast(docs.schema.fields[i].dataType)).otherwise(F.col(c)) if names[i] == count_col else F.col(c) for i, c in enumerate(inner)]
    return df.select(*(c.alias(f"__out_{i}") for i, c in enumerate(out))).toDF(*names)

