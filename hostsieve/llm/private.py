"""Personal data: four base patterns, and identifiers that bootstrapped contexts find; all in DataFrame functions.

Base matches are the seeds. What stands before an identifier-like token, its last two or three words, is a lexical
pattern, and the tokens that a pattern stands before are its instances. Over this graph a pattern is as sure of a kind as
its instances are (smoothed, and only with several different ones), and an instance is as sure as its patterns are
together; seeds are certain. A few rounds of this are joins and sums over the edges. Then tokens that no base pattern
matches, but that sure patterns stand before, are reported as well.

Positions are code points. A match's place follows from the lengths of the pieces between matches: a text is split by the
pattern, and the same pattern gives what stands between the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsieve.sources.shared import stored

KINDS = ("email", "ip", "card", "phone")
FOUND = "found"
#: The base patterns. They match as the plain ones do, but never try again inside a run that has failed, nor
#: recurse for each repetition: a match starts where a run of its first characters starts, or where the last match ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){15})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A test that is cheap and never false where its pattern matches.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
#: A token that may be an identifier: words of these characters with a digit or an @ in each, one blank between two words.
CLASS = r"A-Za-z._%+:()/\[\]-"
WORD = rf"(?=[{CLASS}]*+[0-9@])[0-9@{CLASS}]++"
TOKEN = rf"(?<![0-9@{CLASS}]){WORD}(?:\x20{WORD})*+"
#: Characters before a token that its context is taken from.
REACH = 80
SPANS = "array<struct<kind:string,start:long,end:long>>"


def _let(value: Column, f) -> Column:
    """f of a value that is made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sums(lengths: Column, first: Column) -> Column:
    """What stands before each of the lengths, together, counted from first."""
    start = F.struct(F.array().cast("array<long>").alias("a"), first.cast("long").alias("s"))
    step = lambda acc, n: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + n).alias("s"))
    return F.aggregate(lengths, start, step, lambda acc: acc["a"])


def running(lengths: Column, block: int = 256) -> Column:
    """The running sums before each length, in blocks, so that no array is copied for each of many matches."""
    whole = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, n: s + n)
    sums = lambda c: F.flatten(F.zip_with(c, _sums(F.transform(c, whole), F.lit(0)), lambda b, at: _sums(b, at)))

    def cut(n: Column) -> Column:
        many = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(n) - 1) / block)).cast("int"))
        return F.transform(many, lambda k: F.slice(n, k * block + 1, block))

    return _let(lengths, lambda n: _let(cut(n), sums))


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (m, start, before) of the pattern's matches; before is the end of the piece in front.

    Everything that is used more than once is bound, as an expression inside a lambda is made anew for each element.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    lengths = lambda v: F.zip_with(v["p"], v["m"], lambda p, m: (F.length(p) + F.length(F.coalesce(m, F.lit("")))).cast("long"))

    def placed(v: Column, s: Column) -> Column:
        row = lambda m, k: F.struct(m.alias("m"), (F.get(s, k) + F.length(F.get(v["p"], k))).alias("start"), F.right(F.get(v["p"], k), F.lit(REACH)).alias("before"))
        return F.transform(v["m"], row)

    return F.coalesce(F.when(hint, _let(cut, lambda v: _let(running(lengths(v)), lambda s: placed(v, s)))), F.array().cast("array<struct<m:string,start:long,before:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one counts twice, its digits summed."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, k: F.when(k % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _octet(part: Column) -> Column:
    """Whether a run of digits is at most 255; leading zeros say nothing."""
    return _let(F.ltrim(part, F.lit("0")), lambda x: F.when(F.length(x) < 3, True).otherwise((F.length(x) == 3) & (x <= "255")))


def holds(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return _let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base: array of (kind, start, end) of the base matches, by kind as listed, then start."""
    some = lambda kind: F.transform(
        F.filter(matches(F.col(text), PATTERNS[kind], HINTS[kind](F.col(text))), lambda x: holds(kind, x["m"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end")),
    )
    return df.withColumn("base", F.concat(*(some(k) for k in KINDS)).cast(SPANS))


def seed_kind(m: Column) -> Column:
    """The kind of a base match that a token holds, null where there is none."""
    of = lambda kind: F.exists(F.regexp_extract_all(m, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: holds(kind, x))
    out = F.when(of(KINDS[0]), KINDS[0])
    for kind in KINDS[1:]:
        out = out.when(of(kind), kind)
    return out


def contexts(before: Column) -> Column:
    """The last two and the last three words in front of a token, in lower case, as far as they are there."""
    words = F.filter(F.split(F.lower(before), r"[^\p{L}]+"), lambda w: w != "")
    last = lambda w, n: F.when(F.size(w) >= n, F.array_join(F.slice(w, -n, n), " "))
    return _let(words, lambda w: F.array_compact(F.array(last(w, 2), last(w, 3))))


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens: array of (start, end, value, kind, patterns) of the identifier-like tokens after two or more words."""
    row = lambda x: F.struct(x["start"].alias("start"), F.rtrim(x["m"], F.lit(".:/-([%_+")).alias("value"), contexts(x["before"]).alias("patterns"))
    some = F.filter(F.transform(matches(F.col(text), TOKEN, F.col(text).rlike("[0-9@]")), row), lambda x: (F.length(x["value"]) >= 5) & (F.size(x["patterns"]) > 0))
    full = lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), seed_kind(x["value"]).alias("kind"), x["patterns"].alias("patterns"))
    return df.withColumn("tokens", F.transform(some, full))


def graph(found: DataFrame) -> DataFrame:
    """The edges (pattern, instance, seed): each pair once, instance as a hash of the token in lower case."""
    rows = found.select(F.explode("tokens").alias("t")).select(F.explode("t.patterns").alias("pattern"), F.md5(F.lower("t.value")).alias("instance"), F.col("t.kind").alias("seed"))
    return rows.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"))


def bootstrap(edges: DataFrame, rounds: int = 3, least: int = 3, sure: float = 0.6) -> DataFrame:
    """pattern, kind, confidence and support of the patterns that are sure in the last round.

    A pattern's confidence in a kind is the sum of its instances' scores over their number plus one; it needs `least`
    different instances that count. An instance's score is 1 less the product of its patterns' doubts. Instances are scored
    by the sure patterns of the round before; seeds are 1 throughout. Every round starts from the edges and the small
    table of the round before, which is written.
    """
    degree = stored(edges.groupBy("pattern").agg(F.count("*").alias("d"), F.count("seed").alias("s")).where("s > 0 or d >= %d" % least))
    seeds = edges.where("seed is not null").select("instance", "pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    known = None
    for _ in range(rounds):
        scored = seeds
        if known is not None:
            each = edges.where("seed is null").join(known.select("pattern", "kind", "confidence"), "pattern")
            score = each.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
            open_ = edges.where("seed is null").select("instance", "pattern")
            scored = seeds.unionByName(open_.join(score, "instance").select("instance", "pattern", "kind", "score"))
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("w"), F.count("*").alias("support"))
        conf = sums.join(degree, "pattern").withColumn("confidence", F.col("w") / (F.col("d") + 1))
        known = stored(conf.where((F.col("support") >= least) & (F.col("confidence") >= sure)).select("pattern", "kind", "confidence", "support"))
    return known


def find_private(documents: DataFrame, rounds: int = 3, least: int = 3, sure: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(doc_id, base, found) for each row of documents, and the patterns that found more.

    base: array of (kind, start, end), by kind as listed, then start. found: array of (kind, start, end, like, confidence)
    in order of start, kind being "found": tokens that overlap no base match, behind sure patterns; `like` is the likeliest
    kind. Null and empty texts have neither. Every row gives one row, repeated or not; an empty table gives none. Only
    doc_id and text are read. A token repeated in many copies of a passage is one instance, so copies are no evidence.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = tokens(base_spans(rows)).select("doc_id", F.monotonically_increasing_id().alias("__row"), "base", "tokens")
    rows = stored(rows)  # numbers of rows stay as they are from here on
    edges = stored(graph(rows))
    patterns = bootstrap(edges, rounds, least, sure)
    open_ = rows.select("__row", F.explode("tokens").alias("t")).where("t.kind is null")
    open_ = open_.select("__row", "t.start", "t.end", F.explode("t.patterns").alias("pattern"))
    hits = open_.join(patterns, "pattern").groupBy("__row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    taken = rows.select(F.col("__row").alias("r"), F.explode("base").alias("b"))
    apart = (F.col("__row") == F.col("r")) & (F.col("start") < F.col("b.end")) & (F.col("b.start") < F.col("end"))
    hits = stored(hits).join(taken, apart, "left_anti")
    span = F.struct(F.lit(FOUND).alias("kind"), "start", "end", F.col("best.kind").alias("like"), F.col("best.confidence").alias("confidence"))
    spans = hits.groupBy("__row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    return rows.select("doc_id", "__row", "base").join(spans, "__row", "left").drop("__row"), patterns


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of find_private's rows: counts of the base kinds, their hash, all spans as text, further spans."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    more = F.when(F.col("found").isNotNull(), joined(F.col("found"))).otherwise("")
    base = joined(F.col("base"))
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat(base, F.when((base != "") & (more != ""), ",").otherwise(""), more).alias("spans"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"),
    )
