"""Personal data by rules and by bootstrapped contextual extraction, in Spark functions only.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern, each
kind leftmost and non-overlapping, with code-point offsets.  A pattern is
matched twice, to cut the text and to list its matches; running sums of the
lengths of pieces and matches give the offsets.

Bootstrapping: labelled values (``word = value``, ``word: value``) and long
tokens of mixed letters and digits are instances, and so are base finds and
tokens of six characters or more with a digit; each occurrence carries the
lexical patterns around it: its label with operator, its prefix with its length
and letter classes, and the two and the three words before and after it (within
``REACH`` characters, up to the next find of the same kind).  A single word is no
pattern: "the" stands before everything.  Seed entities (instances that a base rule accepts,
or that look random) score the patterns they occur with; patterns score their
instances, and so on for a few rounds over the pattern-instance graph; word
contexts speak only once they are trusted, as a value has many of them.  Patterns
of high confidence, seen with several instances, accept all their instances,
also those that no rule knows.  Labels, not values, decide: nothing is added to
a text without such a pattern.

Very long texts: work and memory grow with a text's length and finds.  Whether a
base find covers an instance is read from a mask of the text (a byte for each code
point), overlapping spans are merged by running ends, and a text is cut from its
fixed-width form, where a place is found without counting from the start.

Defined cases: null text is empty; a null ``doc_id`` is carried as it is;
repeated rows are searched alike (rows are told apart by 128 bits of hash); an
empty table gives an empty result; extra columns are ignored by ``find`` and carried
through by ``redact``.  A pattern, value or row that very many have is a hot key:
what it joins with is broadcast (``join_hot``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .shared import join_hot, row_key, saved, tidy

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms of the contract's patterns; a match can start only where a
#: run of its first class starts, or where the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Labels and values are whole runs of any length.  A label is looked for once in
#: a run of its letters: at its start, or after its first dashes if a digit is
#: before the run.
LABELLED = r"(?<![A-Za-z_-])(?:(?<![0-9])-*+|(?<=[0-9])[A-Za-z_]*+-++)[A-Za-z_][A-Za-z_-]++\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9_+/.@-]{6,}+"
TOKEN = r"(?<![A-Za-z0-9_=/+.@-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+(?![A-Za-z0-9_=/+@-])"
_LABEL = r"^-*+([A-Za-z_][A-Za-z_-]++)\x20{0,2}[=:]"
_VALUE = r"[=:]\x20{0,2}[\"']?([A-Za-z0-9_+/.@-]++)$"

#: Rounds over the graph; confidence and instances that a pattern needs.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.6, 3
#: The same for word contexts, and characters in which their words stand.
CONTEXT_CONFIDENCE, CONTEXT_SUPPORT, REACH = 0.7, 5, 100
#: Trusted patterns that are broadcast; more are joined by a shuffle.
PATTERNS_AT_ONCE = 200_000
#: Rows and discovered spans (some 60 bytes each) that are broadcast to rewrite texts.
ROWS_AT_ONCE, SPANS_AT_ONCE = 200_000, 500_000
SPAN = "struct<start:int,ord:int,kind:string,end:int>"
_CUT = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


#: Matches that are put together at a time: an array is copied when it grows.
AT_ONCE = 256


def _groups(x: Column) -> Column:
    """Slices of AT_ONCE elements of a non-empty array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / AT_ONCE).cast("int")), lambda k: F.slice(x, k * AT_ONCE + 1, F.lit(AT_ONCE)))


def located(matches: Column, pieces: Column) -> Column:
    """array<struct<start, end, value, left, right>> from a pattern's matches and the
    pieces between them; left and right are the ends of the pieces that meet it.

    Groups of AT_ONCE matches begin where the lengths before them add up to, so
    that the work grows with the matches, not with their square."""
    steps = F.transform(
        matches,
        lambda v, i: F.struct(F.length(F.get(pieces, i)).alias("s"), F.length(v).alias("n"), v.alias("v"), F.right(F.get(pieces, i), F.lit(REACH)).alias("l"), F.left(F.get(pieces, i + 1), F.lit(REACH)).alias("r")),
    )
    total = lambda group: F.aggregate(group, F.lit(0), lambda a, x: a + x["s"] + x["n"])

    def place(group: Column, begin: Column) -> Column:
        return F.aggregate(
            group,
            F.struct(begin.alias("at"), F.array().cast(_CUT).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["s"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["s"]).alias("start"), (a["at"] + x["s"] + x["n"]).alias("end"), x["v"].alias("value"), x["l"].alias("left"), x["r"].alias("right")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    def placed(x: Column) -> Column:
        cut = _groups(x)
        begins = lambda sums: F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, y: a + y))
        return bind(cut, lambda g: bind(F.transform(g, total), lambda sums: F.flatten(F.zip_with(g, begins(sums), place))))

    return bind(steps, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def accepted(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern holds."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda x: accepted(kind, x["value"])


def _guard(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def _located_columns(df: DataFrame, wanted: dict[str, tuple[Column, str]], text: Column) -> DataFrame:
    """Adds ``c`` (located matches) for each {c: (guard, pattern)}; matching is
    kept apart from what uses it twice, so that it runs once."""
    df = df.withColumns({f"m_{c}": F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for c, (guard, p) in wanted.items()})
    df = df.withColumns({f"g_{c}": F.when(F.size(f"m_{c}") > 0, F.split(text, p, -1)) for c, (_, p) in wanted.items()})
    nothing = F.array().cast(_CUT)
    df = df.withColumns({c: F.when(F.size(f"m_{c}") > 0, located(F.col(f"m_{c}"), F.col(f"g_{c}"))).otherwise(nothing) for c in wanted})
    return df.drop(*[f"{x}_{c}" for c in wanted for x in "mg"])


def _spans(kind: str) -> Column:
    return F.transform(f"at_{kind}", lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), x["end"]).cast(SPAN))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``base``: sorted array of SPAN, by start, then kind as listed, and
    ``known``: the same finds with what is around them."""
    df = _located_columns(df, {f"at_{k}": (_guard(k, text), PATTERNS[k]) for k in KINDS}, text)
    df = df.withColumns({f"at_{k}": F.filter(f"at_{k}", _holds(k)) for k in KINDS})
    spans = [_spans(k) for k in KINDS]
    return df.withColumns({"base": F.array_sort(F.concat(*spans)), "known": F.concat(*[f"at_{k}" for k in KINDS])}).drop(*[f"at_{k}" for k in KINDS])


def _mask(kind: str) -> Column:
    """A byte for each code point up to the end of the last find of the kind in ``base``:
    x within a find (finds of one kind do not overlap)."""
    mark = lambda x, before: F.concat(F.repeat(F.lit("."), x["start"] - before), F.repeat(F.lit("x"), x["end"] - x["start"]))
    build = lambda found: F.array_join(F.transform(found, lambda x, i: mark(x, F.coalesce(F.get(found, i - 1)["end"], F.lit(0)))), "")
    return bind(F.filter("base", lambda b: b["kind"] == kind), build).cast("binary")


def _marked(spans: Column) -> Column:
    """array<struct<x, covered>>: each span, and whether a base find covers a part of it."""
    hit = lambda mask, x: F.contains(F.substring(mask, x["start"] + 1, x["end"] - x["start"]), F.lit(b"x"))
    look = lambda masks: F.transform(spans, lambda x: F.struct(x.alias("x"), F.exists(masks, lambda mask: hit(mask, x)).alias("covered")))
    free = F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(False).alias("covered")))
    return F.when((F.size("base") > 0) & (F.size(spans) > 0), bind(F.array(*[_mask(k) for k in KINDS]), look)).otherwise(free)


def shape(value: Column) -> Column:
    """Prefix of four letters, length and letter classes of a value."""
    kinds = [F.when(value.rlike(p), c).otherwise("") for p, c in (("[A-Z]", "U"), ("[a-z]", "l"), ("[0-9]", "d"), ("[^A-Za-z0-9]", "-"))]
    return F.concat(F.lit("shape "), F.substring(value, 1, 4), F.lit(" "), F.length(value).cast("string"), F.lit(" "), *kinds)


def contexts(left: Column, right: Column) -> Column:
    """Patterns of the two and the three words before and after an instance."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))
    last = lambda t, n: F.when(F.size(words(t)) >= n, F.concat(F.lit("before "), F.array_join(F.slice(words(t), -n, n), " ")))
    first = lambda t, n: F.when(F.size(words(t)) >= n, F.concat(F.lit("after "), F.array_join(F.slice(words(t), 1, n), " ")))
    return F.filter(F.array(last(left, 2), last(left, 3), first(right, 2), first(right, 3)), lambda p: p.isNotNull())


def with_instances(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``instances``: array<struct<start, end, value, patterns, seed, free>>, from
    what ``with_base`` adds; free: no base find covers a part of it."""
    df = _located_columns(df, {"at_label": (text.rlike("[=:]"), LABELLED), "at_token": (text.rlike("[0-9]"), TOKEN)}, text)

    def seed(value: Column) -> Column:
        letters, digits = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(_digits(value))
        known = value.rlike(rf"^{EMAIL}$") | (value.rlike(rf"^{CARD}$") & accepted("card", value)) | (value.rlike(rf"^{IP}$") & accepted("ip", value))
        return F.when(known, 1.0).when((F.length(value) >= 16) & (letters >= 2) & (digits >= 4), 0.9).otherwise(0.0)

    def cut(x: Column) -> Column:
        value = F.regexp_extract(x["value"], _VALUE, 1)
        return F.struct((x["end"] - F.length(value)).alias("start"), x["end"], value.alias("value"), x["value"].alias("whole"))

    def labelled(m: Column) -> Column:
        x = m["x"]
        label = F.concat(F.lit("label "), F.lower(F.regexp_extract(x["whole"], _LABEL, 1)), F.lit(" "), F.regexp_extract(x["whole"], "[=:]", 0))
        return F.struct(x["start"], x["end"], x["value"], F.array(label).alias("patterns"), seed(x["value"]).alias("seed"), (~m["covered"]).alias("free"))

    def token(m: Column) -> Column:
        x = m["x"]
        mixed = (F.length(x["value"]) >= 14) & x["value"].rlike("[A-Za-z]")
        none = F.array().cast("array<string>")
        patterns = F.concat(F.when(mixed, F.array(shape(x["value"]))).otherwise(none), F.when(m["covered"], none).otherwise(contexts(x["left"], x["right"])))
        return F.struct(x["start"], x["end"], x["value"], patterns.alias("patterns"), seed(x["value"]).alias("seed"), (~m["covered"]).alias("free"))

    def known(x: Column) -> Column:
        return F.struct(x["start"], x["end"], x["value"], contexts(x["left"], x["right"]).alias("patterns"), F.lit(1.0).alias("seed"), F.lit(False).alias("free"))

    kind = "array<struct<start:int,end:int,value:string,patterns:array<string>,seed:double,free:boolean>>"
    df = df.withColumn("at_label", F.transform("at_label", cut))
    df = df.withColumns({c: _marked(F.col(c)) for c in ("at_label", "at_token")})
    every = F.concat(F.transform("at_label", labelled).cast(kind), F.transform("at_token", token).cast(kind), F.transform("known", known).cast(kind))
    return df.withColumn("instances", F.filter(every, lambda x: F.size(x["patterns"]) > 0)).drop("at_label", "at_token", "known")


@tidy
def trusted_patterns(instances: DataFrame) -> DataFrame:
    """pattern, confidence: those that accept their instances, from occurrences
    (value, pattern, seed), by rounds over the pattern-instance graph."""
    edges = saved(instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    scores = edges.select("pattern", "value", F.col("seed").alias("score"))
    context = F.col("pattern").rlike("^(before|after) ")
    trusted = (F.col("confidence") >= F.when(context, CONTEXT_CONFIDENCE).otherwise(CONFIDENCE)) & (F.col("support") >= F.when(context, CONTEXT_SUPPORT).otherwise(SUPPORT))
    for k in range(ROUNDS):
        patterns = scores.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count("*").alias("support"))
        if k == ROUNDS - 1:
            break
        # 1 - product of doubts, as a sum of logarithms that aggregates on the map side
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
        heard = join_hot(edges, saved(patterns.filter(~context | trusted), "pii-patterns"), "pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("heard"))
        scores = saved(join_hot(edges, saved(heard, "pii-heard"), "value", "left").select("pattern", "value", F.greatest("seed", F.coalesce("heard", F.lit(0.0))).alias("score")), "pii-scores")
    return patterns.filter(trusted).select("pattern", "confidence")


def _discovered(rows: DataFrame) -> DataFrame:
    """row_key and ``more`` (array of SPAN): instances of trusted patterns, from
    rows with ``row_key`` and ``instances``."""
    found = rows.filter(F.size("instances") > 0).select("row_key", F.explode("instances").alias("x")).select("row_key", "x.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    patterns = saved(trusted_patterns(found.select("value", "pattern", "seed")), "pii-trusted")
    few = patterns.count() <= PATTERNS_AT_ONCE
    # spans that a base span covers in part are known already
    new = found.filter("free").join(F.broadcast(patterns) if few else patterns, "pattern", "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.lit("secret").alias("kind"), "end").cast(SPAN)
    return new.groupBy("row_key").agg(F.collect_set(span).alias("more"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@tidy
def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_spans for every row of ``docs`` (doc_id, text)."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", row_key())
    rows = saved(with_instances(with_base(rows, text), text).drop("text"), "pii")
    out = join_hot(rows.drop("instances"), saved(_discovered(rows), "pii-more"), "row_key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    counts = [_count(k) for k in KINDS]
    out = out.withColumn("every", spans)
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def _ends_before(spans: Column) -> Column:
    """For each span the largest end of the spans before it (0: none), then that of all."""
    most = lambda x, begin: F.aggregate(x, begin, lambda a, b: F.greatest(a, b["end"]))
    within = lambda group, begin: F.transform(group, lambda _, i: most(F.slice(group, F.lit(1), i), begin))
    begins = lambda tops: F.transform(tops, lambda _, k: F.aggregate(F.slice(tops, F.lit(1), k), F.lit(0), lambda a, b: F.greatest(a, b)))
    each = lambda g: bind(F.transform(g, lambda x: most(x, F.lit(0))), lambda tops: F.flatten(F.zip_with(g, begins(tops), within)))
    return F.concat(bind(_groups(spans), each), F.array(most(spans, F.lit(0))))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in brackets.

    A run begins where no span before it reaches; what is kept before it begins where
    the spans before it end."""

    def rebuilt(x: Column) -> Column:
        wide, found, ends = x["wide"], x["spans"], x["ends"]
        kept = lambda a, n: F.decode(F.substring(wide, a * 4 + 1, n * 4), "UTF-32")
        heads = F.filter(F.zip_with(found, F.slice(ends, F.lit(1), F.size(found)), lambda s, at: F.struct(s["start"], at.alias("at"), s["kind"])), lambda h: h["start"] >= h["at"])
        parts = F.transform(heads, lambda h: F.concat(kept(h["at"], h["start"] - h["at"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), kept(F.element_at(ends, -1), F.length(wide)))

    def begun(x: Column) -> Column:
        return bind(F.struct(F.encode(F.make_valid_utf8(text), "UTF-32").alias("wide"), x.alias("spans"), _ends_before(x).alias("ends")), rebuilt)

    return bind(spans, lambda x: F.when(F.size(x) > 0, begun(x)).otherwise(text))


@tidy
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; other columns and null texts stay.

    Discovered spans, SPANS_AT_ONCE in ROWS_AT_ONCE rows at most, are broadcast, and
    every row is rewritten where it is read; of more, only rows with instances meet
    them, by a shuffle.
    """
    text = F.col("found_text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("found_text"), row_key().alias("row_key"))
    based = with_base(packed, text)
    # a number that isn't deterministic stops the filter from being computed below the
    # columns it needs, where each of them would be worked out again
    rows = with_instances(based, text).withColumn("n", F.size("instances") + (F.rand() * 0).cast("int"))
    more = saved(_discovered(saved(rows.filter("n > 0").select("row_key", "instances"), "pii")), "pii-more")
    none = F.array().cast(f"array<{SPAN}>")
    n_rows, n_spans = more.agg(F.count("*"), F.coalesce(F.sum(F.size("more")), F.lit(0))).first()
    if n_rows <= ROWS_AT_ONCE and n_spans <= SPANS_AT_ONCE:
        out = based.drop("known").join(F.broadcast(more), "row_key", "left").withColumn("more", F.coalesce("more", none))
    else:
        plain = rows.filter("n = 0").withColumn("more", none)
        met = rows.filter("n > 0").join(more, "row_key", "left").withColumn("more", F.coalesce("more", none))
        out = plain.unionByName(met.select(plain.columns))
    new = replaced(text, F.array_sort(F.concat("base", "more")))
    return out.withColumn("new_text", F.when(F.col("row")["text"].isNotNull(), new)).select(*[F.col("new_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir):
    """op5_pii: see the contract."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
