"""Prompt-injection guard: patterns, synonyms, layered verdict, redaction, routing.

Every function takes and returns columns, so the guard fuses into whatever plan
uses it.  Expensive models are plug-ins: pandas functions that see only the rows
the cheap layers leave open (``verdicts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, blank, first_of, java

# The guard's patterns, synonym groups and letter map must equal
# those of the system whose results are matched.  (pattern, ignores case)
HARD_PATTERNS = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", True),
    (r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions?", True),
    (r"forget\s+(all\s+)?(previous|prior|above)\s+instructions?", True),
    (r"override\s+(all\s+)?instructions?", True),
    (r"new\s+instructions?\s*:", True),
    (r"updated\s+instructions?\s*:", True),
    (r"you\s+are\s+now\s+(a|an|in)", True),
    (r"act\s+as\s+(a|an)\s+\w+", True),
    (r"pretend\s+(you\s+are|to\s+be)", True),
    (r"your\s+new\s+(role|persona|identity)\s+is", True),
    (r"switch\s+to\s+(developer|admin|god|jailbreak)\s+mode", True),
    (r"you\s+are\s+in\s+(developer|admin|god|jailbreak)\s+mode", True),
    (r"DAN\s+mode", True),
    (r"reveal\s+(your|the)\s+system\s+prompt", True),
    (r"print\s+(your|the)\s+system\s+prompt", True),
    (r"show\s+(your|the)\s+(system\s+prompt|instructions)", True),
    (r"what\s+(are|is)\s+your\s+(system\s+prompt|instructions)", True),
    (r"repeat\s+(your|the)\s+(system\s+prompt|instructions)", True),
    (r"\[SYSTEM\]", False),
    (r"\[INST\]", False),
    (r"\[AGENT\]", False),
    (r"\[OVERRIDE\]", False),
    (r"\[INTERNAL\s+AI\s+INSTRUCTION\]", False),
    (r"<\s*system\s*>", False),
    (r"<\s*instructions?\s*>", False),
    (r"###\s*System", False),
    (r"###\s*Instructions?", False),
    (r"send\s+(all|this|the)\s+(data|content|document|context|history)", True),
    (r"exfiltrate", True),
    (r"leak\s+(the|all|this)\s+(data|content|document)", True),
    (r"transmit\s+(to|data)", True),
    (r"first\s+output\s+.*?then\s+answer", True),
    (r"before\s+(answering|responding)", True),
    (r"after\s+(answering|responding)", True),
    (r"jailbreak", True),
    (r"bypass\s+(safety|filter|restriction|guideline)", True),
    (r"remove\s+(safety|filter|restriction|guideline)", True),
    (r"without\s+(restriction|filter|limitation)", True),
]
ROLE_TAGS = [
    r"\[SYSTEM[^\]]*\]",
    r"\[INST[^\]]*\]",
    r"\[AGENT[^\]]*\]",
    r"<\s*system\s*>.*?<\s*/system\s*>",
    r"\[INTERNAL\s+AI\s+INSTRUCTION[^\]]*\]",
]
SUBTLE_PATTERNS = [
    r"\[.*?AI.*?\]",
    r"\[.*?note\s+to\s+(ai|assistant).*?\]",
    r"\(.*?AI.*?\)",
    r"assistant\s*:",
    r"human\s*:",
    r"<\s*/?assistant\s*>",
    r"<\s*/?human\s*>",
    r"format\s+(all|your)\s+(responses?|answers?)\s+as",
    r"always\s+(respond|reply|answer)\s+(with|in)",
    r"from\s+now\s+on",
]
SYNONYMS = {
    "ignore": ["discard", "disregard", "dismiss", "overlook", "skip", "omit", "forget", "abandon", "drop", "set aside", "put aside", "pay no attention"],
    "instructions": ["directives", "commands", "guidelines", "rules", "orders", "prompts", "guidance", "policies", "constraints", "restrictions", "mandate"],
    "previous": ["prior", "earlier", "above", "preceding", "former", "initial", "original", "old", "past"],
    "system prompt": ["system message", "base prompt", "core instructions", "initial instructions", "your instructions", "your rules", "your guidelines", "your constraints"],
}
EXTRACTION_VERBS = ["reveal", "show", "print", "tell", "repeat", "display", "output"]
LEET_FROM, LEET_TO = "01345678@$!|", "oieasgtbasii"
REDACTED = "[REDACTED]"
THRESHOLD, MAX_QUERY = 0.7, 2000
BLOCKED_EMPTY, BLOCKED_LONG, BLOCKED_CONTENT = "Empty query", "Query too long — max 2000 characters", "Query contains potentially malicious content"
REASON_REGEX, REASON_NORMAL = "Regex", "Regex (normalized)"
REASON_SYNONYM, REASON_EXTRACTION = "Synonym attack", "System prompt extraction via synonyms"
REASON_SUBTLE, REASON_POSSIBLE = "Multiple subtle patterns", "Possible"
REASON_MODEL, REASON_JUDGE = "DeBERTa", "LlamaGuard"
# End of fixed values.

#: Words that a text must hold for each pattern to match it, in the patterns'
#: order: all of them, one of those with a bar between.
HARD_WORDS = [
    "instruction ignore previous|prior|above",
    "instruction disregard previous|prior|above",
    "instruction forget previous|prior|above",
    "instruction override",
    "instruction new",
    "instruction updated",
    "now you are",
    "act as",
    "pretend",
    "persona|role|identity your new",
    "switch mode developer|admin|god|jailbreak",
    "mode developer|admin|god|jailbreak you",
    "dan mode",
    "reveal system prompt",
    "system print prompt",
    "show system|instruction your|the",
    "system|instruction what your",
    "repeat system|instruction",
    "[system]",
    "[inst]",
    "[agent]",
    "[override]",
    "[internal",
    "< system",
    "< instruction",
    "### system",
    "### instruction",
    "send data|content|document|context|history",
    "exfiltrate",
    "leak data|content|document",
    "transmit",
    "output first answer then",
    "answering|responding before",
    "answering|responding after",
    "jailbreak",
    "bypass safety|filter|restriction|guideline",
    "remove safety|filter|restriction|guideline",
    "without restriction|filter|limitation",
]
TAG_WORDS = ["[system", "[inst", "[agent", "< /system|system", "[internal"]
SUBTLE_WORDS = ["[ ai", "[ note", "( ai", "assistant :", "human :", "< assistant", "< human", "format response|answer all|your", "always respond|reply|answer", "from now on"]

HARD = [java(p, i) for p, i in HARD_PATTERNS]
TAGS = [java(p, True, True) for p in ROLE_TAGS]
SUBTLE = [java(p) for p in SUBTLE_PATTERNS]
VERDICT = "struct<is_injection:boolean,reason:string,confidence:double>"


def normalize(text: Column) -> Column:
    """Without zero-width characters, digits and signs that stand for letters as
    letters, runs of white space as one space, dots between letters dropped.

    A single space is a run that stays as it is, and no match."""
    plain = F.translate(text, LEET_FROM + "\u200b\u200c\u200d\u2060\ufeff", LEET_TO)
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*+| [\s\x1c-\x1f]++", " "), r"(?<=[a-zA-Z])\.(?=[a-zA-Z])", "")


def folded(text: Column) -> Column:
    """Lower case, and the four letters that equal an ASCII letter when case is ignored."""
    return F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))


def _may_match(low: Column, words: str) -> Column:
    """Whether a folded text holds the words without which a pattern can't match it."""
    out = F.lit(True)
    for part in words.split():
        one = F.lit(False)
        for w in part.split("|"):
            one = one | low.contains(w)
        out = out & one
    return out


def _found(text: Column, low: Column, patterns: list[str], words: list[str]) -> Column:
    """array<string>: each pattern's first match, '' for none.  Searching for a few
    words in turn is much cheaper than trying every pattern at every character."""
    return F.array(*[F.when(_may_match(low, w), F.regexp_extract(text, p, 0)).otherwise("") for p, w in zip(patterns, words)])


def hard_matches(text: Column) -> Column:
    """array<string>: the first match of each hard pattern, '' for none."""
    return bind(folded(text), lambda low: _found(text, low, HARD, HARD_WORDS))


def _any(found: Column) -> Column:
    return F.exists(found, lambda x: x != "")


def regex_flag(text: Column, normal: Column) -> Column:
    """Whether a hard pattern matches the text or its normal form."""
    return _any(hard_matches(text)) | _any(hard_matches(normal))


def _quoted(label: str, match: Column) -> Column:
    return F.when(match != "", F.concat(F.lit(label + ": '"), F.substring(match, 1, 50), F.lit("'")))


def regex_reason(text: Column, normal: Column, interleaved: bool = False) -> Column:
    """The first match, cut to 50 characters; null if there is none.

    All patterns on the text, then all on its normal form; ``interleaved``:
    pattern by pattern on both, as the layered verdict does."""
    on_text = F.transform(hard_matches(text), lambda m: _quoted(REASON_REGEX, m))
    on_normal = F.transform(hard_matches(normal), lambda m: _quoted(REASON_NORMAL, m))
    both = F.flatten(F.zip_with(on_text, on_normal, lambda a, b: F.array(a, b))) if interleaved else F.concat(on_text, on_normal)
    return F.get(F.filter(both, lambda r: r.isNotNull()), F.lit(0))


def synonym_reason(text: Column) -> Column:
    """Why the text combines synonyms of an attack; null if it does not."""
    pair = lambda a, b: F.concat(F.lit(REASON_SYNONYM + ": '"), a, F.lit("' + '"), b, F.lit("'"))

    def reason(lower: Column) -> Column:
        first = {k: first_of(v, lower.contains) for k, v in SYNONYMS.items()}
        asked = first["system prompt"].isNotNull() & first_of(EXTRACTION_VERBS, lower.contains).isNotNull()
        return F.coalesce(
            bind(first["ignore"], lambda i: F.when(i.isNotNull(), F.coalesce(pair(i, first["instructions"]), pair(i, first["previous"])))),
            F.when(asked, F.lit(REASON_EXTRACTION)),
        )

    return bind(F.lower(text), reason)


def subtle_hits(text: Column) -> Column:
    """Matches of the subtle patterns, one for each that matches."""
    return F.filter(bind(folded(text), lambda low: _found(text, low, SUBTLE, SUBTLE_WORDS)), lambda x: x != "")


def _verdict(flag, reason, confidence) -> Column:
    return F.struct(F.lit(flag).alias("is_injection"), reason.alias("reason"), F.lit(confidence).cast("double").alias("confidence"))


def _early(text: Column, normal: Column) -> Column:
    """Verdict of the layers before the models; null leaves it to them."""
    regex = bind(regex_reason(text, normal, interleaved=True), lambda r: F.when(r.isNotNull(), _verdict(True, r, 1.0)))
    synonym = bind(synonym_reason(text), lambda r: F.when(r.isNotNull(), _verdict(True, r, 0.85)))
    return F.when(text.isNull() | blank(text), _verdict(False, F.lit(""), 0.0)).otherwise(F.coalesce(regex, synonym))


def _late(text: Column) -> Column:
    """Verdict of the layer after the models."""

    def judge(hits: Column) -> Column:
        listed = F.concat(F.lit(REASON_SUBTLE + ": ['"), F.array_join(hits, "', '"), F.lit("']"))
        return (
            F.when(F.size(hits) >= 2, _verdict(True, listed, 0.7))
            .when(F.size(hits) == 1, _verdict(False, F.concat(F.lit(REASON_POSSIBLE + ": "), F.get(hits, F.lit(0))), 0.3))
            .otherwise(_verdict(False, F.lit(""), 0.0))
        )

    return bind(subtle_hits(text), judge)


def verdict(text: Column) -> Column:
    """VERDICT without models: patterns, synonyms, subtle patterns."""
    return bind(normalize(text), lambda normal: F.coalesce(_early(text, normal), _late(text)))


def model_input(normal: Column) -> Column:
    """What a classifier reads: head and tail of long texts."""
    return F.when(F.length(normal) > 1000, F.concat(F.left(normal, F.lit(500)), F.lit(" ... "), F.right(normal, F.lit(500)))).otherwise(normal)


def _by_classifier(said: Column, threshold: float) -> Column:
    label, score = said["label"], said["score"]
    return F.when((label == "INJECTION") & (score >= threshold), _verdict(True, F.format_string(REASON_MODEL + ": %s (%.3f)", label, score), 0.0).withField("confidence", score.cast("double")))


def _by_judge(said: Column) -> Column:
    return F.when(said.startswith("unsafe"), _verdict(True, F.concat(F.lit(REASON_JUDGE + ": "), F.substring(F.replace(said, F.lit("\n"), F.lit(" ")), 1, 80)), 0.9))


def _runs_python(df: DataFrame, model, text: Column) -> bool:
    """Whether a model's column has a Python function in it."""
    plan = df.select(model(text).alias("x"))._jdf.queryExecution().analyzed()
    found = plan.expressions().toList()
    return any(_has_python(found.apply(i)) for i in range(found.size()))


def _has_python(expression) -> bool:
    if "Python" in expression.getClass().getSimpleName():
        return True
    children = expression.children()
    return any(_has_python(children.apply(i)) for i in range(children.size()))


def _with_columns(text: Column, classifier, judge, threshold: float) -> Column:
    """VERDICT with models that are expressions: each layer is asked where those before are silent."""

    def layers(normal: Column) -> Column:
        found = [_early(text, normal)]
        if classifier is not None:
            found.append(bind(bind(model_input(normal), classifier), lambda ml: _by_classifier(ml, threshold)))
        if judge is not None:
            found.append(bind(F.lower(F.trim(judge(normal))), _by_judge))
        return F.coalesce(*found, _late(text))

    return bind(normalize(text), layers)


def verdicts(df: DataFrame, text: str, classifier=None, judge=None, threshold: float = 0.85) -> DataFrame:
    """``df`` with a column ``verdict``, with models as plug-ins.

    ``classifier``: pandas function of a text to struct<label, score>; ``judge``:
    pandas function of a text to a reply, "unsafe..." for attacks.  Null answers
    mean that a model is not there and are passed over.  A plan evaluates Python
    functions for every row they are given, so the rows that the cheap layers
    decide take another branch, and the two are united.  Models that are expressions
    of Spark's are evaluated where a row is open, so one pass does.
    """
    t = F.col(text)
    if classifier is None and judge is None:
        return df.withColumn("verdict", verdict(t))
    if not any(_runs_python(df, model, t) for model in (classifier, judge) if model is not None):
        return df.withColumn("verdict", _with_columns(t, classifier, judge, threshold))
    df = df.withColumn("__normal", normalize(t)).withColumn("__early", _early(t, F.col("__normal")))
    decided = df.filter(F.col("__early").isNotNull()).withColumn("verdict", F.col("__early"))
    open_ = df.filter(F.col("__early").isNull())
    found = F.lit(None).cast(VERDICT)
    if classifier is not None:
        open_ = open_.withColumn("__ml", classifier(model_input(F.col("__normal"))))
        found = _by_classifier(F.col("__ml"), threshold)
    open_ = open_.withColumn("verdict", found)
    if judge is not None:
        said = open_.filter(F.col("verdict").isNull()).withColumn("__said", F.lower(F.trim(judge(F.col("__normal")))))
        open_ = open_.filter(F.col("verdict").isNotNull()).unionByName(said.withColumn("verdict", _by_judge(F.col("__said"))).drop("__said"))
    open_ = open_.withColumn("verdict", F.coalesce("verdict", _late(t)))
    return decided.select(*df.columns, "verdict").unionByName(open_.select(*df.columns, "verdict")).drop("__normal", "__early")


def warm_up(spark, **models) -> dict[str, bool]:
    """Call each model (a pandas function of a text) once in every Python process that
    will run it: whether it answers in all of them.  The tasks, one for each core, start
    together, so that none takes another's place.  A model that fails is left to fail, or to
    be passed over, when it is used."""
    slots, out = spark.sparkContext.defaultParallelism, {}
    for name, model in models.items():
        rows = spark.range(0, slots, 1, slots).mapInArrow(lambda batches: batches, "id bigint", barrier=True)
        try:
            said = rows.select(model(F.concat(F.lit("hello "), F.col("id").cast("string"))).alias("x"))
            out[name] = said.agg(F.count("x")).first()[0] == slots
        except Exception:  # noqa: BLE001  a model that can't be loaded is no error at start
            out[name] = False
    return out


def sanitize(text: Column) -> Column:
    """struct<text, n>: every hard pattern, then every role tag, in one ordered
    pass, replaced; n counts all matches.

    Only patterns whose words the text holds are tried: what replaces a match
    stands in brackets and adds no such word.  They are tried on what the ones
    before left."""
    start = F.struct(text.alias("text"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        replaced = F.struct(F.regexp_replace(a["text"], p, F.lit(REDACTED)).alias("text"), (a["n"] + F.regexp_count(a["text"], p)).alias("n"))
        return F.when(F.rlike(a["text"], p), replaced).otherwise(a)

    def patterns(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_may_match(low, w), F.lit(p)) for p, w in zip(HARD + TAGS, HARD_WORDS + TAG_WORDS)]))

    return F.when(text.isNull(), start).otherwise(bind(bind(folded(text), patterns), lambda ps: F.aggregate(ps, start, step)))


def scan(df: DataFrame, text: str, use_models: bool = False, threshold: float = THRESHOLD, **models) -> DataFrame:
    """``df`` with injection_flagged, injection_reason, injection_confidence."""
    if use_models:
        v = verdicts(df, text, **models)
        flag = F.col("verdict.is_injection") & (F.col("verdict.confidence") >= threshold)
        out = v.withColumn("injection_flagged", flag)
        reason, confidence = F.col("verdict.reason"), F.col("verdict.confidence")
    else:
        t = F.coalesce(F.col(text), F.lit(""))
        out = df.withColumn("__reason", bind(normalize(t), lambda n: regex_reason(t, n)))
        out = out.withColumn("injection_flagged", F.col("__reason").isNotNull() & F.lit(threshold <= 1.0))
        reason, confidence = F.col("__reason"), F.lit(1.0)
    flagged = F.col("injection_flagged")
    return out.withColumns({"injection_reason": F.when(flagged, reason), "injection_confidence": F.when(flagged, confidence)}).drop("verdict", "__reason")


def fail_open(df: DataFrame, key: str) -> DataFrame:
    """Rows that are not flagged, or all rows of a key whose rows all are."""
    from pyspark.sql import Window

    safe = F.sum((~F.col("injection_flagged")).cast("int")).over(Window.partitionBy(key))
    return df.withColumn("__safe", safe).filter(~F.col("injection_flagged") | (F.col("__safe") == 0)).drop("__safe")


def query_validity(query: Column) -> Column:
    """struct<ok, reason> of a user's query, without models."""
    answer = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    attack = bind(verdict(query), lambda v: v["is_injection"] & (v["confidence"] >= THRESHOLD))
    return (
        F.when(query.isNull() | blank(query), answer(False, BLOCKED_EMPTY))
        .when(F.length(query) > MAX_QUERY, answer(False, BLOCKED_LONG))
        .when(attack, answer(False, BLOCKED_CONTENT))
        .otherwise(answer(True, ""))
    )
