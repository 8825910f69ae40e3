"""Personal data: patterns propose spans, boosted trees choose among them."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import bucket, documents, query, steady, version

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract, for an engine that backtracks: a run is only entered at
# its start (or behind the last match) and never given back, which finds the same matches in
# linear time and without recursion.
_RUN = r"(?:\G|(?<![0-9]))"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _RUN + r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# What may be personal data though the base patterns miss it, mostly as they run on into the
# number that follows. These overlap on purpose.
PROPOSE = (
    ("email", r"(?<![^\s@<>(),;:\"])[^\s@<>(),;:\"]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++"),
    ("ip", r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
_HINTS = {
    "email": r"(?i)\b(e-?mail|mail|write to|contact|courriel|correo)\b", "ip": r"(?i)\b(ip|server|host|address|addr)\b",
    "card": r"(?i)\b(card|visa|credit|karte|carte|tarjeta)\b", "phone": r"(?i)\b(phone|tel|call|mobile|fax|cell)\b",
}
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "n_groups", "last_group", "plus", "paren", "spaces",
    "sound", "letter_before", "digit_before", "mark_before", "letter_after", "digit_after", "hint",
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check digit."""
    def add(acc, k):
        d = F.substring(F.reverse(digits), k + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(k % 2 == 1, doubled).otherwise(d)

    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def sound(kind: str, s: Column) -> Column:
    """The check of a kind: parts of an address, number of digits, check digit."""
    digits = _digits(s)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running_sum(values: Column) -> Column:
    """Running sums of an array, by steps of doubling length."""
    def step(acc, reach):
        shifted = F.concat(F.array_repeat(F.lit(0).cast("bigint"), reach), F.slice(acc, F.lit(1), F.size(acc) - reach))
        return F.when(reach < F.size(acc), F.zip_with(acc, shifted, lambda a, b: a + b)).otherwise(acc)

    return F.aggregate(F.lit([1 << k for k in range(30)]), values, step)


def _matches(rows: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Add a column per (name, kind, pattern): all matches with start and end in code points,
    the match, up to 40 characters before it and one after it. The text between matches and
    the matches themselves give the places; nothing is searched twice."""
    there = lambda kind: F.col("text").contains("@") if kind == "email" else F.col("text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    keep = rows.columns
    cut = rows.select(
        "*",
        *(F.when(there(kind), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"__h_{n}") for n, kind, p in patterns),
        *(F.when(there(kind), F.split("text", p, -1)).otherwise(none).alias(f"__g_{n}") for n, kind, p in patterns),
    )
    def ends(n):
        steps = F.transform(f"__h_{n}", lambda s, k: (F.length(s) + F.length(F.get(f"__g_{n}", k))).cast("bigint"))
        return F.when(F.size(f"__h_{n}") > 0, _running_sum(steps)).otherwise(F.array().cast("array<bigint>"))

    placed = cut.select("*", *(ends(n).alias(f"__e_{n}") for n, _, _ in patterns))
    def found(n):
        end = lambda k: F.get(f"__e_{n}", k)
        return F.transform(f"__h_{n}", lambda s, k: F.struct(
            (end(k) - F.length(s)).alias("start"), end(k).alias("end"), s.alias("s"),
            F.right(F.get(f"__g_{n}", k), F.lit(40)).alias("before"), F.left(F.get(f"__g_{n}", k + 1), F.lit(1)).alias("after"),
        ))

    return placed.select(*keep, *(found(n).alias(n) for n, _, _ in patterns))


def base_spans(rows: DataFrame) -> DataFrame:
    """Add ``base``: the spans of the base patterns that pass their checks, by kind and start."""
    found = _matches(rows, [(f"b_{k}", k, BASE[k]) for k in KINDS])

    def passed(i, k):
        good = F.filter(f"b_{k}", lambda x: sound(k, x["s"]))
        return F.transform(good, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return found.select(*rows.columns, F.concat(*(passed(i, k) for i, k in enumerate(KINDS))).alias("base"))


def candidates(rows: DataFrame) -> DataFrame:
    """One row per proposed span of texts with their ``base`` spans: place, features, and
    what is known of it: 1 if it is a base span, 0 if it fails the check of its kind, else
    null. Spans that cut a base span of any kind are left out unless they are one."""
    found = _matches(rows.where(F.col("text").rlike("[0-9@]")), [(f"c_{i}", k, p) for i, (k, p) in enumerate(PROPOSE)])
    fields = ("start", "end", "s", "before", "after")

    def marked(i, k):
        return F.transform(f"c_{i}", lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), *(x[f].alias(f) for f in fields)))

    proposed = F.concat(*(marked(i, k) for i, (k, _) in enumerate(PROPOSE)))
    each = found.select("doc_id", "version", "base", F.explode(F.array_distinct(proposed)).alias("c")).select("doc_id", "version", "base", "c.*")
    is_base = F.exists("base", lambda b: (b["kind"] == F.col("kind")) & (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    cuts = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    kind = lambda k: F.col("kind") == KINDS.index(k)
    choose = lambda of: F.coalesce(*(F.when(kind(k), of(k)) for k in KINDS))
    number = lambda c: c.cast("double")
    s, last = F.col("s"), F.right("before", F.lit(1))
    described = each.select(
        "doc_id", "version", "kind", "start", "end", is_base.alias("is_base"), cuts.alias("cuts"),
        *(number(kind(k)).alias(f"is_{k}") for k in KINDS), number(F.length(_digits(s))).alias("n_digits"), number(F.length(s)).alias("n_chars"),
        number(F.size(F.split(s, "[^0-9]+"))).alias("n_groups"), number(F.length(F.regexp_extract(s, "([0-9]*)$", 1))).alias("last_group"),
        number(s.startswith("+")).alias("plus"), number(s.contains("(")).alias("paren"), number(s.contains(" ")).alias("spaces"),
        number(choose(lambda k: sound(k, s))).alias("sound"), number(last.rlike(r"\p{L}")).alias("letter_before"),
        number(last.rlike("[0-9]")).alias("digit_before"), number(last.rlike("[=\"'_/:#]")).alias("mark_before"),
        number(F.col("after").rlike(r"\p{L}")).alias("letter_after"), number(F.col("after").rlike("[0-9]")).alias("digit_after"),
        number(choose(lambda k: F.col("before").rlike(_HINTS[k]))).alias("hint"),
    )
    known = F.when(F.col("is_base"), 1.0).when(F.col("sound") == 0, 0.0)
    return described.where("is_base or not cuts").withColumn("label", known).drop("cuts")


def _twins(labelled: DataFrame) -> DataFrame:
    """Good spans made bad: once by a failed check, once by letters that touch them."""
    good = labelled.where("label = 1")
    failed = good.withColumns({"sound": F.lit(0.0), "label": F.lit(0.0)})
    inside = good.withColumns({"letter_before": F.lit(1.0), "letter_after": F.lit(1.0), "label": F.lit(0.0)})
    return labelled.unionByName(failed).unionByName(inside)


def _score(model, rows: DataFrame) -> DataFrame:
    whole = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return model.transform(whole).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def choose_spans(found: DataFrame, max_train: int = 5000, rounds: int = 8, depth: int = 3, precision: float = 0.95) -> DataFrame:
    """``doc_id, version, kind, start, end, p`` of proposed spans to add to the base ones.

    Trees are boosted on labelled spans of four fifths of the documents, in hash order, up to
    an equal share of ``max_train`` for each kind and label, and on their spoilt twins. On
    all labelled spans of the last fifth each kind gets the lowest threshold of a grid at
    which ``precision`` is reached; a kind that never reaches it adds nothing.
    """
    key = F.xxhash64(F.lit("pii"), "doc_id", "version", "kind", "start", "end")
    labelled = found.where("label is not null")
    fold = bucket(F.col("doc_id"), 5)
    share = max_train // (2 * len(KINDS))
    learn = labelled.where(fold != 0).withColumn("key", key)
    parts = [learn.where((F.col("kind") == kind) & (F.col("label") == label)).orderBy("key").limit(share).drop("key") for kind in range(len(KINDS)) for label in (0.0, 1.0)]
    train = steady(_twins(reduce(DataFrame.unionByName, parts)).select(*FEATURES, "label"))
    open_ = found.where("label is null and sound = 1")
    if train.select("label").distinct().count() < 2:
        return open_.where(F.lit(False)).select("doc_id", "version", "kind", "start", "end", F.lit(0.0).alias("p"))
    sized = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, labelCol="label").fit(sized)

    held = _score(model, _twins(labelled.where(fold == 0)))
    steps = held.select("kind", "label", F.explode(F.sequence(F.lit(1), F.floor(F.col("p") * 20).cast("int"))).alias("step")).where("step >= 10 and step < 20")
    grid = steps.groupBy("kind", "step").agg(F.avg("label").alias("right")).where(F.col("right") >= precision)
    least = {r["kind"]: r["step"] / 20 for r in grid.groupBy("kind").agg(F.min("step").alias("step")).collect()}
    passed = F.lit(False)
    for kind, threshold in least.items():
        passed = passed | ((F.col("kind") == kind) & (F.col("p") >= threshold))
    return _score(model, open_).where(passed).select("doc_id", "version", "kind", "start", "end", "p")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, version (a hash of the text), ``base`` and ``spans``, arrays of (kind, start, end) by kind and
    start. Kinds are numbered as in ``KINDS``; places count code points, ends exclusive.

    Base spans always stay. Added ones do not cut a base span; where added spans of a kind
    overlap, the likelier one stays, then the longer, then the first. Null counts as empty
    text and has no spans. Repeated rows come out as often as they come in, an empty table
    gives no rows, further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), version(text_col).alias("version"), text.alias("text"))
    based = base_spans(rows)
    found = steady(candidates(based).distinct())
    added = choose_spans(found, **options)
    listed = added.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(
        F.collect_list(F.struct("kind", "start", "end", "p")).alias("more"))
    rank = lambda x: F.struct(x["p"], x["end"] - x["start"], -x["start"])
    beaten = lambda x: F.exists("more", lambda y: (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (y["end"] > x["start"]) & (rank(y) > rank(x)))
    best = listed.select("d", "v", F.transform(F.filter("more", lambda x: ~beaten(x)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("more"))
    joined = based.drop("text").join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select("doc_id", "version", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text, spans``: texts with every span replaced by its kind in brackets. Of
    spans that overlap the first is replaced and the rest of the others with it. One row in is
    one row out: texts that share an id or have none are each redacted by their own spans.
    Null text stays null."""
    found = find_pii(docs, id_col, text_col, **options).dropDuplicates(["doc_id", "version"]).withColumnsRenamed({"doc_id": "d", "version": "v"})
    rows = docs.select(F.col(id_col).alias("doc_id"), version(text_col).alias("version"), F.col(text_col).alias("text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    ordered = joined.withColumn("o", F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    names = F.array(*map(F.lit, KINDS))
    upto = lambda k: F.aggregate(F.slice("o", F.lit(1), k), F.lit(0).cast("bigint"), lambda acc, x: F.greatest(acc, x["end"]))
    piece = F.transform("o", lambda x, k: F.concat(
        F.substring(F.col("text"), (upto(k) + 1).cast("int"), F.greatest(x["start"] - upto(k), F.lit(0)).cast("int")),
        F.when(x["start"] >= upto(k), F.concat(F.lit("["), F.get(names, x["kind"]), F.lit("]"))).otherwise("")))
    tail = F.substring(F.col("text"), (upto(F.size("o")) + 1).cast("int"), F.length("text"))
    return ordered.select("doc_id", F.when(F.size("o") == 0, F.col("text")).otherwise(F.concat(F.array_join(piece, ""), tail)).alias("text"), "spans")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
