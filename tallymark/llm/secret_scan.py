"""Secret scans: long tokens and what is assigned to a credential are candidates, a random forest removes the false findings.

Candidates and their features (length, kinds of characters and transitions between them, entropy, how much of them dictionary
words cover, path and neighbouring words) are SQL functions over a document's words; the forest is Spark's own, trained from
labelled findings. Findings carry a digest of the value, never the value.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import stage

#: Characters that a candidate consists of, and how many of them at least.
VALUE = "[A-Za-z0-9+/_=-]{16,}"
CREDENTIAL = "key|token|secret|passw|pwd|credential|auth|bearer|private"
DIGEST = "sha|md5|hash|checksum|digest|commit|revision|uuid|guid|etag"
TEST_PATH = "test|example|sample|mock|fixture|doc|demo"
#: A credential's name and what assigns a value to it, then the value: in quotes all up to the closing one, else up to white space.
ASSIGNMENT = (
    "((?i:key|token|secret|pass(?:w(?:or)?d|phrase|code)?|pwd|credential|auth(?:orization)?|bearer|private)s?(?:[_-][A-Za-z0-9_-]*+|[A-Z0-9][A-Za-z0-9_]*+)?"
    "[\"'`]?\\]?\\s*+(?::=|=>|=++|:)\\s*+)(?:" + "|".join(f"({q})(?!{q})([^{q}\\\\\r\n]*+(?:\\\\.[^{q}\\\\\r\n]*+)*+)(?={q})" for q in "\"'`")
    + "|([\"'`]?)([^\\s\"'`]\\S*?)(?=[,;)\\]}.\"'`]*+(?:\\s|$)))"
)
#: Set around values while a text is cut at them.
FROM, TO = "\ue000\ue0f7\ue001", "\ue001\ue0f7\ue000"
#: Everyday words and placeholders; parts of a candidate that they cover speak against it.
DICTIONARY = (
    "about after again all also and any are back because been before between both but can change check class code company content "
    "could count data date day default description different does down each edit email end example file find first for from "
    "function get good group have here home house image index information just know last left line link list long look make "
    "many message more most name need new number object one only other our over page part path people place point "
    "public read return right sample same search see server service set should show site some state still string system table take "
    "test text than that the their them then there these they thing think this time title two type update use user value very "
    "view want was water way well what when where which while will with word work world would year your dummy changeme placeholder xxxx"
).split()
TREES, DEPTH, ACCEPT = 24, 6, 0.5

FEATURES = (
    "chars", "digits", "uppers", "lowers", "marks", "distinct", "runs", "transitions", "vowel_steps", "entropy", "hex", "dictionary",
    "credential_near", "digest_near", "assigned", "quoted", "test_path", "path_chars",
)


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def candidates(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc, word (its place among the text's words), part (its place in the word), value, before, after,
    prefix (what stands before it in its word), suffix, path.

    ``before`` holds the two words before its word, ``after`` the one after it; null and empty texts have no candidates, a null
    path is empty. A long token has a digit, or upper and lower case letters; values that are assigned to a credential are
    candidates whatever their length and characters. ``part`` of those that are no long tokens counts down from -1.
    """
    return _long_tokens(docs, doc, text, path).unionByName(_assigned_values(docs, doc, text, path))


def _tokens(word: Column) -> tuple[Column, Column]:
    """The word with a gap before the value of name=value, and its runs of value characters."""
    # A name and its value may stand in one word: of name=value only the value is a candidate.
    opened = F.regexp_replace(word, r"([A-Za-z_]{2,32})=(?=[A-Za-z0-9+/_-]{16,})", "$1= ")
    return opened, F.regexp_extract_all(opened, F.lit(f"({VALUE})"), F.lit(1))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") | (value.rlike("[a-z]") & value.rlike("[A-Z]"))


def _assigned_values(docs: DataFrame, doc: str, text: str, path: str) -> DataFrame:
    """Values assigned to a credential's name, without those that are long tokens."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), whole.alias("text"))
    marked = F.regexp_replace("text", ASSIGNMENT, f"$1$2$4$6$8{FROM}$3$5$7$9{TO}")
    pieces = rows.where(F.col("text").rlike(ASSIGNMENT)).select("doc", "path", F.split(marked, FROM, -1).alias("pieces"))
    plain = lambda first, count: F.replace(F.array_join(F.slice("pieces", first, count), ""), F.lit(TO), F.lit(""))
    spaces = F.transform("pieces", lambda p: F.size(F.split(F.replace(p, F.lit(TO), F.lit("")), r"\s+", -1)) - 1)
    each = pieces.withColumn("spaces", spaces).select("*", F.posexplode("pieces").alias("at", "piece")).where("at > 0")
    cut = F.instr("piece", TO)
    found = each.where(cut > 0).select(
        "doc", "path", (-F.col("at")).alias("part"), F.substr("piece", F.lit(1), cut - 1).alias("value"),
        F.aggregate(F.slice("spaces", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b).alias("word"),
        F.split(plain(F.greatest(F.lit(1), F.col("at") - 3), F.least(F.col("at"), F.lit(4))), r"\s+", -1).alias("left"),
        F.split(F.concat(F.substr("piece", cut + len(TO), F.length("piece")), plain(F.col("at") + 2, F.lit(3))), r"\s+", -1).alias("right"),
    )
    last = F.size("left") - 1
    placed = found.select(
        "doc", "word", "part", "value", F.concat_ws(" ", F.get("left", last - 2), F.get("left", last - 1)).alias("before"),
        F.coalesce(F.get("right", F.lit(1)), F.lit("")).alias("after"), F.get("left", last).alias("prefix"), F.get("right", F.lit(0)).alias("suffix"), "path",
    )
    known = F.array_contains(_tokens(F.concat("prefix", "value", "suffix"))[1], F.col("value")) & _mixed(F.col("value"))
    return placed.where(~known)


def _long_tokens(docs: DataFrame, doc: str, text: str, path: str) -> DataFrame:
    """Runs of value characters with a digit, or with letters of both cases."""
    rows = docs.select(
        F.col(doc).alias("doc"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+", -1).alias("words"),
    )
    marked = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    long = F.filter(marked, lambda w: (F.length(w["word"]) >= 16) & w["word"].rlike(VALUE))
    found = rows.select("doc", "path", "words", F.explode(long).alias("hit")).select(
        "doc", "path", F.col("hit.at").alias("word"), F.col("hit.word").alias("whole"),
        F.concat_ws(" ", F.get("words", F.col("hit.at") - 2), F.get("words", F.col("hit.at") - 1)).alias("before"),
        F.coalesce(F.get("words", F.col("hit.at") + 1), F.lit("")).alias("after"),
    )
    opened, parts = _tokens(F.col("whole"))
    each = found.withColumn("opened", opened).select("*", F.posexplode(parts).alias("part", "value"))
    start = F.instr(F.col("opened"), F.col("value"))
    return each.where(_mixed(F.col("value"))).select(
        "doc", "word", "part", "value", "before", "after", F.substr("opened", F.lit(1), start - 1).alias("prefix"),
        F.substr("opened", start + F.length("value"), F.length("opened")).alias("suffix"), "path",
    )


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES as doubles; every one is a function of the finding alone."""
    value = F.col("value")
    low = F.lower(value)
    size = F.length(value)
    letters = F.array_distinct(F.split(value, ""))
    share = lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size
    near = F.lower(F.concat_ws(" ", "before", "prefix"))
    kinds = "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"
    columns = {
        "chars": size, "digits": _share(value, "[0-9]"), "uppers": _share(value, "[A-Z]"), "lowers": _share(value, "[a-z]"),
        "marks": _share(value, "[^0-9A-Za-z]"), "distinct": F.size(F.filter(letters, lambda c: c != "")) / size,
        "runs": F.size(F.regexp_extract_all(value, F.lit(f"({kinds})"), F.lit(1))) / size,
        "transitions": F.size(F.regexp_extract_all(low, F.lit("([a-z](?=[0-9])|[0-9](?=[a-z]))"), F.lit(1))) / size,
        "vowel_steps": F.size(F.regexp_extract_all(low, F.lit("([aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou]))"), F.lit(1))) / size,
        "entropy": F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))),
        "hex": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "dictionary": _share(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))),
        "credential_near": near.rlike(CREDENTIAL).cast("double"), "digest_near": near.rlike(DIGEST).cast("double"),
        "assigned": F.concat_ws(" ", "before", "prefix").rlike("[=:][\\s\"']*$").cast("double"),
        "quoted": F.col("prefix").rlike("[\"'`]$").cast("double"),
        "test_path": F.lower("path").rlike(TEST_PATH).cast("double"), "path_chars": F.length("path"),
    }
    return found.withColumns({name: F.coalesce(column.cast("double"), F.lit(0.0)) for name, column in columns.items()})


def certain_findings(found: DataFrame) -> DataFrame:
    """Findings (with FEATURES) whose label follows from their form: ``label`` 1 or 0; all others are left out.

    Certain secrets: values given to a name that says so, or with a vendor's prefix. Certain others: numbers, digests that are
    called digests, values that are part of an address, words joined by marks, values of one repeated character or
    covered by dictionary words for two fifths.
    """
    value = F.col("value")
    named = F.lower(F.concat_ws(" ", "before", "prefix")).rlike(f"({CREDENTIAL})[a-z_]*[\"']?\\s*[=: ][\\s\"']*$")
    vendor = value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | value.rlike("^(gh[pousr]_|sk_live_|xox[abp]-|glpat-)")
    other = (
        value.rlike("^[0-9+/_=-]+$") | F.lower(F.concat_ws(" ", "before", "prefix")).rlike(DIGEST)
        | F.col("suffix").rlike("^@|^[.]?[a-z0-9]*@") | F.col("prefix").rlike("@|://") | value.rlike("^(.)\\1+$")
        | value.rlike("^[A-Za-z]+([-_/][A-Za-z]+)+$") | value.rlike("^[A-Z]?[a-z]+$") | (F.col("dictionary") >= 0.4)
    )
    return found.withColumn("label", F.when(other, F.lit(0.0)).when(named | vendor, F.lit(1.0))).where("label is not null")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel | None:
    """A forest from findings with FEATURES and ``label``; None where not both labels occur."""
    if labelled.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=17)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(labelled.select(*FEATURES, "label"))


def judge(found: DataFrame, forest: PipelineModel | None, accept: float = ACCEPT) -> DataFrame:
    """Findings (with FEATURES) with ``probability`` and ``secret``; without a forest what stands near decides."""
    if forest is None:
        rated = found.withColumn("probability_of", F.col("credential_near"))
    else:
        rated = forest.transform(found).withColumn("probability_of", vector_to_array("probability")[1])
    return rated.select(
        "doc", "word", "part", F.length("value").cast("long").alias("chars"), F.sha2("value", 256).alias("value_sha256"),
        F.col("probability_of").alias("probability"), (F.col("probability_of") >= accept).alias("secret"),
    )


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, doc: str = "doc_id", text: str = "text", path: str = "source", accept: float = ACCEPT,
) -> DataFrame:
    """doc, word, part, chars, value_sha256, probability, secret: one row per candidate of every whole text.

    ``labelled`` are findings as ``candidates`` gives them with a ``label``; without it the scan is trained on its own certain
    findings. Rows that share an id, and repeated rows, are scanned one by one.
    """
    found = stage(with_features(candidates(docs, doc, text, path)), "candidates")
    known = certain_findings(found) if labelled is None else with_features(labelled)
    return judge(found, train(known), accept).withColumnRenamed("doc", doc)
