"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything on the path is a DataFrame or SQL function of Spark, or Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import ordinary
from skyloom.storage import stage

#: Labelled findings that the forest is fitted on, at most; chosen by hash.
MAX_FINDINGS = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
#: A run of at least 12 characters of keys, paths or mail addresses, with a digit in it.
RUN = r"(?<![A-Za-z0-9_+/.@:%-])(?=[A-Za-z_+/.@:%-]*+[0-9])[A-Za-z0-9_+/.@:%-]{12,}=*"
#: Characters of context to each side.
CONTEXT = 40

# Words that make up readable identifiers, and words beside secrets and beside others.
DICTIONARY = (
    "about access account admin agent alpha api app article asset auth backup base beta blog book build cache "
    "check class client cloud code com config content copy count data date default demo dev doc email error event "
    "example feature field file first font form group hash home host html http image import index info input item "
    "json key lang last lib license line link list live local log login mail main master media menu meta model "
    "module name net news node note number object old org output page password path photo post private prod "
    "product public query release report request reset result root sample script search secret secure server "
    "service session site source src staging start stat status store string style system table tag temp test text "
    "thumb time title token tool type update upload url user util value version video view web www year"
).split()
SECRET_WORDS = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
#: A name with one of these words in it, and the sign that gives it a value.
NAME = (
    r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{0,64}?" + SECRET_WORDS.replace("(?i)(", "(?i:").replace("(word|wd)", "(?:word|wd)")
    + r"(?:s|[0-9]{1,4}|[_.-][A-Za-z0-9_.-]{0,64}|[A-Z][A-Za-z0-9_]{0,64})?[\"'`]?\]?[ \t]{0,8}[:=][=>]?[ \t]{0,8}"
)
#: The value: what stands in quotes, or else up to white space or a quote, whatever its length,
#: digits and symbols. A closing bracket, comma or full stop before white space isn't part of
#: it, nor is the next name and value of a list.
VALUE = (
    r"(?:\"(?:[^\"\\\n]++|\\.)++(?=\")|'(?:[^'\\\n]++|\\.)++(?=')|`[^`\n]++(?=`)"
    r"|[\"'`]?(?:[^\s\"'`,;.)\]}>&]++|&(?![A-Za-z0-9_.-]{1,64}=)|[,;.)\]}>]++(?![\s\"'`]|\z|[A-Za-z0-9_. -]{1,64}=|[A-Za-z0-9_.-]{1,64}:))++)"
)
ASSIGNED = NAME + VALUE
CANDIDATE = ASSIGNED + "|" + RUN
OTHER_WORDS = r"(?i)(commit|sha(1|256)?|md5|checksum|digest|uuid|version|build|order|isbn|phone|tel|ticket|revision|etag)"

FEATURES = (
    "chars", "digits", "uppers", "lowers", "others", "transitions", "kinds", "hex", "coverage", "vowels",
    "mail", "slashes", "dots", "secret_word", "other_word", "assigned", "quoted", "starts_line",
    "closed",
)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, source, row, candidate, left_words, right_words: a row for each occurrence, with the
    context of its place; ``row`` tells apart rows of ``documents`` with one id. What a secret's name
    is given is a candidate whatever it looks like, and so is every run of the form of keys.

    The context is taken from the pieces between the matches and from the matches beside it."""
    found = documents.select(
        "doc_id", "source", F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("between"),
    ).filter(F.size("found") > 0)
    piece = lambda name, i: F.coalesce(F.get(name, i), F.lit(""))
    before = lambda text: F.right(text, F.lit(CONTEXT))
    after = lambda text: F.left(text, F.lit(CONTEXT))
    # The text is left behind before the candidates become rows.
    each = F.transform(
        "found",
        lambda c, i: F.struct(
            c.alias("match"),
            before(F.concat(before(piece("between", i - 1)), before(piece("found", i - 1)), before(piece("between", i)))).alias("ahead"),
            after(F.concat(after(piece("between", i + 1)), after(piece("found", i + 1)), after(piece("between", i + 2)))).alias("right_words"),
        ),
    )
    rows = found.select("doc_id", "source", "row", F.inline(each))
    sign = F.regexp_extract(F.concat("match", F.left("right_words", F.lit(1))), "^" + NAME + "(?=" + VALUE + ")[\"'`]?", 0)
    rows = rows.withColumn("sign", sign)
    return rows.select(
        "doc_id", "source", "row", F.substring("match", F.length("sign") + 1, F.length("match")).alias("candidate"),
        before(F.concat("ahead", "sign")).alias("left_words"), "right_words",
    )


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def features(found: DataFrame) -> DataFrame:
    """The candidates with the columns of FEATURES: length, character classes and transitions,
    dictionary coverage, signs of a path and neighbouring words on both sides."""
    classes = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"),
        "[^0Aa]", "-",
    )
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    readable = F.regexp_replace(F.lower("candidate"), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    has = lambda c, pattern: flag(F.col(c).rlike(pattern))
    values = {
        "chars": F.length("candidate").cast("double"),
        "digits": _share("[^0-9]"),
        "uppers": _share("[^A-Z]"),
        "lowers": _share("[^a-z]"),
        "others": _share("[A-Za-z0-9]"),
        "transitions": (runs - 1) / F.length("candidate"),
        "kinds": F.size(F.array_distinct(F.split(F.regexp_replace(classes, r"(.)\1+", "$1"), ""))).cast("double"),
        "hex": has("candidate", "^[0-9a-fA-F]+$"),
        "coverage": 1 - F.length(readable) / F.length("candidate"),
        "vowels": _share("[^aeiouAEIOU]"),
        "mail": has("candidate", "@"),
        "slashes": _share("[^/]"),
        "dots": _share("[^.]"),
        "secret_word": has("left_words", SECRET_WORDS + r"[^\n]{0,12}$"),
        "other_word": has("left_words", OTHER_WORDS + r"[^\n]{0,12}$"),
        "assigned": has("left_words", r"[=:]\s*[\"']?$"),
        "quoted": has("left_words", r"[\"']$"),
        "starts_line": has("left_words", r"(^|\n)$"),
        "closed": has("right_words", r"^[\"'`]"),
    }
    return found.select("*", *[values[f].alias(f) for f in FEATURES])


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings made from the candidates by rules of form: 1 for the fixed format of a
    provider's key or a random value, or letters and digits, given to a secret's name; 0 for
    mail addresses, hosts, numbers, dates, paths of words and what stands for a value. Others stay without a label and aren't learned from."""
    c = F.col("candidate")
    positive = c.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$") | c.rlike(r"^gh[pousr]_[0-9A-Za-z]{36}$") | (
        c.rlike(r"^[0-9A-Za-z+/_-]{16,}=*$") & F.col("left_words").rlike(SECRET_WORDS + r"\s*[=:]\s*[\"']?$")
    ) | (c.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[^\s<>(){}$%]{6,}$") & F.col("left_words").rlike(NAME + r"[\"'`]?$"))
    negative = (
        c.rlike(r"^[^@]+@[A-Za-z0-9.-]+$") | c.rlike(r"^[0-9.:/+-]+$") | c.rlike(r"^[a-z]+([./_-][a-z0-9]{1,8})+$")
        | c.rlike(r"(?i)^(null|none|nil|true|false|yes|no|string|str|required|optional|undefined)$|^([<({%]|\$[{(])")
        | c.rlike(r"(?i)^(https?:|www\.)") | F.col("left_words").rlike(OTHER_WORDS + r"\s*[=:#]?\s*$")
    )
    return found.withColumn("label", F.when(positive, 1.0).when(negative, 0.0)).filter("label is not null")


def seed_findings(found: DataFrame) -> DataFrame:
    """A few labelled findings of either kind, so that a forest can be fitted to any corpus."""
    rows = [
        ("AKIA" + "Q3ZX7MPL2WVB9TKE", "key ", 1.0),
        ("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", 'token = "', 1.0),
        ("5e884898da28047151", "password=", 1.0),
        ("hG7kLq2ZxP0vBnM4wE8rT1yU", "secret: ", 1.0),
        ("first.last7@mail3.example.com", "write to ", 0.0),
        ("images/photo1/title2.html", "see ", 0.0),
        ("2024-03-01T10:22:33", "on ", 0.0),
        ("release-notes-version-2", "the ", 0.0),
        ("2fd4e1c67a2d28fced849ee1bb76e7391b93eb12", "commit ", 0.0),
        ("hunter7", "password=", 1.0),
        ("S0mmer&3", "pwd: ", 1.0),
        ("bluehorsemountainpaper", "secret = ", 1.0),
        ("null", "password: ", 0.0),
        ("${TOKEN}", "token=", 0.0),
    ]
    spark = found.sparkSession
    return spark.createDataFrame(rows, "candidate string, left_words string, label double").withColumn("right_words", F.lit(""))


def fit(findings: DataFrame, max_findings: int = MAX_FINDINGS, seed: int = 7):
    """A forest on at most ``max_findings`` labelled findings (candidate, left_words, label; and
    right_words, if they have it)."""
    columns = ("candidate", "left_words", "right_words", "label")
    if "right_words" not in findings.columns:
        findings = findings.withColumn("right_words", F.lit(""))
    order = (F.xxhash64("candidate", "left_words"), F.xxhash64("right_words", "label"))
    chosen = findings.select(*columns).distinct().orderBy(*order).limit(max_findings)
    learned = stage(features(chosen.unionByName(seed_findings(findings).select(*columns))).coalesce(1), "findings")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=32
    )
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learned))


def scan(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, candidate, occurrences, probability, is_secret: a row for each distinct candidate
    of each row of ``documents`` (doc_id, source, text). Each occurrence is judged in its own
    context; the candidate has the highest probability of them.

    ``findings`` (candidate, left_words, label 0 or 1, and right_words if known) are what the forest learns from; without
    them the candidates that rules of form can label. Null and empty texts have no candidates.
    Repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    found = stage(candidates(ordinary(documents, ("doc_id", "source", "text"))), "candidates")
    model = fit(weak_labels(found) if findings is None else findings)
    judged = model.transform(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found))
    )
    probability = vector_to_array("probability")[1]
    return (
        judged.select("row", "doc_id", "candidate", probability.alias("p"))
        .groupBy("row", "doc_id", "candidate")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.max("p").alias("p"))
        .select("doc_id", "candidate", "occurrences", F.round("p", 6).alias("probability"), (F.col("p") >= THRESHOLD).alias("is_secret"))
    )
