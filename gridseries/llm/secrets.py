"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything runs as DataFrame expressions. The forest is trained by Spark's own
learner on a bounded sample of labelled findings and then written out as nested
conditional expressions, which score all findings in one projection.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, smallest_hashes, stage

#: A candidate: a key of an issuer's format, a run of key characters that holds a digit, or what is assigned to a secret's name.
RUN = r"[A-Za-z0-9+/_-]"
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
DIGIT_RUN = rf"(?=[A-Za-z+/_-]*+[0-9]){RUN}{{12,}}+"
FORMATS = (
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"
    rf"|(?:xox[abp]-|sk_live_){RUN}++"
)
CANDIDATE = rf"(?<![A-Za-z0-9])(?:{FORMATS})|(?<!{RUN}){DIGIT_RUN}"
#: An identifier with a secret's name in it, and the signs between it and its value. An identifier is searched from its start alone.
NAMED = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*(?i:{NAMES}))[A-Za-z0-9_-]++[\"'`\])]*+"
SIGNS = r"[=:]++>?"
#: The value: any characters up to a quote or white space, without the marks after a key or run that would be a candidate by itself.
VALUE = rf"(?:(?:{FORMATS}|{DIGIT_RUN})(?=[^A-Za-z0-9+/_\"'`-]*+(?:[\"'`]|$))|[^\"'`\x20\x09-\x0D]++)"
ASSIGNED = rf"{NAMED} ?{SIGNS} ?[\"'`]?"
#: What the words before may end in when a value follows.
OPEN_NAME = rf"{NAMED}(?: ?{SIGNS}[\"'`]?)?$"
SPACE = r"[\x20\x09-\x0D]+"

#: Fixed word list of the dictionary feature: words of placeholders, test data and identifiers.
DICTIONARY = (
    "account access admin api auth base cache change client code config count data date default demo dummy example fake file foo "
    "hash host http image index key list local mail main map name number object page pass path phone place post sample secret "
    "server service session size sort source state string system table test text time title token type update user value version word your"
).split()
TEST_PATH = r"(?i)test|example|sample|fixture|mock|demo|docs?/"

#: Labels of findings. Positive: key formats of issuers, and random-looking values of secret names.
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abp]-|^sk_live_|^AIza[A-Za-z0-9_-]{35}$"
RANDOM = r"^(?=.*[0-9])(?:[0-9a-f]{16,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,})$"
#: Negative: numbers of cards, phones and dates, words with numbers (unless assigned to a secret's name), repeated characters, placeholders.
PLAIN = r"^[0-9-]+$|^[A-Za-z]+[0-9]{0,4}$"
HARMLESS = r"(.)\1{5,}|(?i:example|x{4,}|changeme)"

#: Labelled findings that train the forest, those of smallest hash of each label, half as many of each at most; its size.
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 20, 5, 7
KEEP = 0.5


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, word_no, part_no, candidate, lead (what is before it), before, after: one row per candidate.

    Texts without a candidate or a name with a sign after it are dropped by one
    search; the others are split into words, and words that may hold a candidate
    keep their neighbours. A word's runs come first, then the values assigned in it
    or by the words before it, unless they are runs already.
    """
    named_text = F.col("text").rlike(rf"{NAMED}[\x20\x09-\x0D]*+[=:]")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(path).cast("string").alias("path"), clean_text().alias("text")).where(F.col("text").rlike(CANDIDATE) | named_text)
    words = texts.select("doc_id", "path", F.split("text", SPACE).alias("words"))
    near = lambda i: F.coalesce(F.try_element_at(F.col("words"), i), F.lit(""))
    previous = lambda i: F.when(i > 0, near(F.greatest(i, F.lit(1)))).otherwise("")
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CANDIDATE) | w.rlike("[=:]") | previous(i).rlike("[=:]"), i)), lambda i: i.isNotNull())
    at = words.withColumn("word_no", F.explode(hits))
    word = F.element_at("words", F.col("word_no") + 1)
    rows = at.select(
        "doc_id", "path", "word_no", word.alias("word"),
        F.concat_ws(" ", F.when(F.col("word_no") > 1, near(F.col("word_no") - 1)), F.when(F.col("word_no") > 0, near(F.greatest(F.col("word_no"), F.lit(1))))).alias("before"),
        near(F.col("word_no") + 2).alias("after"),
    )
    all_of = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    runs = F.transform(all_of(F.col("word"), CANDIDATE), lambda c: F.struct(c.alias("candidate"), F.call_function("substring_index", F.col("word"), c, F.lit(1)).alias("lead")))
    open_name = F.regexp_extract("before", OPEN_NAME, 0)
    whole = F.when(open_name != "", F.concat(open_name, F.lit(" "), F.col("word"))).otherwise(F.col("word"))
    values = F.transform(
        all_of(whole, ASSIGNED + VALUE),
        lambda m: F.struct(F.regexp_replace(m, F.lit(f"^{ASSIGNED}"), F.lit("")).alias("candidate"), F.regexp_extract(m, f"^{ASSIGNED}", 0).alias("lead")),
    )
    sought = rows.select("*", runs.alias("runs"), values.alias("values"))
    fresh = F.filter("values", lambda v: ~F.exists("runs", lambda r: r["candidate"] == v["candidate"]))
    parts = sought.select("*", F.posexplode(F.concat("runs", fresh)).alias("part_no", "part"))
    return parts.select("doc_id", "path", "word_no", "part_no", "part.candidate", "part.lead", "before", "after")


def features() -> dict[str, Column]:
    """Numeric columns of a finding."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    words = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    near = F.concat_ws(" ", "before", "lead")
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "to_digit": share("(?<=[A-Za-z])(?=[0-9])"), "from_digit": share("(?<=[0-9])(?=[A-Za-z])"), "case_turns": share("(?<=[a-z])(?=[A-Z])"),
        "vowel_turns": share("(?i)[aeiou][bcdfghjklmnpqrstvwxyz]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": 1 - F.length(words) / n,
        "test_path": F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double"),
        "named": near.rlike(rf"(?i)(?:{NAMES})").cast("double"), "assigned": near.rlike("[=:]").cast("double"), "quoted": F.col("lead").rlike("[\"']$").cast("double"),
        "mail_after": F.coalesce(F.col("after").rlike("@"), F.lit(False)).cast("double"),
    }


def labelled(found: DataFrame) -> DataFrame:
    """Adds label: 1 for formats of issuers and random values of secret names, 0 for harmless shapes, else null."""
    near = F.concat_ws(" ", "before", "lead")
    named, assigned = near.rlike(rf"(?i)(?:{NAMES})"), near.rlike(f"{ASSIGNED}$")
    c = F.col("candidate")
    label = F.when(c.rlike(ISSUED), 1.0).when(c.rlike(HARMLESS) | (c.rlike(PLAIN) & ~assigned), 0.0).when(named & c.rlike(RANDOM), 1.0).when(~named & ~c.rlike(RANDOM), 0.0)
    return found.withColumn("label", label)


def training_sample(known: DataFrame, names: list[str], rows: int = TRAIN_ROWS) -> DataFrame:
    """label and features of the ``rows // 2`` findings of smallest hash of each label, so that a rare label isn't crowded out."""
    keys = ["doc_id", "word_no", "part_no", "candidate"]
    of_label = lambda label: smallest_hashes(known.where(F.col("label") == label).select(*keys, "label", *names), rows // 2, keys)
    return of_label(1.0).unionByName(of_label(0.0)).select("label", *names)


def train_forest(known: DataFrame, names: list[str], rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """Forest from findings with a label and features; both labels weigh the same. None unless both occur."""
    sample = stage(training_sample(known, names, rows), "secret-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    most = max(counts.values())
    weighted = sample.withColumn("weight", F.when(F.col("label") == 1.0, most / counts[1.0]).otherwise(most / counts[0.0]))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(weighted)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", weightCol="weight").fit(vectors)


def forest_score(model: RandomForestClassificationModel | None, columns: dict[str, Column]) -> Column:
    """Share of the trees that vote for a secret, as one expression; without a model the label, and 0 for a finding that has none."""
    if model is None:
        return F.coalesce(F.col("label"), F.lit(0.0))
    values = list(columns.values())

    def tree(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, sign, limit = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line).groups()
        low = tree(lines)
        lines.pop(0)  # Else
        high = tree(lines)
        test = values[int(feature)] <= float(limit)
        return F.when(test, low).otherwise(high) if sign == "<=" else F.when(test, high).otherwise(low)

    votes = [tree(t.toDebugString.strip().split("\n")[1:]) for t in model.trees]
    total = votes[0]
    for vote in votes[1:]:
        total = total + vote
    return total / len(votes)


def scan_secrets(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, word_no, part_no, length, candidate_sha256, label, score, is_secret: one row per candidate of every whole text.

    Needs doc_id, text and the column ``path``; other columns are ignored. A null
    or empty text has no candidates, a null path is no test path. Rows repeated
    with their id repeat their findings; an empty table gives an empty result.
    Without findings of both labels there is no forest and the label decides. Secrets appear as digests only.
    """
    columns = features()
    found = labelled(findings(docs, path)).withColumns(columns)
    found = stage(found.select("doc_id", "word_no", "part_no", "candidate", "label", *columns), "secret-findings")
    model = train_forest(found, list(columns))
    score = forest_score(model, {k: F.col(k) for k in columns})
    scored = found.withColumn("score", score)
    return scored.select("doc_id", "word_no", "part_no", F.col("length").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "label", "score", (F.col("score") >= KEEP).alias("is_secret"))
