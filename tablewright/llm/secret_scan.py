"""Secret scans: candidates by pattern, false positives removed by a random forest on their shape and surroundings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.statistics import let, words
from tablewright.llm.tables import checked_broadcast, key_of, stored

#: A candidate is every run of at least this many of these characters in a word; a sign of equality behind it that assigns belongs to no run.
TOKEN = r"[A-Za-z0-9+/_\-]{12,}+(?:==?(?!=*[\"'`]?[A-Za-z0-9+/_\-]))?"
#: What parts the fields of a word, such as those of JSON, query strings and CSV.
PARTS = ",;&?|{}[]"
PART = r"[,;&?|{}\[\]]"
#: Formats that name their issuer, and assignments to a name that says secret: findings labelled 1 for training.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|eyJ)[A-Za-z0-9_\-+/]{12,}$"
NAMED = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential)"
#: Neighbours and shapes of what is no secret: findings labelled 0 for training.
HARMLESS = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|sha-?1|sha-?256|md5|checksum|digest|commit|uuid|isbn|card|order|phone|http|www\.)"
PLAIN = r"^([0-9+/_\-]+|[A-Za-z\-_/]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"

#: The forest; most labelled findings that it is grown on (of more, an even share by hash); the score from which a finding is kept.
TREES, DEPTH, MOST_ROWS, THRESHOLD = 24, 6, 200_000, 0.5
#: Documents in which a word must stand to count as one of the dictionary.
LEAST_DOCUMENTS = 3

FEATURES = ("length", "transitions", "distinct", "digits", "uppers", "vowels", "hex_only", "covered", "assigned", "quoted", "named_near", "harmless_near", "path_depth", "path_rate")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, source, word_at, token, ahead, behind, before_sha256, named_before, assigned_before, harmless_around``: every candidate of every text.

    ``ahead`` and ``behind`` are the characters of its field in the word before it (from the candidate before it on) and behind it; the other
    columns tell of the two words before the word and the one after it, which count for the first and the last field.
    Texts without any candidate are passed over before they are cut into words.
    """
    held = docs.select("doc_id", "source", "text").where(F.rlike(F.col("text"), F.lit(r"[A-Za-z0-9+/_\-]{12,}")))
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))

    def in_word(w: Column, i: Column) -> Column:
        before, after = F.concat_ws(" ", at(w, i - 2), at(w, i - 1)), at(w, i + 1)
        fields = F.split(F.btrim(w[i], F.lit(PARTS)), F.lit(PART))
        bound = F.struct(
            tokens(w[i]).alias("tokens"), F.split(w[i], F.lit(TOKEN), -1).alias("gaps"), F.size(tokens(F.element_at(fields, 1))).alias("first"),
            F.size(tokens(F.element_at(fields, -1))).alias("last"), F.sha2(before, 256).alias("sha"), F.rlike(before, F.lit(NAMED)).alias("named"),
            F.rlike(before, F.lit("[=:]$")).alias("assigned"), F.rlike(before, F.lit(HARMLESS)).alias("harmless"), F.rlike(after, F.lit(HARMLESS)).alias("harmless_after"))
        return let(bound, lambda b: F.transform(b["tokens"], lambda token, k: F.struct(
            i.alias("word_at"), token.alias("token"),
            F.element_at(F.split(F.concat(F.when(k > 0, F.get(b["tokens"], k - 1)).otherwise(""), F.get(b["gaps"], k)), F.lit(PART)), -1).alias("ahead"),
            F.element_at(F.split(F.get(b["gaps"], k + 1), F.lit(PART)), 1).alias("behind"), b["sha"].alias("before_sha256"),
            ((k < b["first"]) & b["named"]).alias("named_before"), ((k < b["first"]) & b["assigned"]).alias("assigned_before"),
            (((k < b["first"]) & b["harmless"]) | ((k >= F.size(b["tokens"]) - b["last"]) & b["harmless_after"])).alias("harmless_around"))))

    def found(w: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.rlike(w[i], F.lit(TOKEN)))
        return F.flatten(F.transform(spots, lambda i: in_word(w, i)))

    return held.select("doc_id", "source", F.explode(F.when(F.size(words(F.col("text"))) > 0, let(words(F.col("text")), found))).alias("_c")).select("doc_id", "source", "_c.*")


def dictionary(docs: DataFrame) -> DataFrame:
    """``piece``: lower-case runs of three letters or more that stand as words of their own in ``LEAST_DOCUMENTS`` documents."""
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![A-Za-z0-9])[a-z]{3,}(?![A-Za-z0-9])"), F.lit(0)))).alias("piece"))
    return each.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("piece")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with ``FEATURES`` (but ``path_rate``) and ``label``: 1 or 0 where rules are sure, else NULL.

    ``covered`` is the part of a candidate's characters that lies in words of the dictionary; ``path_depth`` is the depth of the
    source's name. Rules for labels look at issuer prefixes, which are no feature.
    """
    tokens = stored(found.select("token").distinct(), "tokens")
    pieces = tokens.select("token", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("piece"))
    covered = pieces.join(known, "piece").groupBy("token").agg(F.sum(F.length("piece")).alias("known_chars"))
    count = lambda pattern: F.regexp_count("token", F.lit(pattern))
    size = F.length("token")
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    near = F.element_at(F.split(F.concat("ahead", "token", "behind"), F.lit(r"[=:]")), 1)
    rows = found.join(checked_broadcast(stored(covered, "covered")), "token", "left").withColumns({
        "length": size.cast("double"), "transitions": count(r"(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])") / size,
        "distinct": F.size(F.array_distinct(F.split("token", ""))) / size, "digits": count("[0-9]") / size, "uppers": count("[A-Z]") / size, "vowels": count("(?i)[aeiou]") / size,
        "hex_only": yes(F.rlike("token", F.lit("^[0-9a-f]+$"))), "covered": F.coalesce(F.col("known_chars") / size, F.lit(0.0)),
        "assigned": yes(F.rlike("ahead", F.lit(r"[=:][\"'`]?$")) | (F.col("assigned_before") & F.rlike("ahead", F.lit(r"^[\"'`]?$")))),
        "quoted": yes(F.rlike("ahead", F.lit("[\"'`]$")) | F.rlike("behind", F.lit("^[\"'`]"))),
        "named_near": yes(F.col("named_before") | F.rlike(near, F.lit(NAMED))), "harmless_near": yes(F.col("harmless_around") | F.rlike(near, F.lit(HARMLESS))),
        "path_depth": F.regexp_count(F.coalesce("source", F.lit("")), F.lit("[/.]")).cast("double")})
    sure = F.rlike("token", F.lit(ISSUED)) | ((F.col("named_near") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0))
    name = F.rlike("behind", F.lit(r"^[\"'`]?[=:]")) & ~F.rlike("token", F.lit(ISSUED))
    harmless = F.rlike("token", F.lit(PLAIN)) | (F.col("harmless_near") == 1) | name
    return rows.withColumn("label", F.when(harmless, F.lit(0)).when(sure, F.lit(1)))


def scored(rows: DataFrame, seed: int = 11) -> DataFrame:
    """``rows`` with ``score`` 0 to 1, by a forest grown on the rows with a ``label``; rows of one label only give that label, none 0."""
    marked = rows.where("label IS NOT NULL")
    rates = stored(marked.groupBy(key_of("source").alias("path")).agg((F.sum("label") / F.count("*")).alias("path_rate")), "rates")
    found = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    full = rows.withColumn("path", key_of("source")).join(checked_broadcast(rates), "path", "left").drop("path")
    full = stored(full.withColumn("path_rate", F.coalesce("path_rate", F.lit(0.5))), "described")
    if len(found) < 2:
        return full.withColumn("score", F.lit(float(next(iter(found), 0))))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    share = int(min(1.0, MOST_ROWS / sum(found.values())) * (1 << 20))
    labelled = full.where("label IS NOT NULL").where(F.pmod(F.xxhash64("token", "doc_id", "word_at"), F.lit(1 << 20)) < share)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(vectors.transform(labelled))
    return forest.transform(vectors.transform(full)).withColumn("score", vector_to_array("probability")[1])


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, word_at, length, before_sha256, token_sha256, label, score``: the findings that the forest keeps.

    The secret itself is not returned. NULL texts have no candidates; a NULL id is kept; equal rows have equal findings.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = described(stored(candidates(plain), "candidates"), dictionary(plain))
    kept = scored(rows).where(F.col("score") >= THRESHOLD)
    return kept.select("doc_id", "word_at", F.col("length").cast("int").alias("length"), "before_sha256",
                       F.sha2("token", 256).alias("token_sha256"), "label", "score")
