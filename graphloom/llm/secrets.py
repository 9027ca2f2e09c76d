"""Secret scans: candidate strings judged by a random forest, in DataFrame functions alone.

A candidate is a run of at least 16 characters of [A-Za-z0-9+/_-] with a digit in it, or after an assignment (`=`, `:`,
`=>` or `Bearer`, up to three blanks and a quote) any run of at least `ASSIGNED_LEAST`; up to two closing `=` belong to
it. Runs that start with the `//` of `scheme://` are no values. Its features are its length, transitions between kinds of characters, the share of it that dictionary words cover, the
path of its document and the words beside it. The forest is trained by Spark's own library on labelled findings and
then written out as one SQL expression, so that scoring is part of the query's generated code.

`labelled_findings` makes the default training set from templates (true credentials in assignments and with known
prefixes; digests, identifiers, numbers, dates, paths and placeholders as false positives); any table of findings with
the same columns can take its place.

Dictionary coverage is the share of a candidate's characters that lie in words: its runs of letters, cut where capitals
begin, that are in a word list (`word_list` reads one from a public vocabulary file, by path), and well-known parts of names.

An empty table gives no findings. Columns besides key, text and path are not read, so none can clash. Null texts have no
candidates; a null path counts as empty. Repeated documents report their findings each. Whole texts
are read; several equal candidates in a text are several findings, told apart by their start.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tokenizer_text

ASSIGNED_LEAST = 4
#: Lookbehinds of one width each, for Python and Java alike: sign, blanks, quote.
_AFTER = "|".join(rf"(?<={sign}[ \t]{{{n}}}{quote})" for sign in ("[:=]", "=>") for n in range(4) for quote in ("", "[\"'`]")) + "|(?<=[Bb]earer )"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{16,}}|(?=[A-Za-z0-9+/_-]{{{ASSIGNED_LEAST}}})(?:{_AFTER})(?!(?<=:)//)[A-Za-z0-9+/_-]+)(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
CONTEXT, TRAINING_ROWS, TREES, DEPTH = 80, 4000, 15, 5
#: Parts of names that are no words of their own, and words beside findings (fixed values).
DICTIONARY = "(?i)(changeme|dummy|passwd|http|html|json|abcdef|123456|xxxx|0000)"
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|signing|client.?key|-key|_key)[a-z_\- ]{0,20}$"
ASSIGNED = r"""(?i)[a-z_\-]+\s{0,3}[:=]{1,2}>?\s{0,3}["'`]?$"""
SECRET_ASSIGNED = r"""(?i)(secret|token|passw|pwd|key|auth|bearer|credential|private)[a-z0-9_\-]{0,20}["']?\s{0,3}[:= ]{1,3}>?\s{0,3}["'`]?$"""
DIGEST_WORDS = r"(?i)(sha|md5|hash|digest|checksum|commit|integrity|etag|revision|uuid|guid|fingerprint|tree|blob)[a-z0-9_\- :=\"']{0,12}$"
TEST_PATHS = r"(?i)(test|example|fixture|sample|mock|doc|readme|lock|vendor|\.min\.)"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza|SG|eyJ|npm_|pypi-)"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, path, start (characters before it), candidate, before and after (up to 80 characters each)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))
    cut = rows.where(F.col("text").rlike(CANDIDATE)).select("key", "path", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    gap = lambda i: F.get("gaps", i)
    # what lies before a candidate may be a candidate itself, as the name in NAME_OF_16_OR_MORE_1=value
    back = -(-CONTEXT // ASSIGNED_LEAST)
    cut = cut.withColumn("ends", F.transform("found", lambda c, i: F.right(F.concat(gap(i), c), F.lit(CONTEXT))))
    earlier = lambda i: F.array_join(F.slice("ends", F.greatest(i + 1 - back, F.lit(1)), F.least(i, F.lit(back))), "")
    parts = F.transform("found", lambda c, i: F.struct(c.alias("candidate"), F.right(F.concat(earlier(i), gap(i)), F.lit(CONTEXT)).alias("before"), F.left(gap(i + 1), F.lit(CONTEXT)).alias("after"), (F.length(gap(i)) + F.length(c)).alias("steps")))
    each = cut.select("key", "path", "row", F.posexplode(parts).alias("n", "part")).select("key", "path", "row", "n", "part.*")
    ends = F.sum("steps").over(Window.partitionBy("row").orderBy("n"))
    return each.select("key", "path", (ends - F.length("candidate")).cast("long").alias("start"), "candidate", "before", "after")


def word_list(path: str, least: int = 4, most: int = 16) -> list[str]:
    """The lower-case words that a byte-level vocabulary file holds whole, with the blank before them."""
    words = (t[1:] for t in json.loads(tokenizer_text(path))["model"]["vocab"] if t.startswith("\u0120"))
    return sorted({w for w in words if least <= len(w) <= most and w.isascii() and w.isalpha() and w.islower()})


def covered(candidate: Column, words: list[str]) -> Column:
    """How many characters of a candidate lie in dictionary words or known parts of names."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w)
    shelves = F.create_map(*(F.lit(x) for letter, own in by_letter.items() for x in (letter, f"|{'|'.join(own)}|")))  # one constant for the whole list
    in_list = lambda r: F.coalesce(F.contains(F.try_element_at(shelves, F.left(r, F.lit(1))), F.concat(F.lit("|"), r, F.lit("|"))), F.lit(False))
    runs = F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    known = F.aggregate(F.filter(runs, lambda r: in_list(F.lower(r))), F.lit(0), lambda n, r: n + F.length(r))
    return F.greatest(known, F.length(candidate) - F.length(F.regexp_replace(candidate, DICTIONARY, "")))


def features(words: list[str]) -> dict[str, Column]:
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    return {
        "length": F.log(n),
        "digits": share("[0-9]"),
        "lower": share("[a-z]"),
        "upper": share("[A-Z]"),
        "letters_to_digits": share("[A-Za-z](?=[0-9])"),
        "digits_to_letters": share("[0-9](?=[A-Za-z])"),
        "lower_to_upper": share("[a-z](?=[A-Z])"),
        "upper_to_lower": share("[A-Z](?=[a-z])"),
        "to_marks": share("[A-Za-z0-9](?=[+/_=-])"),
        "repeats": share(r"(.)(?=\1)"),
        "vowels": share("[aeiouAEIOU]"),
        "hexadecimal": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "number": c.rlike("^[0-9]+$").cast("double"),
        "grouped": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}").cast("double"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": covered(c, words) / n,
        "prefix": c.rlike(PREFIXES).cast("double"),
        "slashes": share("/"),
        "test_path": flag("path", TEST_PATHS),
        "secret_word": flag("before", SECRET_WORDS),
        "assigned": flag("before", ASSIGNED),
        "secret_assigned": flag("before", SECRET_ASSIGNED),
        "digest_word": flag("before", DIGEST_WORDS),
        "quoted": (flag("before", "[\"'`]$") * flag("after", "^[\"'`]")),
        "url_before": flag("before", r"(?i)(https?://|www\.|href=|src=)\S*$"),
    }


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """path, candidate, before, after, label, template: `rows` findings from templates, the same on every call."""
    i = F.col("id")
    hexes = F.sha2(i.cast("string"), 256)
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")), 256))), "[=]", "")
    digits = F.regexp_replace(F.conv(F.substring(hexes, 1, 14), 16, 10), "^", "4")
    word = F.element_at(F.array(*map(F.lit, ("report", "summary", "people", "system", "value", "thing", "notes"))), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(7)) + 1).cast("int"))
    names = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(len(x))) + 1).cast("int"))
    secret = names('token = "', 'api_key: "', 'secret="', "password = '", 'client_secret": "', "AUTH_TOKEN=", 'access_key = "', "Authorization: Bearer ")
    digest = names("commit ", "sha256:", "md5 = ", "checksum: ", "etag=", "integrity sha512-", "revision ", "hash ")
    plain = names("the ", "see ", "of ", "number ", "call ", "id ", "order ", "version ")
    cut = lambda x, n: F.substring(x, 1, n)
    letters = F.translate(base, "0123456789+/", "ghJKmnPQrsTU")
    variable = names("DB_PASSWORD=", "AUTH_TOKEN=", "AWS_SECRET_ACCESS_KEY=", "API_KEY=", "export CLIENT_SECRET=", "password: ")
    parameter = names("https://site/x?access_token=", "https://site/x?id=7&api_key=", "https://site/?client_secret=", "/login?password=")
    setting = names("color: ", 'name = "', "type: ", "lang=", "mode=", "width=", "https://site/x?page=", "https://site/?sort=", 'title: "', "DEBUG=", "Note: ", "key: ", "etag=")
    #: (candidate, before, after, label) by template
    templates = [
        (cut(hexes, 40), secret, '"', 1), (cut(hexes, 32), secret, '" and', 1), (cut(base, 40), secret, '"', 1), (cut(base, 24), secret, "'", 1), (hexes, secret, "\n", 1),
        (F.concat(F.lit("AKIA"), F.upper(cut(base, 16))), plain, " ", 1), (F.concat(F.lit("ghp_"), cut(F.regexp_replace(base, "[+/]", "a"), 36)), plain, " ", 1), (F.concat(F.lit("sk_live_"), cut(hexes, 24)), plain, "\n", 1),
        (cut(hexes, 40), digest, " ", 0), (hexes, digest, "\n", 0), (cut(hexes, 32), digest, ",", 0), (cut(hexes, 40), plain, " ", 0), (cut(base, 32), digest, " ", 0),
        (cut(digits, 16), plain, " ", 0), (digits, plain, ".", 0), (cut(digits, 16), names("card ", "account ", "phone: ", "tel="), " ", 0),
        (F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), plain, " ", 0),
        (F.concat_ws("-", F.lit("2024"), F.lit("05"), F.lpad(F.pmod(i, F.lit(28)).cast("string"), 2, "0"), word, F.lit("build7")), plain, " ", 0),
        (F.concat(F.lit("your_token_example_"), cut(digits, 4)), secret, '"', 0), (F.concat(F.lit("xxxx0000"), word, F.lit("_changeme_1")), secret, '"', 0),
        (F.concat(F.lit("/images/"), word, F.lit("/photo-"), cut(digits, 5)), names('src="', "https://site/", 'href="', "see "), '"', 0), (F.concat(word, F.lit("_module_version_"), cut(digits, 3)), plain, " ", 0),
        (cut(base, 40), variable, "\n", 1), (cut(hexes, 40), parameter, "&", 1), (cut(letters, 24), variable, "\n", 1), (cut(letters, 16), secret, '"', 1), (cut(letters, 20), parameter, " ", 1),
        (cut(base, 8), variable, "\n", 1), (cut(base, 10), secret, '"', 1), (F.concat(cut(word, 6), cut(digits, 2)), secret, '"', 1), (F.concat(cut(word, 6), F.substring(digits, 5, 1)), variable, "\n", 1),
        (word, setting, " ", 0), (word, secret, " ", 0), (word, variable, "\n", 0), (names("changeme", "your_password", "example", "test", "true", "null", "required", "string"), secret, '"', 0), (names("false", "none", "true", "null", "required", "string"), variable, "\n", 0),
        (cut(digits, 4), setting, " ", 0), (F.concat_ws("-", word, names("page", "left", "main", "blue")), setting, " ", 0), (F.concat(F.lit("/data/"), word), setting, " ", 0), (cut(hexes, 8), setting, " ", 0),
    ]
    picks = F.array(*(F.struct(c.alias("candidate"), b.alias("before"), F.lit(a).alias("after"), F.lit(float(y)).alias("label")) for c, b, a, y in templates))
    row = F.element_at(picks, (F.pmod(i, F.lit(len(templates))) + 1).cast("int"))
    path = F.when(F.pmod(F.xxhash64(i, F.lit(3)), F.lit(5)) == 0, F.when(row["label"] == 0, "tests/example.py").otherwise("src/app.py")).otherwise("src0")
    made = spark.range(rows).select(path.alias("path"), row.alias("row"), F.pmod(i, F.lit(len(templates))).alias("template")).select("path", "row.candidate", F.concat(F.lit("text and "), F.col("row.before")).alias("before"), "row.after", "row.label", "template")
    return spark.createDataFrame(made.toArrow())  # a fixed number of short rows, so that no feature repeats the templates' expressions


def forest(findings: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Column:
    """The mean of the trees' probabilities of label 1 as an expression over the features' names."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(features(words))
    rows = findings.withColumns(features(words)).select("label", *names).coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))

    def expression(node) -> Column:
        if node.numDescendants() == 0:
            counts = list(node.impurityStats().stats())
            return F.lit(float(counts[1] / sum(counts)) if len(counts) > 1 and sum(counts) else 0.0)
        split = node.split()
        return F.when(F.col(names[split.featureIndex()]) <= F.lit(float(split.threshold())), expression(node.leftChild())).otherwise(expression(node.rightChild()))

    every = [expression(t._java_obj.rootNode()) for t in model.trees]
    count = len(every)
    while len(every) > 1:  # added by pairs, so that the expression stays flat
        every = [every[i] + every[i + 1] if i + 1 < len(every) else every[i] for i in range(0, len(every), 2)]
    return every[0] / F.lit(float(count))


_FORESTS: dict[tuple, Column] = {}


def default_forest(spark: SparkSession, words: tuple[str, ...]) -> Column:
    """The forest of the labelled findings, which do not depend on the data: fitted once for a Spark application and word list."""
    key = (spark.sparkContext.applicationId, words)
    if key not in _FORESTS:
        _FORESTS.clear()
        _FORESTS[key] = forest(labelled_findings(spark), list(words))
    return _FORESTS[key]


def scan(docs: DataFrame, words: list[str], findings: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A row for each candidate: key, start, candidate, score, is_secret."""
    score = default_forest(docs.sparkSession, tuple(words)) if findings is None else forest(findings, words)
    judged = candidates(docs, key, text, path).withColumns(features(words)).withColumn("score", score)
    return judged.select(F.col("key").alias(key), "start", "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), word_list(public_tokenizers.path("byte_bpe_50k.json")))
