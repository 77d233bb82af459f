"""Secrets in texts: candidates by shape, told from false positives by a random forest.

Everything runs as DataFrame expressions and Spark's own forest. The forest sees a candidate's length,
the transitions between kinds of characters, how much of it words of the corpus cover, the path it was found
under, and the words beside it. It learns from labelled findings: a table of the caller's, or
findings planted into a bounded number of the corpus's own texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import picked, stored

LEAST_LENGTH = 12
#: Texts with a word are needed for it to count as a word of the corpus.
WORD_TEXTS = 3
#: About so many texts get a planted finding to learn from.
PLANTED_TEXTS = 6000
TREES, DEPTH, SEED = 40, 8, 17
BUCKETS = 16
THRESHOLD = 0.5
VALUE = r"^[A-Za-z0-9_+/=~.@:%&?#$!*^-]+$"
#: A value that follows a key may be as short as this.
KEYED_LENGTH = 4
KEY = r"(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)"
_PLAIN = r"""\s"'`,;&<>(){}\[\]|\\"""
URL = r"""(?<![=:])(?<![=:]["'`])(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'`,;<>(){}\[\]|\\]*+"""
#: key=value, "key":"value", 'key'=>'value' and the like: the key, and the value with its quotes.
PAIR = (
    KEY + r"""[\\"'`\])]{0,4}(?:=>|:=|={1,3}|:)(?!//)"""
    r"""([A-Za-z][A-Za-z0-9+.-]*+://[^\s"'`<>\\]*+|\\*"[^"]+"?|\\*'[^']+'?|`[^`]+`?"""
    rf"""|[^=:{_PLAIN}][^{_PLAIN}]*+(?:&(?![A-Za-z_][A-Za-z0-9_.-]*+=)[^{_PLAIN}]*+){{0,50}}+)"""
)
USERINFO = r"""://[^\s/:@"'`]*+:([^\s/@"'`]++)@"""
RUN = r"[A-Za-z0-9_+/=~.@:%&?#$!*^-]{12,}"
QUOTED = r"""["'`]([^"'`]*[^"'`A-Za-z0-9_+/=~.@:%&?#$!*^-][^"'`]*)["'`]"""
PEM_HEAD = r"-----BEGIN\s++(?:[A-Z0-9]++\s++){0,4}?PRIVATE\s++KEY(?:\s++BLOCK)?-----"
PEM = PEM_HEAD + r"(?:[^-]++|-(?!----)){0,400}+(?:-----END\s[A-Z0-9 ]*+-----)?"
# Words that stand beside secrets, and beside harmless numbers.
SECRET_WORDS = "password|passwd|pwd|secret|token|apikey|api_key|key|auth|bearer|credential|private"
HARMLESS_WORDS = "commit|sha|sha1|sha256|md5|checksum|digest|uuid|version|release|build|ref|issue|example|sample|mail|http|https|etag"
TEST_PATHS = "test|spec|mock|fixture|example|sample|docs?"
CONFIG_PATHS = r"\.(env|ya?ml|json|ini|cfg|conf|toml|properties|pem|tf)$|config|settings"
KINDS = "aA0s"
PAIRS = [x + y for x in KINDS for y in KINDS if x != y]


def split_words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\s+")


def _core(word: Column) -> Column:
    """Without quotes, brackets and punctuation around it."""
    return F.regexp_replace(word, r"""^[^A-Za-z0-9_+/~-]+|[^A-Za-z0-9_+/=~-]+$""", "")


def _pairs(word: Column) -> Column:
    """(key, value) of every pair in the word, the value without its quotes."""
    def plain(raw):
        return F.when(raw.rlike(r"""^\\*["'`]"""), F.regexp_replace(raw, r"""^\\*["'`]|\\*["'`]$""", "")).otherwise(F.regexp_replace(raw, r"[.:?]+$", ""))

    keys, values = F.regexp_extract_all(word, F.lit(PAIR), 1), F.regexp_extract_all(word, F.lit(PAIR), 2)
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), plain(v).alias("value")))


def _unkeyed(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit("").alias("key"), v.alias("value")))


def candidates(texts: DataFrame) -> DataFrame:
    """(row columns but text, word_index, key, value, left, right) of everything in a word that may be a secret.

    A word gives all its key=value and key:value pairs, pairs within their values, addresses, passwords in
    addresses, and of what is left every maximal run of signs and every quoted string with other signs. A value
    after a key, in the word or in the word before, has KEYED_LENGTH signs or more; any other has LEAST_LENGTH or
    more with a letter and a digit. A private key in PEM form is one candidate, under the key private_key. A value
    ends at white space. Texts may be null, empty or of any length; each occurrence is one row.
    """
    words = texts.withColumn("words", split_words(F.col("text")))
    keep = [c for c in words.columns if c not in ("words", "text")]
    may = lambda w: (F.length(w) >= LEAST_LENGTH) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    # The words beside a word come from shifted arrays: looking them up by index would split the text again for each.
    none, w = F.array(F.lit("")), F.col("words")
    shifted = F.arrays_zip(w.alias("word"), F.concat(none, none, w).alias("second"), F.concat(none, w).alias("first"), F.slice(w, F.lit(2), F.size(w)).alias("after"))
    every = F.filter(F.transform(shifted, lambda s, i: F.struct(i.alias("word_index"), s["word"].alias("word"), s["second"].alias("second"), s["first"].alias("first"), s["after"].alias("after"))), lambda s: s["word"].isNotNull())
    found = F.filter(every, lambda s: may(s["word"]) | (F.length(s["word"]) >= KEYED_LENGTH) & (s["first"].rlike("[=:]>?$") | s["word"].rlike("[=:].")))
    rows = words.select(*keep, F.explode(found).alias("c")).select(*keep, "c.*")
    left = F.when(F.col("word_index") == 0, F.array().cast("array<string>")).when(F.col("word_index") == 1, F.array("first")).otherwise(F.array("second", "first"))
    rows = rows.select(*keep, "word_index", "word", F.col("first").rlike("[=:]>?$").alias("spaced"), left.alias("left"), F.filter(F.array("after"), lambda r: r.isNotNull()).alias("right"))

    # A word after "key =" or "key:" is read as the value of a key without a name.
    rows = rows.withColumn("word", F.when(F.col("spaced"), F.concat(F.lit("_="), "word")).otherwise(F.col("word")))
    rows = rows.withColumn("urls", F.regexp_extract_all("word", F.lit(URL), 0)).withColumn("rest", F.regexp_replace("word", URL, " "))
    rows = rows.withColumn("pairs", _pairs(F.col("rest"))).withColumn("rest", F.regexp_replace("rest", PAIR, " "))
    holders = F.concat("urls", F.transform("pairs", lambda p: p["value"]))
    inner = F.flatten(F.transform(F.filter(holders, lambda h: h.rlike("[=:]")), _pairs))
    logins = F.transform(F.regexp_extract_all("word", F.lit(USERINFO), 1), lambda v: F.struct(F.lit("password").alias("key"), v.alias("value")))
    # Long keys, runs and quoted strings are candidates of their own.
    bare = F.concat(F.transform("urls", _core), F.transform("pairs", lambda p: p["key"]), F.transform(F.regexp_extract_all("rest", F.lit(RUN), 0), _core), F.regexp_extract_all("rest", F.lit(QUOTED), 1))
    one = rows.select(*keep, "word_index", "left", "right", F.explode(F.concat("pairs", inner, logins, _unkeyed(bare))).alias("p"))
    value = F.col("p.value")
    after = (F.col("p.key") != "") & (F.length(value) >= KEYED_LENGTH) & value.rlike("[A-Za-z0-9]") & ~value.startswith("-----")
    single = one.where(after | may(value)).select(*keep, "word_index", F.when(F.col("p.key") == "_", "").otherwise(F.col("p.key")).alias("key"), value.alias("value"), "left", "right")

    # What stands before, between and after the blocks gives the words before each of them.
    parts = F.split(F.regexp_replace("text", PEM, "\u0001"), "\u0001")
    held = texts.where(F.col("text").rlike(PEM_HEAD)).withColumn("text", F.regexp_replace("text", "\u0001", " "))
    held = held.select(*keep, parts.alias("parts"), F.regexp_extract_all("text", F.lit(PEM), 0).alias("blocks"))
    each = held.select(*keep, "parts", "blocks", F.posexplode("blocks").alias("nth", "value"))
    before = F.concat_ws("", F.flatten(F.zip_with(F.slice("parts", F.lit(1), F.col("nth") + 1), F.slice("blocks", F.lit(1), F.col("nth")), lambda p, b: F.array(p, b))))
    each = each.withColumn("before", split_words(before)).withColumn("word_index", F.size("before") - 1)
    follows = split_words(F.get("parts", F.col("nth") + 1))
    whole = each.select(*keep, "word_index", F.lit("private_key").alias("key"), "value", F.slice("before", -F.least(F.size("before"), F.lit(3)), F.least(F.size("before") - 1, F.lit(2))).alias("left"), F.filter(F.slice(follows, 2, 1), lambda r: r != "").alias("right"))
    return single.union(whole)


def _runs(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), 0)


def dictionary(texts: DataFrame, *findings: DataFrame) -> DataFrame:
    """(run, ) of the findings' letter runs that are whole words of at least WORD_TEXTS texts."""
    runs = reduce(DataFrame.union, [f.select(F.explode(F.array_distinct(_runs(F.col("value")))).alias("run")) for f in findings]).distinct()
    runs = stored(runs, "runs")
    words = texts.select(F.explode(F.array_distinct(split_words(F.lower("text")))).alias("word")).select(F.expr("""trim(BOTH '.,;:!?"()' FROM word)""").alias("run"))
    met = words.where("length(run) >= 3").join(runs, "run", "left_semi")
    return met.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_TEXTS).select("run")


def covered(findings: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with ``coverage``: the share of their signs that lies in words of the dictionary."""
    rows = findings.withColumn("row", F.xxhash64("value"))
    runs = rows.select("value", F.explode(_runs(F.col("value"))).alias("run")).distinct()
    total = runs.join(words, "run").groupBy("value").agg(F.collect_set("run").alias("known"))
    joined = rows.drop("row").join(total, "value", "left")
    inside = F.aggregate(F.filter(_runs(F.col("value")), lambda r: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), r)), F.lit(0), lambda a, r: a + F.length(r))
    return joined.withColumn("coverage", inside / F.length("value")).drop("known")


def features(findings: DataFrame) -> dict[str, Column]:
    """Numbers the forest sees, from (value, key, left, right, path, coverage)."""
    value, length = F.col("value"), F.length("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "s")
    beside = F.lower(F.concat_ws(" ", "left", "key", "right"))
    path = F.lower(F.coalesce("path", F.lit("")))
    out = {
        "length": length.cast("double"),
        "runs": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / length,
        "different": F.size(F.array_distinct(F.split(value, "(?!^)"))) / length,
        "hex": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "same": value.rlike(r"(.)\1{4,}").cast("double"),
        "signs": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) / length,
        "at": value.contains("@").cast("double"),
        "slash": value.contains("/").cast("double"),
        "dashed": value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-").cast("double"),
        "coverage": F.col("coverage"),
        "keyed": (F.col("key") != "").cast("double"),
        "secret_word": beside.rlike(rf"(^|[^a-z])({SECRET_WORDS})([^a-z]|$)").cast("double"),
        "harmless_word": beside.rlike(rf"(^|[^a-z])({HARMLESS_WORDS})([^a-z]|$)").cast("double"),
        "assigned": beside.rlike("[=:](\\s|$)").cast("double"),
        "test_path": path.rlike(rf"(^|[^a-z])({TEST_PATHS})([^a-z]|$)").cast("double"),
        "config_path": path.rlike(CONFIG_PATHS).cast("double"),
        "path_depth": F.size(F.split(path, "/")).cast("double"),
    }
    for k in ("a", "A", "0"):
        out[f"share_{k if k != 'A' else 'upper'}"] = F.length(F.regexp_replace(kinds, f"[^{k}]", "")) / length
    for p in PAIRS:
        out["from_" + "_".join({"a": "low", "A": "up", "0": "digit", "s": "sign"}[x] for x in p)] = F.regexp_count(kinds, F.lit(f"{p[0]}(?={p[1]})")) / length
    before = F.coalesce(F.lower(F.try_element_at("left", F.lit(-1))), F.lit(""))
    bucket = F.pmod(F.xxhash64(before), F.lit(BUCKETS))
    return out | {f"before_{b}": (bucket == b).cast("double") for b in range(BUCKETS)}


def assembled(findings: DataFrame) -> DataFrame:
    made = features(findings)
    wide = findings.select(*findings.columns, *[F.coalesce(c, F.lit(0.0)).alias(f"f_{n}") for n, c in made.items()])
    return VectorAssembler(inputCols=[f"f_{n}" for n in made], outputCol="features").transform(wide).select(*findings.columns, "features")


def planted(texts: DataFrame, about: int = PLANTED_TEXTS) -> DataFrame:
    """Labelled findings (value, key, left, right, path, label) made from about so many texts of the corpus.

    The words beside a finding are the text's own at a hashed place. Secrets are keys, tokens and passwords of hashed
    signs; harmless findings are digests, ids, addresses, versions, names and placeholders.
    """
    rows = texts.count()
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("plant")), F.lit(1_000_000)) < int(min(1.0, about / max(1, rows)) * 1_000_000))
    words = chosen.select("path", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), split_words(F.col("text")).alias("words"))
    words = words.withColumn("at", F.pmod(F.xxhash64("id"), F.size("words")).cast("int"))
    words = words.select(
        "path", F.slice("words", F.greatest(F.col("at"), F.lit(1)), 2).alias("left"), F.slice("words", F.col("at") + 2, 1).alias("right"),
        F.sha2("id", 256).alias("h"), F.lower(F.regexp_replace(F.element_at("words", F.col("at") + 1), "[^A-Za-z]", "")).alias("word"),
        F.lower(F.regexp_replace(F.element_at("words", 1), "[^A-Za-z]", "")).alias("other"),
    )
    up = "upper(translate({}, '01', 'XY'))"
    made = [  # label, words just before, key, value
        (1, "array()", "''", f"concat('AKIA', {up.format('substr(h, 1, 16)')})"),
        (1, "array('token', '=')", "''", "substr(h, 1, 40)"),
        (1, "array('secret:')", "''", "substr(h, 3, 32)"),
        (1, "array()", "'password'", "substr(h, 5, 18)"),
        (1, "array()", "'api_key'", "substr(translate(base64(unhex(h)), '=', ''), 1, 32)"),
        (1, "array('Bearer')", "''", "substr(translate(base64(unhex(h)), '=', ''), 1, 40)"),
        (1, "array()", "''", "concat('ghp_', substr(translate(base64(unhex(h)), '=+/', 'abc'), 1, 36))"),
        (0, "array('commit')", "''", "substr(h, 1, 40)"),
        (0, "array('md5', 'checksum')", "''", "substr(h, 1, 32)"),
        (0, "array()", "'sha256'", "h"),
        (0, "array()", "''", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 13, 3), '-a', substr(h, 16, 3), '-', substr(h, 19, 12))"),
        (0, "array()", "''", "concat(word, '.', conv(substr(h, 1, 2), 16, 10), '@mail', conv(substr(h, 3, 1), 16, 10), '.example.com')"),
        (0, "array()", "''", "concat('http://', other, '.example.org/', word, '/', conv(substr(h, 1, 3), 16, 10))"),
        (0, "array('version')", "''", "concat(word, '-', conv(substr(h, 1, 1), 16, 10), '.', conv(substr(h, 2, 1), 16, 10), '.0-beta')"),
        (0, "array()", "''", "concat(word, '_', other, '_', conv(substr(h, 1, 3), 16, 10))"),
        (0, "array()", "''", "concat('2024-0', 1 + conv(substr(h, 1, 1), 16, 10) % 9, '-1', conv(substr(h, 2, 1), 16, 10) % 10, 'T10:', 10 + conv(substr(h, 3, 1), 16, 10), ':00Z')"),
        (0, "array()", "'password'", "concat('changeme', conv(substr(h, 1, 4), 16, 10))"),
        (0, "array('token', '=')", "''", "concat('xxxxxxxxxxxxxxx', conv(substr(h, 1, 2), 16, 10))"),
        (0, "array()", "''", "concat(word, conv(substr(h, 1, 5), 16, 10), other)"),
        (1, "array()", "'password'", "concat(initcap(substr(translate(h, '0123456789', 'ghijklmnop'), 1, 6)), '$', substr(h, 7, 3), '!')"),
        (1, "array('password', '=')", "''", "translate(substr(h, 9, 10), '0123456789', 'rstuvwxyzk')"),
        (1, "array()", "'passwd'", "substr(translate(h, '0123456789', 'ghijklmnop'), 11, 9)"),
        (1, "array()", "'private_key'", "concat('-----BEGIN RSA PRIVATE KEY-----\\n', repeat(base64(unhex(h)), 20), '\\n-----END RSA PRIVATE KEY-----')"),
        (0, "array('note:')", "''", "word"),
        (0, "array()", "'title'", "word"),
        (0, "array()", "'name'", "concat(word, '-', other)"),
        (0, "array()", "'port'", "conv(substr(h, 1, 4), 16, 10)"),
    ]
    kinds = F.array(*[F.struct(F.lit(label).alias("label"), F.expr(before).cast("array<string>").alias("before"), F.expr(key).alias("key"), F.expr(value).alias("value")) for label, before, key, value in made])
    rows = words.select("path", "left", "right", F.explode(kinds).alias("k")).select("path", "right", "k.*", F.expr("slice(concat(left, k.before), -least(2, size(concat(left, k.before))), 2)").alias("left"))
    after = (F.col("key") != "") | F.coalesce(F.try_element_at("left", F.lit(-1)).rlike("[=:]$"), F.lit(False))
    return rows.where(F.length("value") >= F.when(after, KEYED_LENGTH).otherwise(LEAST_LENGTH)).select("value", "key", "left", "right", "path", "label")


def train(labelled: DataFrame, words: DataFrame) -> RandomForestClassificationModel | None:
    """A forest of labelled findings; None if they do not have both labels."""
    rows = stored(assembled(covered(labelled.where("label IN (0, 1)"), words)).select("features", F.col("label").cast("double").alias("label")), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, featureSubsetStrategy="sqrt").fit(rows)


def secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col="doc_id", text_col="text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, word_index, length, value_sha256, score, is_secret) of every candidate.

    ``labelled`` has value, key, left, right, path and label; by default findings are planted. The value itself is
    not returned. Repeated rows give repeated findings; a null id or path, and a null, empty or very long text,
    are as good as any. If the labels are all alike, every candidate scores one half.
    """
    texts = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"}) if path_col is None else picked(docs, {"doc_id": id_col, "text": text_col, "path": path_col}, {"text": "string", "path": "string"})
    if path_col is None:
        texts = texts.withColumn("path", F.lit(None).cast("string"))
    found = stored(candidates(texts), "candidates")
    learn = stored(planted(texts) if labelled is None else labelled.select(*[quoted(c) for c in ("value", "key", "left", "right", "path", "label")]), "labelled")
    words = stored(dictionary(texts, found, learn), "words")
    model = train(learn, words)
    rows = assembled(covered(found, words))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_index", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def op1_secrets(spark, sf: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf}/documents.parquet"))
