"""Candidates beside a plain scan, and findings of kinds with a known answer."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import secrets as s


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def documents():
    filler = "the quick brown foxes were running over lazy dogs and many other animals in that field"
    words = filler.split()
    rows, truth = [], {}
    for i in range(600):
        h = hashlib.sha256(f"real {i}".encode()).hexdigest()
        kinds = [
            ("AKIA" + h[:16].upper().replace("0", "Q").replace("1", "R"), "{}", True), (h[:40], 'token = "{}"', True), (h[5:23], "password={}", True),
            (h[:40], "commit {}", False), (f"{words[i % 16]}.{i}@mail7.example.com", "{},", False), (f"{h[:8]}-{h[8:12]}-4{h[12:15]}-a{h[15:18]}-{h[18:30]}", "id {}", False),
        ]
        value, shape, secret = kinds[i % 6]
        cut = i % len(words)
        rows.append((i, " ".join(words[:cut] + [shape.format(value)] + words[cut:]), f"src{i % 3}"))
        truth[i] = (sha(value), secret)
    return rows, truth


def test_finds_secrets_and_leaves_the_rest(spark):
    rows, truth = documents()
    extra = [(9000, None, "a"), (9001, "", None), (9002, "word " * 40_000, "a"), (None, "password=e3b3ed3cc8548923d6", None), rows[0]]
    df = spark.createDataFrame([(*r, 0.5, "w") for r in rows + extra], "doc_id bigint, text string, source string, score double, words string")
    got = s.secrets(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {*truth, None} and len(by[0]) == 2
    assert all(by[i][0]["value_sha256"] == truth[i][0] for i in truth)
    right = [(by[i][0]["is_secret"] == truth[i][1]) for i in truth]
    assert sum(right) / len(right) > 0.97
    assert by[None][0]["is_secret"]


def test_candidates_beside_a_plain_scan(spark):
    rows, _ = documents()
    rows = rows[:60] + [(700, "x=1 http://host.example.org/a1/b2 abc123abc123! (key:abcdef123456) ünïcode1234567 1234567890123", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, path string")
    got = {(r["doc_id"], r["word_index"]): (r["key"], r["value"], r["left"], r["right"]) for r in s.candidates(df).collect()}
    core = lambda w: re.sub(r"^[^A-Za-z0-9_+/~-]+|[^A-Za-z0-9_+/=~-]+$", "", w)
    want = {}
    for d, text, _ in rows:
        words = re.split(r"\s+", text)
        for i, w in enumerate(words):
            c = core(w)
            m = re.match(r"^([A-Za-z_][A-Za-z0-9_.-]*)[=:](?!//)(.+)$", c)
            key, value = (m[1], core(m[2])) if m else ("", c)
            if len(value) >= 12 and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and re.match(s.VALUE, value):
                want[(d, i)] = (key, value, words[max(0, i - 2) : i], words[i + 1 : i + 2])
    assert got == want and (700, 3) in got


def test_labels_of_the_caller_and_no_rows(spark):
    rows, truth = documents()
    df = spark.createDataFrame(rows[:120], "doc_id bigint, text string, source string")
    labelled = s.candidates(df.withColumnRenamed("source", "path")).withColumn("label", F.lit(1))
    assert {r["score"] for r in s.secrets(df, labelled).collect()} == {0.5}
    assert s.secrets(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    rows, _ = documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = s.secrets(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text,coverage", [("foxes99animals", 12 / 14), ("zqzqzq998877", 0.0)])
def test_coverage(spark, text, coverage):
    words = spark.createDataFrame([("foxes",), ("animals",)], "run string")
    found = spark.createDataFrame([(text,), (text,)], "value string")
    assert [r["coverage"] for r in s.covered(found, words).collect()] == pytest.approx([coverage, coverage])


H = hashlib.sha256(b"shapes").hexdigest()[:32]
PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA\nabcd\n-----END RSA PRIVATE KEY-----"


SHAPES = [
    (f'{{"api_key":"{H}"}}', {("api_key", H)}), (f'"token":"{H}",', {("token", H)}), (f"user=bob;password={H}", {("password", H)}), (f"a,{H},{H},b", {("", H)}),
    (f"token('{H}')", {("", H)}), ("password=Tr0ub4dor$3xyz", {("password", "Tr0ub4dor$3xyz")}), ("pwd=a!b*c^d1", {("pwd", "a!b*c^d1")}), ("password=hunter", {("password", "hunter")}),
    ('"password": "hunter"', {("", "hunter")}), ('conn="user=robert;password=ab12"', {("conn", "user=robert;password=ab12"), ("user", "robert"), ("password", "ab12")}),
    (f"https://h.example.org/p?token={H}&b=c", {("", f"https://h.example.org/p?token={H}&b=c"), ("token", H)}), ("mysql://user:pa55w0rd@h/db1", {("password", "pa55w0rd"), ("", "mysql://user:pa55w0rd@h/db1"), ("user", "pa55w0rd@h/db1")}),
    ('{\\"api_key\\":\\"' + H + '\\"}', {("api_key", H)}), ("dGhpc2lzYXNlY3JldDEyMw==", {("", "dGhpc2lzYXNlY3JldDEyMw==")}), (f"see {PEM} end", {("private_key", PEM)}),
]


def test_every_candidate_of_a_word(spark):
    rows = [(i, text, "p") for i, (text, _) in enumerate(SHAPES)]
    got = s.candidates(spark.createDataFrame(rows, "doc_id bigint, text string, path string")).collect()
    for i, (text, want) in enumerate(SHAPES):
        found = [(r["key"], r["value"]) for r in got if r["doc_id"] == i]
        assert set(found) - {("", "MIIEowIBAAKCAQEA")} == want
        assert len(found) == len(set(found)) + text.count(f"{H},{H}")
    block = next(r for r in got if r["key"] == "private_key")
    assert (block["word_index"], block["left"], block["right"]) == (1, ["see"], ["end"])


def test_minified_secrets_are_found_and_long_words_end(spark):
    rows, _ = documents()
    more = [(8000 + i, f'{{"id":{i},"api_key":"{hashlib.sha256(str(i).encode()).hexdigest()[:32]}"}}', "s") for i in range(20)]
    long = [(9100, "a:" * 20_000, "s"), (9101, "-----BEGIN RSA PRIVATE KEY-----" + "-a" * 20_000, "s"), (9102, "x=" + "a&" * 20_000, "s")]
    got = s.secrets(spark.createDataFrame(rows + more + long, "doc_id bigint, text string, source string")).where("doc_id BETWEEN 8000 AND 8999").collect()
    assert len(got) == 20 and sum(r["is_secret"] for r in got) >= 19
