"""Extraction rules: boundary rows, agreement with a linear-time engine, long hostile texts."""

import random
import time

import duckdb
import pandas as pd
import pytest

from gleaner.functions.patterns import DEFAULT_RULES, WHOLE_IPV6_RULES, PatternRule, oracle_patterns
from gleaner.operators.extract import scan, with_ioc_count
from pyspark.sql import functions as F

MD5, SHA1, SHA256 = "a1B2" * 8, "0a1B2" * 8, "a1B2c3D4" * 8

CASES = [
    ("ipv4", "8.8.8.8 and 8.8.8.8", ["8.8.8.8"]),
    ("ipv4", "192.168.001.1", []),
    ("ipv4", "256.1.1.1", []),
    ("ipv4", "1.2.3.4.5", ["1.2.3.4"]),
    ("ipv4", "x1.2.3.4 1.2.3.4_ (5.6.7.8)", ["5.6.7.8"]),
    ("ipv6", "2001:db8:1:2:3:4:5:6", ["2001:db8:1:2:3:4:5:6"]),
    ("ipv6", " fe80::1 ", ["fe80::"]),
    ("ipv6", "::1", ["::1"]),
    ("ipv6", "0:0:0:0:0:ffff:102:304", []),
    ("ipv6", "::ffff:102:304", []),
    ("ipv6", "::ffff:1.2.3.4", ["::ffff:1"]),
    ("ipv6", "foo::add", ["::add"]),
    ("ipv6", "DEAD::BEEF", ["DEAD::"]),
    ("md5", f"{MD5} {MD5.upper()}", [MD5.lower()]),
    ("md5", "f" * 32 + " " + "0" * 32 + " " + "F" * 32, []),
    ("md5", f"{SHA1} {SHA256}", []),
    ("sha1", SHA1, [SHA1.lower()]),
    ("sha1", "0" * 40, []),
    ("sha256", f"({SHA256})", [SHA256.lower()]),
    ("sha256", "F" * 64, []),
    ("sha256", SHA256 + "0", []),
    ("domain", "WWW.Evil.COM", ["www.evil.com"]),
    ("domain", "main.go", ["main.go"]),
    ("domain", "a.company", []),
    ("domain", "a_b.com", []),
    ("domain", "éevil.co", ["evil.co"]),
    ("domain", "evil.com.x1y", ["evil.com"]),
    ("domain", "foo.co-bar.zzz9", ["foo.co"]),
    ("domain", "a.co-.evil.com", ["a.co", "evil.com"]),
    ("domain", "x" * 64 + ".com", []),
    ("domain", "x" * 63 + ".com", ["x" * 63 + ".com"]),
    ("url", "(HTTP://Evil.com/a?b).", ["HTTP://Evil.com/a?b"]),
    ("url", "http://...", ["http://"]),
    ("url", "xhttp://a.b <https://c.d/e>", ["https://c.d/e"]),
    ("email", "A@B.org", ["a@b.org"]),
    ("email", "a@b.com-c@d.org", ["a@b.com", "-c@d.org"]),
    ("email", "a@b@c.com x@y", ["b@c.com"]),
    ("domain", "A@B.org", ["b.org"]),
    ("domain", "evil.c\nom", []),
    ("email", "", []),
]


def test_boundary_rows(spark):
    rows = [(i, text) for i, (_, text, _) in enumerate(CASES)]
    found = scan(spark.createDataFrame(rows, "i int, content string"), ["i"]).collect()
    for i, (ioc_type, text, expected) in enumerate(CASES):
        got = [r["ioc_value"] for r in found if r["i"] == i and r["ioc_type"] == ioc_type]
        assert sorted(got) == sorted(expected), (ioc_type, text)


def test_options(spark):
    texts = spark.createDataFrame(
        [(1, "10.0.0.1 172.15.0.1 172.16.0.1 172.32.0.1 127.0.0.1 0.0.0.0 192.168.1.1 example.com sub.example.com")],
        "i int, content string",
    )
    kept = scan(texts, ["i"], types=["ipv4", "domain"], exclude_private_ips=True, exclude_placeholder_domains=True)
    assert {r["ioc_value"] for r in kept.collect()} == {"172.15.0.1", "172.32.0.1", "sub.example.com"}


def test_whole_ipv6(spark):
    texts = spark.createDataFrame(
        [(1, "fe80::1 [2001:db8::8:1]:80 ::1 1:2:3:4:5:6:7:8 12345::1 a::b::c 1:2:3:4:5:6:7:8::9")], "i int, content string"
    )
    got = {r["ioc_value"] for r in scan(texts, ["i"], types=["ipv6"], rules=WHOLE_IPV6_RULES).collect()}
    assert got == {"fe80::1", "2001:db8::8:1", "::1", "1:2:3:4:5:6:7:8"}


def test_own_rule(spark):
    """A rule may span white space when it asks for the whole text."""
    rule = PatternRule(
        "phrase", lambda text: F.regexp_extract_all(text, F.lit("top secret"), F.lit(0)), candidates_only=False
    )
    texts = spark.createDataFrame([(1, "this is top secret at 1.2.3.4")], "i int, content string")
    got = {(r["ioc_type"], r["ioc_value"]) for r in scan(texts, ["i"], rules=(*DEFAULT_RULES, rule)).collect()}
    assert got == {("phrase", "top secret"), ("ipv4", "1.2.3.4")}


PIECES = [
    "a", "b", "evil", "com", "co", "org", "museum", "muſeum", "io", "1", "12", "255", "256", "001", "10", "0", "1.2.3.4",
    "10.0.0.", ".", ".", ".", "-", "_", "@", "@", ":", ":", "::", "/", "://", "http", "HTTPS", "httpſ", "é", "K",
    "ſ", " ", "\n", "\t", "\x0b", "%", "+", "(", ")", "<", '"', "ffff", "FFFF", "dead", "BEEF", "abcd", "x" * 61, "y" * 63,
    "fe80", "f" * 32, "0" * 40, "a1b2c3d4" * 4, "A1B2C3D4" * 5, "a1b2c3d4" * 8, "!", ",", ";", "xyz", "日本",
    "\U0001f600", "{", "^", "|",
]


def expected_by_linear_engine(path):
    p = {name: "'" + pattern.replace("'", "''") + "'" for name, pattern in oracle_patterns().items()}

    def every(name):
        return f"regexp_extract_all(content, {p[name]})"

    per_type = {
        "ipv4": (every("ipv4"), "v", "NOT regexp_matches(v, '(^|\\.)0[0-9]')"),
        "ipv6": (f"list_concat({every('ipv6_full')}, {every('ipv6_compressed')})", "v",
                 f"NOT regexp_matches(v, {p['ipv6_mapped']})"),
        "domain": (every("domain"), "lower(v)", "true"),
        "url": (every("url"), "rtrim(v, '.,;:!?)')", "true"),
        "email": (every("email"), "lower(v)", "true"),
        **{h: (every(h), "lower(v)", "NOT regexp_matches(lower(v), '^(f+|0+)$')") for h in ("md5", "sha1", "sha256")},
    }
    sql = " UNION ALL ".join(
        f"SELECT DISTINCT i, '{name}' AS t, {value} AS v FROM (SELECT i, unnest({found}) AS v FROM '{path}') WHERE {keep}"
        for name, (found, value, keep) in per_type.items()
    )
    return set(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_linear_engine(spark, tmp_path, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40))) for _ in range(20_000)]
    path = str(tmp_path / "texts.parquet")
    pd.DataFrame({"i": range(len(texts)), "content": texts}).to_parquet(path)
    frame = spark.read.parquet(path).repartition(8)
    got = [tuple(r) for r in scan(frame, ["i"]).select("i", "ioc_type", "ioc_value").collect()]
    want = expected_by_linear_engine(path)
    assert len(got) == len(set(got))
    assert set(got) == want
    counts = {r["i"]: r["ioc_count"] for r in with_ioc_count(frame).select("i", "ioc_count").collect()}
    assert sum(counts.values()) == len(want) and len(counts) == len(texts)


def test_reduced_ipv6_form_matches_the_long_one():
    """The three compressed forms searched for find what all nine lengths of prefix and suffix would."""
    h = "[0-9a-fA-F]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    forms = [  # fixed values: the nine forms of compressed addresses
        f"\\b(?:{h}:){{1,7}}:",
        f"(?:{h}:){{1,6}}:{h}",
        f"(?:{h}:){{1,5}}(?::{h}){{1,2}}",
        f"(?:{h}:){{1,4}}(?::{h}){{1,3}}",
        f"(?:{h}:){{1,3}}(?::{h}){{1,4}}",
        f"(?:{h}:){{1,2}}(?::{h}){{1,5}}",
        f"{h}:(?::{h}){{1,6}}",
        f":(?::{h}){{1,7}}",
        f"::(?:[fF]{{4}}:)?(?:{octet}\\.){{3}}{octet}\\b",
    ]
    rnd = random.Random(3)
    pieces = [":", ":", "::", "1", "ab", "ffff", "12345", "g", " ", "1.2.3.4", "."]
    texts = pd.DataFrame({"t": ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(50_000)]})
    con = duckdb.connect()
    con.register("texts", texts)
    differing = con.execute(
        "SELECT count(*) FROM texts WHERE regexp_extract_all(t, $a) IS DISTINCT FROM regexp_extract_all(t, $b)",
        {"a": "|".join(forms), "b": oracle_patterns()["ipv6_compressed"]},
    ).fetchone()
    assert differing == (0,)


def test_lines_scan_like_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat_ws("\n", "url", "html").alias("content"))
    lines = docs.select("page_id", F.explode(F.split("content", "\n")).alias("content"))
    whole = {tuple(r) for r in scan(docs, ["page_id"]).collect()}
    split = [tuple(r) for r in scan(lines, ["page_id"], whole_keys=False).collect()]
    assert whole and set(split) == whole and len(split) == len(whole)


@pytest.mark.parametrize(
    "unit", ["1.", "a.", "a@", "a.a@", "ab:", "::", "f", "a-.", "http://", "x ", ".", "_a.", "a%", "1.2.3.4,", "."]
)
def test_long_hostile_texts(spark, unit):
    """A megabyte of one repeated unit neither overflows the stack nor takes quadratic time."""
    texts = spark.createDataFrame([(1,)], "i int").select("i", F.repeat(F.lit(unit), 1_000_000 // len(unit)).alias("content"))
    start = time.perf_counter()
    scan(texts, ["i"]).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 20


def test_bad_utf8_does_not_fail(spark):
    """Bytes that are no UTF-8 become U+FFFD before matching; only a URL can hold them."""
    texts = spark.createDataFrame([(1, bytearray(b"\xff\xfe 1.2.3.4 http://a.b/\xff"))], "i int, b binary").select(
        "i", F.col("b").cast("string").alias("content")
    )
    got = {(r["ioc_type"], r["ioc_value"]) for r in scan(texts, ["i"], types=["ipv4", "url"]).collect()}
    assert got == {("ipv4", "1.2.3.4"), ("url", "http://a.b/�")}
