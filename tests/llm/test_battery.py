"""The secret scan's battery against an independent one in plain Python, on planted secrets and on the small tables."""

import math
import random
import re
import string
import time
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import secrets

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
LETTERS = dict(zip(string.ascii_lowercase, (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)))
FIRST = {"lower": 0.5, "upper": 0.25, "digit": 0.2, "other": 0.05}
NEXT = {"lower": (0.9, 0.02, 0.03, 0.05), "upper": (0.45, 0.43, 0.06, 0.06), "digit": (0.12, 0.06, 0.7, 0.12), "other": (0.62, 0.14, 0.18, 0.06)}


def log_erfc(x):
    """Logarithm of the complementary error function, by its asymptotic series where it underflows."""
    if x < 20:
        return math.log(math.erfc(x))
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-1 / (2 * x * x) + 3 / (4 * x**4))


def text_log_chance(token):
    total, before = 0.0, None
    for c in token:
        kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"
        total += math.log(FIRST[kind] if before is None else NEXT[before][list(FIRST).index(kind)])
        total += math.log(0.8 * LETTERS[c.lower()] / 100 + 0.2 / 26) if c.isalpha() else -math.log(10 if kind == "digit" else 5)
        before = kind
    return total


def encoding(token):
    if re.fullmatch("[0-9a-fA-F]+", token):
        return token.upper(), "0123456789ABCDEF"
    bare = token.rstrip("=")
    if bare and re.fullmatch("[A-Z2-7]+|[a-z2-7]+", bare):
        return bare.upper(), string.ascii_uppercase + "234567"
    if bare and re.fullmatch("[A-Z0-9]+|[a-z0-9]+", bare):
        return bare.upper(), string.digits + string.ascii_uppercase
    return token.replace("-", "+").replace("_", "/").replace("=", ""), BASE64


def bin_of(token, level=0.05):
    plain, abc = encoding(token)
    if len(plain) < 2:
        return 0
    m, n, x = len(abc), len(plain), [abc.index(c) for c in plain]
    chi = sum((plain.count(c) - n / m) ** 2 / (n / m) for c in abc)
    v = 2 / (9 * (m - 1))
    z = ((chi / (m - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v)
    even = log_erfc(z / math.sqrt(2)) - math.log(2)
    up = [i >= m / 2 for i in x]
    a, b = sum(up), n - sum(up)
    runs = 1 + sum(p != q for p, q in zip(up, up[1:]))
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1)) if n > 1 else 0
    z = (runs - 2 * a * b / n - 1) / math.sqrt(var) if var > 0 else 10.0
    tests = [even, log_erfc(abs(z) / math.sqrt(2))]
    mean = (m - 1) / 2
    z = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / (math.sqrt(n - 1) * (m * m - 1) / 12)
    tests.append(log_erfc(abs(z) / math.sqrt(2)))
    random_p = min(0.0, min(tests) + math.log(3))
    bare = token.rstrip("=")
    ratio = -text_log_chance(bare) - len(bare) * math.log(m) - math.log(8) + min(0.0, random_p - math.log(level))
    return min(int(max(0.0, ratio) * 10 / math.log(10)), 3000)


def discoveries(rows, rate=0.01):
    """Spans of kind random of each row, by Benjamini and Hochberg over the distinct tokens of each class of lengths."""
    spans = {i: [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or "")] for i, t in rows}
    classes = defaultdict(dict)
    for found in spans.values():
        for _, _, token in found:
            classes[sum(len(token) >= e for e in (32, 64, 128))][token] = bin_of(token)
    least = {}
    for k, bins in classes.items():
        for r, x in enumerate(sorted(bins.values(), reverse=True), 1):
            if -x / 10 * math.log(10) <= math.log(rate * r / len(bins)):
                least[k] = x
    return {i: [(a, b) for a, b, t in found if bin_of(t) >= least.get(sum(len(t) >= e for e in (32, 64, 128)), 1 << 30)] for i, found in spans.items()}


def planted(rng):
    """Secrets that none of the three patterns matches, each within prose."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    forms = {
        "bearer": lambda: "Authorization: Bearer " + pick(BASE64, rng.randint(32, 60)),
        "url": lambda: f"https://host.example/hook?k={pick(string.ascii_letters + string.digits, 40)}&v=1",
        "base32": lambda: "otp seed " + pick(string.ascii_uppercase + "234567", 32),
        "upper_hex": lambda: "key id " + pick("0123456789ABCDEF", 40),
        "pem": lambda: "-----BEGIN KEY----- " + pick(BASE64, 64) + " " + pick(BASE64, 64),
    }
    words = "the order market price report river stone window paper summer history number people model table garden value light water".split()
    rows = []
    for form, make in forms.items():
        rows += [(form, " ".join(rng.choices(words, k=30)) + " " + make() + " " + " ".join(rng.choices(words, k=30))) for _ in range(60)]
    for _ in range(3000):
        path = rng.choice(["/", "-", "_"]).join(rng.choices(words, k=rng.randint(4, 9)))
        rows.append(("clean", " ".join(rng.choices(words, k=20)) + " " + path + rng.choice(["", f"/{rng.randint(0, 10**6)}", "-v2"])))
    return rows


def test_spans_equal_those_of_an_independent_battery(spark):
    made = planted(random.Random(11))
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + [(10**6 + i, t) for i, (_, t) in enumerate(made)]
    rows += [(2 * 10**6, "A" * 300), (2 * 10**6 + 1, "=" * 40), (2 * 10**6 + 2, "a" * 20 + "=" * 9), (2 * 10**6 + 3, "0" * 50), (2 * 10**6 + 4, "ab" * 5000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "spans").collect()}
    want = discoveries(rows)
    assert got == want
    found = defaultdict(list)
    for i, (form, _) in enumerate(made):
        found[form].append(bool(got[10**6 + i]))
    assert not any(found.pop("clean"))
    assert {form: sum(f) for form, f in found.items() if sum(f) < 0.95 * len(f)} == {}


def test_tails_hold_in_logarithms(spark):
    zs = [-9.0, -3.0, -0.5, 0.0, 0.1, 1.0, 3.0, 6.0, 8.0, 15.0, 40.0, 200.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(secrets.log_tail(F.col("z"), 1).alias("one"), secrets.log_tail(F.col("z"), 2).alias("two")).collect()
    for z, r in zip(zs, got):
        assert abs(r.two - log_erfc(abs(z) / math.sqrt(2))) < 1e-6
        one = log_erfc(z / math.sqrt(2)) - math.log(2) if z > 0 else math.log1p(-math.erfc(-z / math.sqrt(2)) / 2)
        assert abs(r.one - one) < 1e-6


def test_p_values_hold_for_random_tokens(spark):
    """Of random tokens, the combined battery rejects at most about the share that it says."""
    rng = random.Random(2)
    for chars, n in ((BASE64, 40), ("0123456789ABCDEF", 64), (string.ascii_uppercase + "234567", 24)):
        rows = [("".join(rng.choice(chars) for _ in range(n)),) for _ in range(2000)]
        got = secrets.battery(spark.createDataFrame(rows, "token string").where("length(token) > 0")).select(F.least("even", "runs", "serial").alias("p")).collect()
        assert sum(r.p < math.log(0.05 / 3) for r in got) < 0.08 * len(got)


def test_one_document_of_many_tokens(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "é short"), (3, None)], SCHEMA)
    began = time.time()
    got = {r.doc_id: r for r in secrets.redact(secrets.find_secrets(df)).collect()}
    assert time.time() - began < 60
    assert [s.start for s in got[1].base_spans] == list(range(0, 33 * 20_000, 33)) and len(got[1].spans) >= 20_000
    assert got[1].text == " ".join([secrets.MARK] * 20_000) and got[2].text == "é short" and got[3].text is None


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(planted(random.Random(5)))]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    monkeypatch.setattr(secrets, "BROADCAST_SPANS", 0)
    assert {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()} == one
