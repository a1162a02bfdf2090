"""Secret scans in DataFrame functions only: named patterns, and a battery of randomness tests over token-like strings.

The battery takes each distinct candidate token once, infers its encoding, and tests how evenly it uses the alphabet
(chi-squared), how often it crosses the alphabet's middle (runs) and how its neighbours correlate. The three p-values are
combined (Bonferroni, as runs and correlation depend on each other). What a discovery must reject is that the token is
text: its evidence is the likelihood ratio of the encoding's uniform model to a text model, taken down by as much as the
combined battery p falls below ``level``. As that only lowers the ratio, its inverse is a p-value under the text model
(Markov's inequality), and it is held to a false-discovery rate within each class of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: The patterns of the three named kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in order of inference: pattern and alphabet (letters of one case count as upper case in all but base64).
ENCODINGS = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789ABCDEF"),
    "base32": (r"^([A-Z2-7]+|[a-z2-7]+)=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": (r"^([A-Z0-9]+|[a-z0-9]+)=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: The text model: chances of the class of the first character and of each next one (lower, upper, digit, other), and
#: shares of letters in percent, mixed with even ones; digits and others are even within their class.
CLASSES = "LUDS"
FIRST = (0.50, 0.25, 0.20, 0.05)
NEXT = ((0.90, 0.02, 0.03, 0.05), (0.45, 0.43, 0.06, 0.06), (0.12, 0.06, 0.70, 0.12), (0.62, 0.14, 0.18, 0.06))
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1), strict=True))
EVEN = 0.2
#: The encoding is chosen after the token is seen: as many alphabets, counting cases apart, share a chance of one.
CHOICES = 8
MARK = "[SECRET]"
#: Lengths at which a class of the discovery control ends; bins of a p-value (tenths of -log10) up to the last.
LENGTH_CLASSES, BINS = (32, 64, 128), 3000
#: Spans of 40 bytes that may be broadcast, once counted; beyond it they are joined by a shuffle.
BROADCAST_SPANS = 200_000
#: Chebyshev fit of the complementary error function, whose relative error is under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Elements of an array that are scanned one by one; longer arrays are scanned in chunks, so the work isn't quadratic.
_CHUNK = 128


def running(values: Column, joined: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running sum, maximum or the like of an array column of ints: chunks are scanned, then joined with all before them.

    ``values`` should be a plain column, as it is read element by element.
    """
    empty = F.expr("cast(array() as array<int>)")

    def scan(xs: Column) -> Column:
        start = F.struct(empty.alias("out"), F.lit(zero).alias("last"))

        def step(acc: Column, x: Column) -> Column:
            now = joined(acc["last"], x)
            return F.struct(F.concat(acc["out"], F.array(now)).alias("out"), now.alias("last"))

        return F.aggregate(xs, start, step)

    count = F.ceil(F.size(values) / _CHUNK).cast("int")
    done = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: scan(F.transform(F.sequence(i * _CHUNK, F.least(F.size(values), (i + 1) * _CHUNK) - 1), lambda j: F.get(values, j)))))

    def spread(acc: Column, c: Column) -> Column:
        all_out = F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: joined(acc["last"], x))))
        return F.struct(all_out.alias("out"), joined(acc["last"], c["last"]).alias("last"))

    none = F.struct(F.expr("cast(array() as array<array<int>>)").alias("out"), F.lit(zero).alias("last"))
    done = F.coalesce(done, F.expr("cast(array() as array<struct<out:array<int>,last:int>>)"))
    return F.flatten(F.aggregate(done, none, spread)["out"])


def with_matches(docs: DataFrame, text: Column, pattern: str, name: str, group: int = 0) -> DataFrame:
    """``docs`` with ``name``: leftmost non-overlapping matches as array of (start, end, value), in code points; value is ``group``.

    Matches lie between the pieces that splitting by the same pattern gives, so positions are running lengths. Each step is
    a projection of its own, so nothing is computed twice.
    """
    none = F.expr("cast(array() as array<string>)")
    hit = text.rlike(pattern)
    out = docs.withColumn("__m", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    out = out.withColumn("__v", F.when(F.size("__m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("__m"))
    out = out.withColumn("__g", F.when(F.size("__m") > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.expr("cast(array() as array<int>)")))
    out = out.withColumn("__l", F.transform("__m", F.length))
    out = out.withColumn("__d", F.zip_with(F.slice("__g", 1, F.size("__l")), "__l", lambda g, n: g + n))
    out = out.withColumn("__s", running(F.col("__d"), lambda a, b: a + b, 0))
    row = lambda x: F.struct((x["e"] - x["l"]).alias("start"), x["e"].alias("end"), x["v"].alias("value"))
    found = F.transform(F.arrays_zip(F.col("__s").alias("e"), F.col("__l").alias("l"), F.col("__v").alias("v")), row)
    return out.withColumn(name, found).drop("__m", "__v", "__g", "__l", "__d", "__s")


def text_surprise(chars: Column) -> Column:
    """Minus the logarithm of the chance of an array of characters under the text model, by a table for each character and for each pair of classes."""
    lower, upper = "".join(LETTERS), "".join(LETTERS).upper()
    spell = [-math.log((1 - EVEN) * LETTERS[c.lower()] / 100 + EVEN / 26) for c in lower + upper] + [math.log(10)] * 10 + [math.log(5)] * 5
    symbols = F.lit(lower + upper + "0123456789+/=_-")
    classes = F.lit("L" * 26 + "U" * 26 + "D" * 10 + "S" * 5)
    emitted, start, moved = F.array(*map(F.lit, spell)), F.array(*[F.lit(-math.log(p)) for p in FIRST]), F.array(*[F.lit(-math.log(p)) for row in NEXT for p in row])
    kind = lambda c: F.instr(F.lit(CLASSES), F.substring(classes, F.instr(symbols, c), 1)) - 1

    def step(acc: Column, c: Column) -> Column:
        k = kind(c)
        cost = F.when(acc["last"] < 0, F.get(start, k)).otherwise(F.get(moved, acc["last"] * len(CLASSES) + k))
        return F.struct((acc["cost"] + F.get(emitted, F.instr(symbols, c) - 1) + cost).alias("cost"), k.alias("last"))

    return F.aggregate(chars, F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("last")), step)["cost"]


def log_tail(z: Column, sides: int) -> Column:
    """Natural logarithm of the chance that a normal value lies beyond z (one side), or beyond -z and z (two), in all tails."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + F.lit(c)
    both = F.log(t) - x * x + poly
    return F.least(both, F.lit(0.0)) if sides == 2 else F.when(z > 0, both - math.log(2)).otherwise(F.log1p(-F.exp(both - math.log(2))))


def battery(tokens: DataFrame) -> DataFrame:
    """Rows (token) with even, runs and serial: the tests' logarithmic p-values for the inferred encoding; and m, its symbols.

    Evenness is one-sided, by the Wilson-Hilferty cube root; runs about the alphabet's middle and the correlation of
    neighbours are two-sided. Runs that can't be judged, as all symbols lie in one half, count as ten deviations off; tests of
    under two symbols are null.
    """
    name = F.lit(None).cast("string")
    for encoding, (pattern, _) in reversed(ENCODINGS.items()):
        name = F.lit(encoding) if not pattern else F.when(F.col("token").rlike(pattern), encoding).otherwise(name)
    alphabet = F.create_map(*[F.lit(x) for k, (_, a) in ENCODINGS.items() for x in (k, a)])
    plain = F.when(F.col("encoding") == "base64", F.translate("token", "-_=", "+/")).otherwise(F.translate(F.upper("token"), "=-_", ""))
    rows = tokens.withColumn("encoding", name).withColumn("abc", F.element_at(alphabet, F.col("encoding"))).withColumn("plain", plain)
    rows = rows.withColumns({"m": F.length("abc").cast("double"), "n": F.when(F.length("plain") > 1, F.length("plain")).cast("double"), "x": F.transform(F.split("plain", ""), lambda c: F.instr(F.col("abc"), c) - 1)})
    rows = rows.withColumn("x", F.filter("x", lambda v: v >= 0))
    counts = F.transform(F.split("abc", ""), lambda c: F.when(c == "", 0.0).otherwise((F.col("n") - F.length(F.replace(F.col("plain"), c))).cast("double")))
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumns({"same": F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c), "pairs": pairs})
    m, n, half, mean = F.col("m"), F.col("n"), F.col("m") / 2, (F.col("m") - 1) / 2
    rows = rows.withColumns({
        "high": F.size(F.filter("x", lambda v: v >= half)).cast("double"),
        "turns": F.size(F.filter("pairs", lambda p: (p["a"] >= half) != (p["b"] >= half))).cast("double"),
        "cross": F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)),
    })
    ratio = (F.col("same") * m / n - n) / (m - 1)
    both = 2 * F.col("high") * (n - F.col("high"))
    z_even = (F.cbrt(ratio) - (1 - 2 / (9 * (m - 1)))) / F.sqrt(2 / (9 * (m - 1)))
    z_runs = F.when((both > n) & (n > 1), (F.col("turns") - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(10.0))
    z_serial = F.col("cross") / (F.sqrt(n - 1) * (m * m - 1) / 12)
    zs = rows.select("token", "m", z_even.alias("z_even"), z_runs.alias("z_runs"), z_serial.alias("z_serial"))
    return zs.select("token", "m", log_tail(F.col("z_even"), 1).alias("even"), log_tail(F.col("z_runs"), 2).alias("runs"), log_tail(F.col("z_serial"), 2).alias("serial"))


def judged(tokens: DataFrame, level: float) -> DataFrame:
    """Distinct tokens to rows (token, stratum, bin): the class of lengths, and ten times -log10 of the p-value, rounded down."""
    chars = F.filter(F.split(F.regexp_replace("token", "=+$", ""), ""), lambda c: c != "")
    tested = battery(tokens).withColumn("random", F.least(F.lit(0.0), F.least("even", "runs", "serial") + math.log(3))).withColumn("chars", chars)
    tested = tested.withColumn("surprise", text_surprise(F.col("chars")))
    ratio = F.col("surprise") - F.size("chars") * F.log("m") - math.log(CHOICES) + F.least(F.lit(0.0), F.col("random") - math.log(level))
    n = F.length("token")
    stratum = sum((F.when(n >= edge, 1).otherwise(0) for edge in LENGTH_CLASSES), F.lit(0))
    tenths = F.least(F.floor(F.greatest(ratio, F.lit(0.0)) * (10 / math.log(10))), F.lit(BINS)).cast("int")
    return tested.select("token", stratum.alias("stratum"), tenths.alias("bin"))


def discovery_bins(candidates: DataFrame, rate: float) -> DataFrame:
    """Rows (stratum, bin) to a row (stratum, least) for each stratum: the least bin that Benjamini-Hochberg accepts.

    p-values are rounded up to their bin's edge, which only makes it stricter; a stratum has at most BINS + 1 bins.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = counts.select("stratum", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    ok = ranked.where(F.col("bin") * (-math.log(10) / 10) <= math.log(rate) + F.log(F.col("rank") / F.col("m")))
    return ok.groupBy("stratum").agg(F.min("bin").alias("least"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def random_spans(docs: DataFrame, text: Column, rate: float, level: float) -> DataFrame:
    """Rows (k1, k2, found) for each distinct text with discoveries: its two hashes and its spans of kind 3."""
    k1, k2 = F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)
    matched = with_matches(docs.where(text.rlike(TOKEN)).select(text.alias("__text"), k1.alias("k1"), k2.alias("k2")), F.col("__text"), TOKEN, "__t")
    # Each text has a token; a plain explode would test that again, with all that leads to the array computed anew.
    tokens = cut(matched.select("k1", "k2", F.explode_outer("__t").alias("t")).select("k1", "k2", "t.start", "t.end", F.col("t.value").alias("token")).distinct())
    found = cut(judged(tokens.select("token").distinct(), level))
    least = discovery_bins(found, rate)  # a row per class of lengths
    accepted = found.join(F.broadcast(least), "stratum").where("bin >= least").select("token")
    span = F.struct(F.col("start"), F.lit(3).alias("kind"), F.col("end"))
    return tokens.join(accepted, "token").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("found"))


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.01, level: float = 0.05) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, kind, end) by start, then kind; kind is an index into KINDS.

    Null texts are empty ones and have none. Whole texts are searched; copies get equal spans, and each distinct token
    counts once in the discovery control, whose rate is ``rate``. A token that the battery finds less random than ``level``
    loses evidence in proportion. Columns of these names are replaced; no rows give none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.drop("base_spans", "spans")
    found = cut(random_spans(base, text, rate, level))
    many = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] > BROADCAST_SPANS
    out = base
    for kind, (name, pattern, group) in enumerate((("__assign", ASSIGN, 2), ("__access", ACCESS, 0), ("__hex", HEX, 0))):
        out = with_matches(out, text, pattern, name, group)
    kinded = lambda name, kind: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    out = out.withColumn("__assign", F.filter("__assign", lambda s: F.length(s["value"]) >= 6))
    out = out.withColumn("base_spans", F.sort_array(F.concat(kinded("__assign", 0), kinded("__access", 1), kinded("__hex", 2)))).drop("__assign", "__access", "__hex")
    keyed = out.withColumns({"__k1": F.xxhash64(F.lit(1), text), "__k2": F.xxhash64(F.lit(2), text)})
    more = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("found").alias("__found"))
    with_random = keyed.join(more if many else F.broadcast(more), ["__k1", "__k2"], "left")
    all_spans = F.when(F.col("__found").isNull(), F.col("base_spans")).otherwise(F.sort_array(F.concat("base_spans", "__found")))
    return with_random.withColumn("spans", all_spans).drop("__k1", "__k2", "__found")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Texts with each maximal stretch of overlapping spans replaced by MARK; a null text stays null.

    Stretches are cut out of chunks of the text, so the work grows with the text, not with the text times the spans.
    """
    some, size = F.size(spans_col) > 0, 256
    work = docs.withColumn("__t", F.when(some, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))).withColumn("__b", F.transform(spans_col, lambda s: s["end"]))
    work = work.withColumn("__e", F.when(some, running(F.col("__b"), F.greatest, 0)))
    rows = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("__e", 1, F.size("__e") - 1)).alias("before"), F.col(spans_col)["start"].alias("start"))
    work = work.withColumn("__f", F.when(some, F.filter(rows, lambda r: r["start"] >= r["before"])))

    def piece(a: Column, b: Column) -> Column:
        whole = F.array_join(F.transform(F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int")), lambda i: F.coalesce(F.get("__t", i), F.lit(""))), "")
        return F.substring(whole, F.pmod(a, F.lit(size)) + 1, b - a)

    parts = F.transform("__f", lambda r: F.concat(piece(r["before"], r["start"]), F.lit(MARK)))
    out = F.concat(F.array_join(parts, ""), piece(F.element_at("__e", -1), F.length(text_col)))
    return work.withColumn(text_col, F.when(some, out).otherwise(F.col(text_col))).drop("__t", "__b", "__e", "__f")
