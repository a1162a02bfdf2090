"""Names, keys and aliases as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "")


def unicode_key(c: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]", "")


def slug(c: Column) -> Column:
    """Runs of other characters become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def _plural(w: Column) -> Column:
    return (F.length(w) >= 4) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss"))


def _drop(w: Column, n: int, add: str = "") -> Column:
    return F.concat(F.left(w, F.length(w) - n), F.lit(add))


def singular(w: Column) -> Column:
    """Singular of a lower-case word: words under four letters and those in ss stay."""
    return (
        F.when((F.length(w) < 4) | F.endswith(w, F.lit("ss")), w)
        .when(F.endswith(w, F.lit("ies")), _drop(w, 3, "y"))
        .when(F.endswith(w, F.lit("boxes")), _drop(w, 5, "box"))
        .when(w.rlike("(ches|shes)$"), _drop(w, 2))
        .when(F.endswith(w, F.lit("s")), _drop(w, 1))
        .otherwise(w)
    )


def identity(c: Column) -> Column:
    """All words singular, joined."""
    return F.array_join(F.transform(words(c), singular), "")


def alias(c: Column) -> Column:
    """One loose form of a name: & is and, plural ends go, other characters go. The steps are fixed values."""
    t = F.regexp_replace(F.trim(F.lower(_text(c))), "&", "and")
    return reduce(lambda x, p: F.regexp_replace(x, *p), (("bunnies", "bunny"), (r"ies\b", "y"), (r"s\b", ""), ("[^a-z0-9]+", "")), t)


def trait_clean(c: Column) -> Column:
    """Alias of a trait without a trailing remark in brackets."""
    return alias(F.regexp_replace(_text(c), r"\s*\([^)]*\)\s*$", ""))


def _filled(keys: Column) -> Column:
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def alias_keys(c: Column) -> Column:
    """Lookup keys in order: the name, each word shortened or made singular alone, all shortened, all singular."""
    ws = words(c)
    at = lambda i, f: F.array_join(F.transform(ws, lambda w, j: F.when(j == i, f(w)).otherwise(w)), "")
    short = lambda w: F.when(_plural(w), _drop(w, 1)).otherwise(w)
    single = F.flatten(F.transform(ws, lambda w, i: F.array(at(i, short), at(i, singular))))
    both = F.array(F.array_join(F.transform(ws, short), ""), F.array_join(F.transform(ws, singular), ""))
    return _filled(F.concat(F.array(key(c)), single, both))


def _product(ws: Column, variants) -> Column:
    """Every choice of a variant per word, joined; their number is the product of the words' variants."""
    grown = F.aggregate(ws, F.array(F.lit("")), lambda acc, w: F.flatten(F.transform(acc, lambda p: F.transform(variants(w), lambda v: F.concat(p, v)))))
    return F.when(F.size(ws) > 0, grown).otherwise(F.array().cast("array<string>"))


def registry_alias_keys(c: Column) -> Column:
    """The name's key, then the product over words of the word, its singular and, for words not in s, its plural."""

    def variants(w: Column) -> Column:
        grown = F.when((F.length(w) >= 3) & ~F.endswith(w, F.lit("s")), F.concat(w, F.lit("s"))).otherwise(w)
        return F.array_distinct(F.array(w, singular(w), grown))

    ws = words(c)
    return F.when(F.size(ws) > 0, _filled(F.concat(F.array(key(c)), _product(ws, variants)))).otherwise(F.array().cast("array<string>"))


def signature_keys(c: Column) -> Column:
    """Product over words of every singular form that its ending allows; no plurals added."""

    def variants(w: Column) -> Column:
        ends = ((F.endswith(w, F.lit("ies")), _drop(w, 3, "y")), (F.endswith(w, F.lit("boxes")), _drop(w, 5, "box")), (w.rlike("(ches|shes)$"), _drop(w, 2)), (F.endswith(w, F.lit("s")), _drop(w, 1)))
        fixed = (F.length(w) < 4) | F.endswith(w, F.lit("ss"))
        return F.array_distinct(F.array(w, *[F.when(~fixed & test, form).otherwise(w) for test, form in ends]))

    return _filled(_product(words(c), variants))


def alias_matches(keys: Column, value: Column) -> Column:
    """True if a value's alias is among the aliases of ``keys``."""
    return (alias(value) != "") & F.array_contains(F.transform(keys, alias), alias(value))


def alias_includes(keys: Column, value: Column) -> Column:
    """True if a value's alias holds, or is held by, one of the aliases of ``keys``."""
    v = alias(value)
    return (v != "") & F.exists(_filled(F.transform(keys, alias)), lambda k: F.contains(k, v) | F.contains(v, k))


def name_variants(name: Column, others: Column) -> Column:
    """At most four names to try: the name, others, without and with a final s."""
    tries = F.concat(F.array(name), others, F.array(F.regexp_replace(name, "(?i)s$", ""), F.concat(name, F.lit("s"))))
    return F.slice(F.array_distinct(F.filter(F.transform(tries, F.trim), lambda v: (v != "") & ~F.contains(v, F.lit(":")) & (F.length(v) < 80))), 1, 4)


def combo_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[key(p) for p in parts])


#: Families of backdrop colours and the words that tell them, first match wins.
FAMILIES = (
    ("dark", "black|onyx|noir|midnight|night|dark|obsidian|charcoal|carbon|eclipse|shadow|void|raven"),
    ("gold", "gold|golden|yellow|amber|honey|lemon|sun|solar|champagne"),
    ("light", "white|ivory|snow|pearl|cream|silver|platinum|diamond"),
    ("warm", "red|rose|ruby|coral|crimson|scarlet|pink"),
    ("green", "green|emerald|jade|mint|lime|olive|pistachio|shamrock"),
    ("blue", "blue|azure|aqua|cyan|teal|sky|navy|sapphire"),
    ("purple", "purple|violet|lilac|lavender|amethyst|indigo"),
)


def first_rule(text: Column, rules, default: str = "") -> Column:
    """Label of the first rule (label, pattern) whose pattern is found."""
    out = F.lit(default)
    for label, pattern in reversed(list(rules)):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def family(backdrop: Column) -> Column:
    return first_rule(alias(backdrop), FAMILIES)


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")), _text(c))


def html_metric(html: Column, label: str, gap: int = 120) -> Column:
    """First number within ``gap`` characters after a label, thousands separators removed."""
    found = F.regexp_extract(_text(html), f"(?is){label}.{{0,{gap}}}?([0-9][0-9,]*(?:\\.[0-9]+)?)", 1)
    return F.replace(found, F.lit(",")).try_cast("double")


def short_address(c: Column) -> Column:
    return F.when(F.length(c) > 12, F.concat(F.left(c, F.lit(6)), F.lit("..."), F.right(c, F.lit(4)))).otherwise(c)


def media_kind(url: Column) -> Column:
    path = F.lower(F.regexp_replace(_text(url), r"[?#].*$", ""))
    return first_rule(path, (("video", r"\.(mp4|webm|mov|m4v)$"), ("lottie", r"\.(json|tgs|lottie)$"), ("image", r"\.(png|jpe?g|gif|webp|svg|avif)$")))


def compact_number(c: Column) -> Column:
    """1.2K, 3.4M, 5.6B."""
    size = F.abs(c)
    out = F.format_number(c, 2)
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(size >= limit, F.concat(F.format_string("%.2f", c / limit), F.lit(unit))).otherwise(out)
    return out


def signed_percent(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string("%.2f%%", c))
