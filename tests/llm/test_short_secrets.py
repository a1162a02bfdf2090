"""The battery on short tokens of each encoding, few among many of text."""

import random
import string

from tidemark.llm import secrets

CHARS = {"base64": secrets.ENCODINGS["base64"][1], "base32": string.ascii_uppercase + "234567", "lower_base32": string.ascii_lowercase + "234567", "lower_base36": string.ascii_lowercase + string.digits, "upper_hex": "0123456789ABCDEF"}
WORDS = "the order market price report of and river stone window paper summer history number of people model table garden value light water".split()


def recall(spark, copies=1):
    """Share found by encoding and length, and the share of text tokens taken for secrets."""
    rng = random.Random(7)
    rows, what = [], {}
    for i in range(8000):
        ws, sep = [rng.choice(WORDS) for _ in range(6)], rng.choice(["/", "_", "-", ""])
        text = sep.join(w.capitalize() if sep == "" else w for w in ws) + rng.choice(["", "", str(rng.randrange(3000))])
        rows.append((i, "see " + text + " now"))
        what[i] = "text" if len(text) >= 20 else None
    for name, chars in CHARS.items():
        for n in (20, 24, 31, 32, 40):
            for _ in range(40):
                i = len(rows)
                rows.append((i, "see " + "".join(rng.choice(chars) for _ in range(n)) + " now"))
                what[i] = (name, n)
    docs = [r for r in rows for _ in range(copies if what[r[0]] == "text" else 1)]
    got, seen = {}, {}
    for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "spans").collect():
        k = what[r.doc_id]
        seen[k] = seen.get(k, 0) + 1
        got[k] = got.get(k, 0) + any(s.kind == 3 for s in r.spans)
    return {k: got[k] / seen[k] for k in seen if k}


def test_short_random_tokens_are_found_among_text(spark):
    found = recall(spark)
    assert found.pop("text") <= 0.001
    assert min(found.values()) >= 0.8, found


def test_copies_of_text_do_not_alter_the_cut(spark):
    assert recall(spark, copies=5) == recall(spark)
