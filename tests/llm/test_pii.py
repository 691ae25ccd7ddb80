"""Personal data against Python's regular expressions and plain checksums."""

import hashlib
import random
import re

import pytest

from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    return kind == "email" or (16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    alphabet = "aZ09.@+-_% ()\n\tß😀1234567"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    pieces = ["a@b.c", "a@b.c.@d.e", "x@y-z.com+q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "00255.0.0.256", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111 1111 1112", "+49 (30) 1234-567", "+1", "+12345678", "é", "𝕏", ".", " "]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    long = ["x" * 5000, "1" * 5000, "1 " * 60_000, "+1" + " " * 150_000, "a@b.c " * 20_000, ".1" * 60_000, "a@" * 50_000, "𝕏 1.2.3.4, " * 5_000, "a@b" + ".c" * 60_000]
    return [None, "", " \n", *noise, *mixed, *long]


def test_base_spans(spark, texts):
    rows = [(n, t, "en", 1) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int").repartition(8)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(docs).collect()}
    names = [k.name for k in pii.BASE]
    assert len(found) == len(texts)
    for n, text in enumerate(texts):
        assert [s for s in found[n] if s[0] in names] == base_spans(text), text and text[:80]
    assert sum(map(len, found.values())) > 1000


def test_long_runs_are_read_once(spark):
    """Patterns as they are written would go over these from each of their characters; Python's do, so what is found is stated."""
    docs = spark.createDataFrame([(1, "x" * 2_000_000), (2, "1" * 2_000_000 + " 1.2.3.4"), (3, "1." * 1_000_000), (4, "x" * 2_000_000 + "@y.z")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert not found[1] and [tuple(s)[:3] for s in found[2]] == [("ip", 2_000_001, 2_000_008)] and len(found[3]) == 250_000 and [tuple(s)[:3] for s in found[4]] == [("email", 0, 2_000_004)]


def test_checksums_and_context(spark):
    cases = [
        ("transfer to DE89 3704 0044 0532 0130 00 today", [("iban", 12, 39)]), ("DE89370400440532013001", []), ("XDE89370400440532013000", []), ("GB82WEST12345698765432 please", [("iban", 0, 22)]),
        ("my amex card 3782 822463 10005.", [("short_card", 13, 30)]), ("number 3782 822463 10005.", []), ("her ssn is 123-45-6789", [("ssn", 11, 22)]), ("part 123-45-6789", []), ("ssn 000-45-6789", []), ("ssn 123-45-67890", []),
        ("call (555) 123-4567 now", [("local", 5, 19)]), ("555 123-4567", []), ("example: call 555 123-4567", []), ("mail a@b.c", [("email", 5, 10)]), ("example a@b.c", [("email", 8, 13)]),
    ]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id long, text string")
    for row in pii.find_pii(docs).collect():
        text, want = cases[row["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == want, text
    scores = {r["doc_id"]: [s["score"] for s in r["spans"]] for r in pii.find_pii(docs).collect()}
    assert scores[13] == [100] and scores[14] == [65]  # context words move the score, and base spans stay


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, None), (None, "a@b.c"), (1, "ip 1.2.3.4 and +49 30 1234567"), (1, "ip 1.2.3.4 and +49 30 1234567"), (2, ""), (3, "𝕏 é a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_ip", "1 AS scores").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.op11_pii(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted((d or 0, *[sum(s[0] == k for s in base_spans(t)) for k in BASE], sha(x := ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t))), x) for d, t in rows)
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_built_in_functions(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = pii.op11_pii(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
