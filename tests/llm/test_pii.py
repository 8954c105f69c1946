import hashlib
import random
import re

from pyspark.sql import functions as F

from foldline.llm import pii
from tests.llm.util import documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(x)) % 10 == 0


def brute(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_against_plain_patterns(spark):
    rng = random.Random(5)
    alphabet = list("aZ09@.+- ()_%é🙂\n") + ["4111 1111 1111 1111", "a.b@c-d.example.com", "1.2.3.4", "10.0.0.256", "+49 (30) 1234-5678", "@x.y", "..", "5500005555555559", "255.", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "x" * 200_000, "1" * 100_000, "1 " * 50_000, "a@" * 20_000, "+1" + "(" * 50_000, "a.b@c.d " * 300, "mail a@b.c", "1.2.3.4.5.6.7.8.9"]
    df = documents(spark, texts)
    for r in pii.pii_digest(df).collect():
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id], r.spans, said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in BASE]
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_added_kinds_need_checksum_or_cue(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32.", "iban GB83 WEST 1234 5698 7654 32.", "my ssn is 123-45-6789", "number 123-45-6789"]
    got = {r.doc_id: r.spans for r in pii.pii_digest(documents(spark, texts)).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:10:21", 3: ""}


def test_account_codes_end_by_their_countrys_length(spark):
    texts = ["to DE89 3704 0044 0532 0130 00 Amount due", "DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000 2 days", "DE893704004405320130002", "ZZ89370400440532013000", "NO9386011117947"]
    got = {r.doc_id: r.spans for r in pii.pii_digest(documents(spark, texts)).collect()}
    assert got == {0: "iban:3:30", 1: "iban:0:22", 2: "iban:0:22", 3: "", 4: "", 5: "iban:0:15"}


def test_very_many_spans_and_columns_with_the_names_of_helpers(spark):
    texts = ["a.b@c.de " * 30_000, "10.0.0.1,a@b.cd;" * 500, None]
    df = documents(spark, texts).select("*", *(F.lit(n).alias(n) for n in ("_spans", "_cut", "_email_m", "_IP_g")))
    out = pii.redact(df)
    assert out.columns == df.columns
    rows = out.orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["[EMAIL] " * 30_000, "[IP],[EMAIL];" * 500, None] and {(r._spans, r._cut, r._IP_g) for r in rows} == {("_spans", "_cut", "_IP_g")}
    assert pii.pii_digest(df).where("n_email = 30000").count() == 1


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    df = documents(spark, ["é🙂 a@b.cd, +49 30 1234567 and 1.2.3.4!", None, "", "clean"])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["é🙂 [EMAIL], [PHONE] and [IP]!", None, "", "clean"]


def test_no_python_and_no_shuffle(spark):
    plan = pii.pii_digest(documents(spark, ["a@b.cd"]).where(F.col("doc_id") >= 0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.pii_digest(documents(spark, [])).count() == 0
