import hashlib
import random
import re

from shearwater.llm import pii


def brute(t):
    t = t or ""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


FIXED = [
    None, "", "éé a.b%c@x-y.example.com, z@w@q.de.", "🐾 10.0.0.1 999.1.1.1 1.2.3.4.5 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4012888888881881 5",
    "+1 (988) 555-2485 and +12 34 +49.30.1234567-8 x", "a@b.c_d@e.f 7@8.9", "1-2-3-4-5-6 7 8 9 0 1 2 3 4 5 6", "9" * 30000, "a" * 30000 + "@b.cc", "1 " * 20000, "x.y." * 5000 + "@" + "a." * 3000,
]


def test_base_spans_match_brute_force(docs_of):
    rng = random.Random(1)
    texts = FIXED + ["".join(rng.choices("01ab@.+- ()9é\n", weights=[6, 6, 3, 3, 2, 4, 2, 3, 3, 1, 1, 4, 1, 1], k=rng.randint(1, 80))) for _ in range(600)]
    texts += ["".join(rng.choices("0123456789 -", k=rng.randint(16, 40))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[4])]
    got = pii.digest(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[4] if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert r.spans.startswith(want) and r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])
    assert pii.digest(docs_of([])).count() == 0


def test_trees_add_cued_numbers_only(docs_of):
    rows = [(1, "please call me at 415-555-2671 today"), (2, "order 415-555-2671 shipped"), (3, "SSN: 219-09-9999."), (4, "part no 000-00-0000"), (5, "IBAN DE89370400440532013000"), (6, "plain text 12 34")]
    got = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    assert got[1].startswith("tel:18:") and got[2] == "" and got[3].startswith("idnum:") and got[4] == "" and got[5].startswith("iban:") and got[6] == ""
    text = {r.doc_id: r.text for r in pii.redact(docs_of([*rows, (7, "a@b.cc +1 415 555 2671"), (8, None)])).collect()}
    assert text[7] == "[pii] [pii]" and text[8] == "" and text[2] == rows[1][1]


def test_columns_and_rows_give_the_same_features(spark):
    rows = pii.grammar(300, 9)
    for kind in pii.MORE:
        mine = [r for r in rows if r[0] == kind]
        df = spark.createDataFrame([(r[1], r[2]) for r in mine], "value string, before string").coalesce(1)
        from pyspark.sql import functions as F

        got = df.select(*(c.alias(n) for n, c in pii.feature_columns(kind, F.col("value"), F.col("before")).items())).collect()
        assert [list(map(float, g)) for g in got] == [pii.features(*r[:3]) for r in mine]
