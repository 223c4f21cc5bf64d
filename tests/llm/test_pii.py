"""PII: base spans against the plain patterns, Luhn, what weak supervision adds and leaves alone, EM on planted votes."""
import bisect
import random
import re

import pytest

from riskweave.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for order, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}
            if ok[kind]():
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_equals_plain_patterns(spark, docs_schema):
    rng = random.Random(9)
    texts = [None, "", "x" * 50_000 + " a@b.c", "1" * 30_000, "a." * 20_000 + "@", "+1 (988) 555-2485, +49 30 123456", "4111 1111 1111 1111 and 4111-1111-1111-1112",
             "é🙂 jo.81@mail7.example.com.", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "001.02.3.4 256.1.1.1 99999999999999999999.1.1.1", "a@b@c.d a@b..c"]
    texts += ["".join(rng.choice("a1@.+- %(é\n40") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.+") for _ in range(rng.randrange(90))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in enumerate(texts)] + [(None, "a@b.cd", "", "", 1, "")], docs_schema)
    got = pii.search(df)
    got = {r.doc_id: r.base for r in got.select("doc_id", pii.listed(pii.F.filter("spans", lambda s: s["base"])).alias("base")).collect()}
    assert got[None] == "email:0:6"
    for i, t in enumerate(texts):
        assert got[i] == plain(t or ""), t


@pytest.fixture(scope="module")
def trained_rows():
    rng = random.Random(4)
    rows = []
    for k in range(200):
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        d += next(c for c in "0123456789" if luhn(d + c))
        rows.append(f"my mail is user{k}@host.com, phone: +1 (212) 555-{1000 + k}, server 93.184.216.{k}, card {d}")
        rows.append(f"order no 99{rng.randrange(10**13, 10**14)} and version 1.{k}.3")
    return rows


def test_adds_likely_spans_and_leaves_others(spark, trained_rows):
    added = {"mail jane.doe (at) example (dot) org now": "email", "write to bob at mail dot example dot com": "email", "Visa card 4111.1111.1111.1111 ok": "card", "Tel. 030 1234 5678 90": "phone",
             "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up": "ip"}
    clean = ["meet at noon. Then go", "we met at home. Bob left", "invoice no 1234.5678.9012.3456", "on 2020 10 11 and 1999 12 31 2000", "page 12 345 678", "pi is 3.14159265358979"]
    texts = trained_rows + list(added) + clean
    got = pii.search(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {texts[r.doc_id]: r.spans for r in got}
    for t, kind in added.items():
        assert [s.kind for s in by[t] if not s.base] == [kind], (t, by[t])
    for t in clean:
        assert by[t] == [], t
    for t in trained_rows[::2]:
        assert [s.kind for s in by[t]] == ["email", "phone", "ip", "card"] or len(by[t]) >= 4


def test_empty(spark, docs_schema):
    assert pii.search(spark.createDataFrame([], docs_schema)).collect() == []


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(0)
    counts: dict = {}
    for _ in range(5000):
        real = rng.random() < 0.5
        vote = lambda p: (1 if real else -1) * (1 if rng.random() < p else -1)  # noqa: B023, E731
        v = (0, vote(0.95), vote(0.9), vote(0.55))
        counts[0, v] = counts.get((0, v), 0) + 1
    post = pii.estimate(counts)
    assert post[0, (0, 1, 1, -1)] > 0.9 and post[0, (0, -1, -1, 1)] < 0.1


def planted(rng, k):
    """(text, kind or None): loose spans that are personal data, with words that say so, and numbers that are none."""
    digits = "".join(rng.choice("0123456789") for _ in range(14))
    body = "4" + digits
    good = body + next(c for c in "0123456789" if luhn(body + c))
    wrong = body + next(c for c in "0123456789" if not luhn(body + c))
    dotted = lambda d: ".".join(d[i:i + 4] for i in range(0, 16, 4))
    n = [rng.randrange(1000, 9999) for _ in range(3)]
    name = rng.choice(["anna", "b.meier", "carlos", "d_li", "eve77"])
    return [(f"please write to {name}{k} (at) host{k} (dot) org today", "email"), (f"Mail: {name} at mail{k} dot example dot com", "email"), (f"Visa card {dotted(good)} on file", "card"),
            (f"Karte Nr. {dotted(good)} gilt", "card"), (f"Tel. 030 {n[0]} {n[1]} heute", "phone"), (f"call (212) 555 {n[2]} now", "phone"),
            (f"server 2001:db8:{n[0]:x}:{n[1]:x}:0:8a2e:370:{k:x} up", "ip"), (f"invoice no {dotted(wrong)} paid", None), (f"serial {wrong} built", None),
            (f"on 2020 10 11 and {n[0]} rows", None), (f"article 300 {n[0]} {n[1]} of the law", None), (f"they met at home dot {name} left", None), (f"order {n[0]}-{n[1]}-{n[2]}", None)]


def test_planted_loose_spans(spark, trained_rows):
    rng = random.Random(12)
    cases = [c for k in range(60) for c in planted(rng, k)]
    texts = [t for t, _ in cases] + trained_rows
    got = {r.doc_id: r.spans for r in pii.search(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    added = {i: [s.kind for s in got[i] if not s.base] for i in range(len(cases))}
    hits = sum(kind in added[i] for i, (_, kind) in enumerate(cases) if kind)
    false = sum(len([x for x in added[i] if x != kind]) for i, (_, kind) in enumerate(cases))
    assert hits / sum(kind is not None for _, kind in cases) >= 0.9
    assert false / (hits + false) <= 0.05


def test_long_texts_and_many_spans(spark):
    """A text of digits and letters, and one of many thousand spans of several kinds, against the plain patterns."""
    rng = random.Random(3)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(60_000))
    mixed = " ".join(rng.choice(["10.2.{}.4", "a{}@b.cd", "tel 030 1234 {}", "é🙂 {}", "+1 212 555 {}"]).format(rng.randrange(256)) for _ in range(20_000))
    got = pii.search(spark.createDataFrame([(0, hexes), (1, mixed)], "doc_id long, text string"))
    got = {r.doc_id: r for r in got.select("doc_id", "spans", pii.listed(pii.F.filter("spans", lambda s: s["base"])).alias("base")).collect()}
    for i, t in enumerate((hexes, mixed)):
        assert got[i].base == plain(t)
        spans = sorted((s.start, s.end) for s in got[i].spans if not s.base)
        base = sorted((s.start, s.end) for s in got[i].spans if s.base)
        ends = [e for _, e in base]
        assert all((j := bisect.bisect_right(ends, a)) >= len(base) or base[j][0] >= b for a, b in spans)
