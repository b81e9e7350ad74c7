"""Personal data and secrets against plain regular expressions."""

import hashlib
import re
import random
from statistics import NormalDist

from helpers import EXTRA, documents, frame, of_texts, prose

from themeloom.llm import sanitise, secret_links


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 * (n > 9)
    return s % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
       "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
       "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
       "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15)}
ASSIGN = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in
                  ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = {"assign": (rf"({ASSIGN})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
           "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 16)}

AWKWARD = [
    "mail a.b+c@d-e.co.uk_x@y.zz, @no.pe a@b c@d.e.", "a@b.c.d@e.f g%h@i.j-k", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 .9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 1 2 3", "+1 (555) 123-4567 +12 3 +4912345678901234 +1--", "é\U0001F600 4111111111111111 é a@b.c",
    "password=token: abcdefghijklmnop secret = \"abc\" API_KEY: 'ABCdef123456-/+=' ToKeN:=abcdefghijkl apikey==0123456789ab", "AKIA" + "A1" * 8 + " AKIAshort AKIAAKIA" + "Z" * 14,
    "deadbeefdeadbeef 0123456789abcde DEADBEEF" + "ab" * 40, "1" * 5000 + " " + "1 " * 5000 + "+" + "1" * 3000, "%" * 3000 + "@a.b", "a" * 3000, "0" * 30 + ".1.1.1",
    "user: alice99 https://db.example.com/x key Zx9aB8cD7eF6gH5iJ4kL3m done", "Zx9aB8cD7eF6gH5iJ4kL3m alone", "login=bob4 alone",
    "far user: alice99 " + "pad " * 200 + "Zx9aB8cD7eF6gH5iJ4kL3m"]


def plain(text, kinds):
    return {k: [(k, m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m)] for k, (p, ok) in kinds.items()}


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def random_texts(n=150):
    r = random.Random(8)
    parts = ["a@b.c", "x.y@z", "1.2.3.4", "4111111111111111", "+1 555-123-4567", "token", "password", " = ", ":", "AKIA", "ABCDEFGH12345678", "deadbeef", "é", "\n",
             " ", " ", ".", "-", "@", "0123456789", "secret=\"Zx9aB8cD7eF6gH5i\"", "https://h.example/p", "user=", "\U0001F600"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


def rows():
    return documents() + [(500 + i, t, "en", "s", *EXTRA) for i, t in enumerate(AWKWARD + random_texts())]


def test_personal_data_equals_plain_expressions(spark):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    got = sanitise.report(frame(spark, rows())).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            continue
        want = plain(texts[r.doc_id], PII)
        every = [s for k in sanitise.KINDS for s in want[k]]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in sanitise.KINDS), texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(listed(every).encode()).hexdigest()
        assert r.spans == listed(every) or r.spans.startswith(listed(every) + ",") or not every


def entity_docs():
    """Ten of 60 texts name a person beside an address; a common word stands there too."""
    out = []
    for i in range(60):
        t = prose(i, 40).split()
        t.insert(20, "contact")
        if i % 6 == 0:
            t.insert(21, "Quillfeather qf@mail.example")
        out.append(" ".join(t))
    return out


def test_terms_that_reveal_an_entity(spark):
    docs = entity_docs()
    got = {r.doc_id: r.spans for r in sanitise.report(of_texts(spark, docs)).collect()}
    for i, t in enumerate(docs):
        at = t.find("Quillfeather")
        assert (f"reveal:{at}:{at + 12}" in got[i]) == (at >= 0)
        word = t.find("contact")
        assert f":{word}:" not in got[i]
    clean = {r.doc_id: r.text for r in sanitise.sanitise(of_texts(spark, docs)).collect()}
    assert all("Quillfeather" not in t and "qf@" not in t for t in clean.values())
    assert "<EMAIL>" in clean[0] and clean[1] == docs[1]


def test_shares_equal_brute_force(spark):
    import math

    docs = [t.lower() for t in entity_docs()] + [None]
    held = of_texts(spark, docs)
    base = sanitise.with_base(held.select("doc_id", "text")).where("size(base) > 0").dropDuplicates(["h1", "h2"])
    near = sanitise.contexts(base)
    got = {(r.entity, r.term): r.share for r in sanitise.revealing(held, base, near, 2, alpha=0.2).collect()}
    both = {}
    for r in near.collect():
        both.setdefault((r.entity, r.term), set()).add((r.h1, r.h2))
    texts = {t or "" for t in docs}
    n = len(texts)
    has = lambda w: sum(w in re.findall(r"[^\W\d_]{3,}", t) for t in texts)
    e = sum("qf@mail.example" in t for t in texts)
    bar = NormalDist().inv_cdf(1 - 0.2 / 2 / len(both)) ** 2

    def gain(b, t):
        cells = [(b, e, t), (e - b, e, n - t), (t - b, n - e, t), (n - e - t + b, n - e, n - t)]
        return 2 * sum(o * math.log(o * n / (x * y)) for o, x, y in cells if o)

    seen = {k: (len(v), has(k[1])) for k, v in both.items() if len(v) >= 2}
    want = {k: math.log(n * b / (e * t)) / math.log(n / e) for k, (b, t) in seen.items() if gain(b, t) >= bar}
    assert len(want) < len(seen)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_terms_far_from_an_entity_and_in_texts_without_it(spark):
    docs = [prose(900 + i, 60) for i in range(80)]
    for i in range(0, 40, 2):
        # No address stands twice; their domain does. The name is far from it.
        docs[i] = "Wigglesworth " + docs[i] + f" user{i}@rare.example"
    docs[1] += " wigglesworth"
    got = {r.doc_id: r.spans for r in sanitise.report(of_texts(spark, docs)).collect()}
    assert all(got[i].split(",")[1] in ("hint:0:12", "reveal:0:12") for i in range(0, 40, 2))
    assert got[1].endswith(f":{len(docs[1]) - 12}:{len(docs[1])}") and got[3] == ""


def test_sanitise_keeps_rows_and_columns(spark):
    out = sanitise.sanitise(frame(spark, rows()))
    assert out.columns == frame(spark, []).columns and out.count() == len(rows())
    assert out.where("doc_id = 0 and text is null").count() == 1
    assert sanitise.report(frame(spark, [])).count() == 0


def test_secrets_equal_plain_expressions(spark):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    got = secret_links.report(frame(spark, rows())).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            continue
        want = plain(texts[r.doc_id], SECRETS)
        every = sorted((s for k in secret_links.BASE for s in want[k]), key=lambda s: (s[1], secret_links.BASE.index(s[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(want[k]) for k in secret_links.BASE), texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(listed(every).encode()).hexdigest()
        shown = [s for s in r.spans.split(",") if s.split(":")[0] in secret_links.BASE]
        assert ",".join(shown) == listed(every)


def test_weak_parts_are_reported_only_together(spark):
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",")] for r in
           secret_links.report(of_texts(spark, AWKWARD[-4:])).collect()}
    assert got[0] == ["identifier", "endpoint", "opaque"]
    assert got[1] == [""] and got[2] == [""] and got[3] == [""]


def test_linked_parts_equal_brute_force(spark):
    texts = [t for t in random_texts(300)]
    docs = of_texts(spark, texts)
    got = {r.doc_id: {(s["kind"], s["start"], s["end"]) for s in r.extra} for r in secret_links.find(docs).collect()}
    weak = {r.doc_id: r for r in secret_links.find(docs, scope=10**6).collect()}
    for i, r in weak.items():
        parts = [(s["kind"], s["start"], s["end"]) for s in [*r.extra, *r.base]]
        for kind, s, e in [(x["kind"], x["start"], x["end"]) for x in r.extra]:
            linked = any(k in secret_links.COMPLEMENT[kind] and s2 < e + secret_links.SCOPE and s < e2 + secret_links.SCOPE
                         for k, s2, e2 in parts)
            assert ((kind, s, e) in got[i]) == linked


def test_long_parts_are_linked_like_short_ones(spark):
    r = random.Random(11)
    kinds = [*secret_links.BASE, *secret_links.WEAK]
    rows = [(1, 1, "opaque", 0, 900, "x"), (1, 1, "identifier", 905, 920, "x"), (2, 2, "endpoint", 0, 30, "x"),
            (2, 2, "opaque", 8, 30, "x"), (3, 3, "endpoint", 0, 2000, "x"), (3, 3, "assign", 2200, 2220, "x")]
    for t in range(4, 40):
        for start in r.sample(range(6000), 8):
            rows.append((t, t, r.choice(kinds), start, start + r.choice([15, 300, 650, 2500]), "x"))
    want = {a[:5] for a in rows for b in rows if a[0] == b[0] and b[2] in secret_links.COMPLEMENT.get(a[2], ())
            and b[3] < a[4] + 300 and a[3] < b[4] + 300 and (b[4] <= a[3] or a[4] <= b[3])}
    parts = spark.createDataFrame(rows, "h1 long, h2 long, kind string, start int, end int, found string")
    assert {tuple(x)[:5] for x in secret_links.linked(parts).collect()} == want
    assert {(1, 1, "opaque", 0, 900), (1, 1, "identifier", 905, 920), (3, 3, "endpoint", 0, 2000)} <= want
    texts = ["https://example.com/Articles/2024/Foo-Bar-Baz alone", "redis://cache.example/0 password=hunter2hunter2"]
    got = {x.doc_id: x.spans for x in secret_links.report(of_texts(spark, texts)).collect()}
    assert got[0] == "" and got[1].startswith("endpoint:0:23,assign:")


def test_chance_words_beside_addresses_are_left_alone(spark):
    r = random.Random(21)
    words = ["".join(r.choice("aeioustlnrmd") for _ in range(6)) for _ in range(6000)]
    docs = [" ".join(r.choice(words) for _ in range(60)) for _ in range(400)]
    docs = [d + f" user{i}@{'big.example' if i % 4 else 'small.example'}" if i % 2 else d for i, d in enumerate(docs)]
    docs += [d + " +49 30 1234567 Bumblethwaite" for d in docs[:12]]
    out = {x.doc_id: x.spans for x in sanitise.report(of_texts(spark, docs)).collect()}
    added = [(i, s) for i, x in sorted(out.items()) for s in x.split(",") if s.startswith(("hint", "reveal"))]
    # The twelve texts have the name; their own words stand once more each, in the texts they are made of.
    assert added == [(i, f"reveal:{len(docs[i]) - 13}:{len(docs[i])}") for i in range(400, 412)]
