"""Repetition, PII, HTML and toxicity."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from civlens.llm import html_text, pii, repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repetition(text):
    w = WORD.findall(text)
    n = len(w)

    def covered(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        inside = [False] * n
        for i in range(n - k + 1):
            if c[tuple(w[i : i + k])] > 1:
                inside[i : i + k] = [True] * k
        return inside

    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, w))
    shares = [sum(len(x) for x, m in zip(w, covered(k), strict=True) if m) / max(chars, 1) for k in range(5, 11)]
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, sum(covered(3)), shares


def test_repetition_equals_brute_force():
    rng = random.Random(2)
    texts = ["", "a", "a a a a", " \n\n \x1c\n", "é é é é é é " * 9, "# $ x\n# $ x\ny"]
    texts += [" ".join(rng.choices(["a", "b", "c\n", "dd", "é"], k=rng.randrange(3, 90))) for _ in range(300)]
    texts += [" ".join(rng.choices([f"w{k}" for k in range(400)], k=300)) + " tail" * 3]
    for text in texts:
        got, want = repetition.measure(text), brute_repetition(text)
        assert want[:5] == tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert np.allclose(want[5], got["repeat_chars"])


def test_repetition_verdict(odd, empty):
    prose = " ".join(f"word{k}" for k in range(200))
    assert repetition.measure(prose)["kept"]
    block = " ".join(f"x{k}" for k in range(30))
    assert not repetition.measure(f"{block} {prose[:200]} {block}")["kept"]
    rows = repetition.measured(odd).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 2
    assert {(r.doc_id, r.n_words) for r in rows if r.doc_id in (2, 3, 4)} == {(2, 0), (3, 0), (4, 0)}
    assert repetition.measured(empty).count() == 0


def brute_pii(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]}
    found["ip"] = [
        m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    found["card"] = [
        m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))
    ]
    found["phone"] = [
        m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15
    ]
    return found


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = [*"0123456789", "@", ".", "..", "+", "-", " ", "a", "b", "com", "(", ")", "1.2.3.4", "255.", "256", "\n", "_",
             "4111 1111 1111 1111", "4111111111111111", "x@y.z", "%", "é", "٣"]
    for _ in range(8000):
        x = "".join(rng.choices(parts, k=rng.randrange(1, 40)))
        got, want = pii.spans(x), brute_pii(x)
        assert {k: got[k] for k in pii.BASE_KINDS} == want, x


@pytest.mark.parametrize("text,kind,value", [
    ("Social Security Number: 123-45-6789", "ssn", "123-45-6789"),
    ("SSN Number: 123-45-6789", "ssn", "123-45-6789"),
    ("sOCIAL sECURITY nO 123-45-6789", "ssn", "123-45-6789"),
    ("Account Number: 1234567890", "account", "1234567890"),
    ("Account No. 123456", "account", "123456"),
    ("Acct No. 12345678", "account", "12345678"),
    ("Número de Cuenta 12345678", "account", "12345678"),
    ("Numéro De Compte: 1234 5678", "account", "1234 5678"),
    ("İİ KontoNummer 12345678", "account", "12345678"),
    ("Iban: GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("iBaN GB82WEST12345698765432", "iban", "GB82WEST12345698765432"),
])
def test_pii_cues_in_any_case(text, kind, value):
    at = text.index(value)
    assert pii.spans(text)[kind] == [(at, at + len(value))]
    assert pii.redact(text) == text.replace(value, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("SSN 123-45-6789", "ssn", "123-45-6789"),
        ("account number 1234-5678-90", "account", "1234-5678-90"),
        ("see ftp://bob:pw@host.example/x", "url", "ftp://bob:pw@host.example"),
    ],
)
def test_pii_anchored_kinds(text, kind, value):
    assert [text[a:b] for a, b in pii.spans(text)[kind]] == [value]
    assert value not in pii.redact(text)


def test_pii_invalid_identifiers_are_left():
    got = pii.spans("IBAN DE89 3704 0044 0532 0130 01, the wibani 12, accounts 5, http://host/a:b, 999.1.1.1")
    assert not any(got[k] for k in ("iban", "account", "ssn", "url", "ip"))
    assert pii.spans("7" * 50_000 + "." + "@" * 5000)["ip"] == []


def test_pii_on_odd_rows(frame, odd, empty):
    docs = frame([(1, "mail a.b@c.org or +49 (30) 1234567", "s"), (2, None, None), (2, "", "s")])
    rows = {r.spans: r for r in pii.found(docs).collect()}
    assert rows["email:5:14,phone:18:34"].n_email == 1
    assert rows[""].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in pii.redacted(docs).where("doc_id = 1").collect()}
    assert out[1].text == "mail [EMAIL] or [PHONE]" and out[1].n_chars == len(out[1].text)
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == odd.count()
    assert pii.found(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice">We use cookies on this site and that is all there is to it for you, dear reader of it.</div>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy the best of the best for the price of it.</div>
%s<aside>About the author and all of the other things that he has done in the past years.</aside>
<form><input><p>Enter the mail address</form><footer>&copy; 2020 &middot; all rights</footer></body></html>"""


def test_html_article():
    body = "<article><h1>Head&amp;line</h1><p><b>First\n  part<br>of it<p>Sh is.</p><p>a &lt; b</p></article>"
    body += '<section class="comments"><p>The first of the comments is that it was good for all of us.</p></section>'
    assert html_text.extract(PAGE % body) == "Head&line\n\nFirst part of it\n\nSh is.\n\na < b"


def test_html_without_article_uses_rules_and_neighbours():
    long = "The old mill of the town was in the hands of a man that had not been at work for years."
    body = f"<div><h1>The mill</h1><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><p>Tags</p></div>"
    assert html_text.extract(PAGE % body) == f"The mill\n\n{long}\n\nShort one.\n\n{long}"
    links = "<p>" + " ".join(f"<a href=x>the link of {k}</a>" for k in range(9)) + "</p>"
    assert html_text.extract(f"<body>{links}</body>") == ""


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<article><p>cut &am", "cut &am"), ("<article><p>x</p></div></p><p>y", "x\n\ny"),
        ("<article><p title='a>b'>z</p><!-- c", "z"), ("<article><p>a<script>1<2</p>", "a"),
    ],
)
def test_html_odd_markup(page, text):
    assert html_text.extract(page) == text


def test_html_on_odd_rows(spark):
    rows = [(1, "u", "<article><p>\U0001f600é</p></article>", 5), (None, None, None, 6), (1, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extracted(pages).collect()}
    assert got == {(1, "\U0001f600é", 2), (None, "", 0), (1, "", 0)}
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "b d k l m n r s t v".split() for b in "aeiou" for c in "nd st rk lm".split()]
    bad = ["idiot", "moron", "scumbag", "worthless"]
    docs, labels = [], []
    for k in range(1200):
        toxic = int(k % 4 == 0)
        parts = [" ".join(rng.choices(plain, k=8)) for _ in range(4)]
        if toxic:
            parts[rng.randrange(4)] += f" {rng.choice(bad)} {rng.choice(bad)}"
        docs.append((k, ". ".join(parts) + "."))
        labels.append((k, toxic, 1))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int"), plain


def test_toxicity_held_out_and_gapped(spark, insults):
    docs, labels, _ = insults
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).withColumn("held", toxicity.held_out()).join(labels.drop("score"), "doc_id")
    held = rows.where("held").toPandas()
    assert len(held) > 200 and (held.predicted == held.toxic).mean() > 0.97
    score = lambda t: float(model.scores(model.measures([t], {}))[0])
    pad = "band dest kilm lork "
    clean = score(pad * 3)
    for text in ["you idiot and moron", "an idixot, a morzon", "i d i o t scum-bag", "WORTHLESS idiot!"]:
        assert score(pad + text) > 10 * clean, text
    assert score("") < 0.3 and clean < 0.3


def test_toxicity_odd_rows(spark, odd, empty, insults):
    docs, labels, _ = insults
    known = labels.drop("score")
    for few in (known.where("toxic = 0"), known.limit(0), known.selectExpr("doc_id", "cast(null as int) toxic")):
        rows = toxicity.scored(odd, toxicity.train(docs, few)).collect()
        assert len(rows) == odd.count() and {r.score for r in rows} == {0.0}
    model = toxicity.train(docs.union(docs.limit(50)), known.union(known.limit(50)))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(empty, model).count() == 0
    kept = toxicity.without_toxic(odd, known.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_subsequences_tolerate_gaps():
    rows, keys, values, _ = toxicity.features(["idiot", "idixot", "table", "i-d-iot"])
    table = np.zeros((4, 1 << 18))
    np.add.at(table, (rows, keys), values)
    gram = table @ table.T
    assert gram[0, 1] > 0.35 and gram[0, 2] < 0.05 and np.isclose(gram[0, 3], gram[0, 0])
