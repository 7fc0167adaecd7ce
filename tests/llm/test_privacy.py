import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trajlake.llm import privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    double = str.maketrans("0123456789", "0246813579")
    turned = digits[::-1]
    return (sum(map(int, turned[::2])) + sum(int(d) for d in turned[1::2].translate(double))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def spans(df, kinds):
    return df.select("doc_id", privacy.span_texts(F.col("spans"), kinds).alias("s"))


def test_base_spans_against_plain_patterns(docs, odd_rows):
    rng = random.Random(2)
    bits = ["a@b.c", "x.y@z-q.co.uk", "a@b", "@", "1.2.3.4", "256.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (845) 555-3372", "+44 20 7946 0958.", " ", "é", "😀", ".", "_foo@bar.org", "5", "+", "(", "-", "\n", "1.2.3.4.5.6.7.8", "w"]
    rows = odd_rows + [(300 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    rows += [(900, "9" * 20_000 + " " + "a" * 20_000 + "@"), (901, "a." * 9_000 + "@b" + ".c" * 9_000), (902, "+1" + "(" * 9_000),
             (903, "a@b.c " * 3_000), (None, "mail a@b.co")]
    found = privacy.find_personal_data(docs(rows), keep_text=False)
    got = sorted(map(tuple, spans(found, tuple(privacy.PATTERNS)).collect()), key=repr)
    assert got == sorted([(i, ",".join(base_spans(t))) for i, t in rows], key=repr)


def test_disclosing_terms(docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    secret = [(i, f"{word()} {word()} codename zanzibar reach kim@corp.example.com today {word()} {word()}") for i in range(6)]
    often = [(100 + i, f"{word()} today codename {word()} {word()}") for i in range(200)]
    copies = [(400 + i, "quixotic lee@corp.example.org rests") for i in range(5)]
    out = {r.doc_id: r for r in privacy.find_personal_data(docs(secret + often + copies)).collect()}
    for i, text in secret:
        terms = [text[s.start:s.end] for s in out[i].spans if s.kind == "term"]
        assert "zanzibar" in terms and "reach" in terms and "today" not in terms and "codename" not in terms
        assert "zanzibar" not in out[i].text and "kim@" not in out[i].text and "[EMAIL]" in out[i].text
    assert all(out[i].text == t and not out[i].spans for i, t in often)
    # Copies of one text are no evidence of disclosure.
    assert out[400].text == "quixotic [EMAIL] rests"


def test_terms_far_from_the_entity_and_at_the_ends(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"Zanzibar {filler(60)} kim@corp.example.com {filler(60)} ZANZIBAR {filler(3)} quixotic") for i in range(6)]
    rows += [(10 + i, f"{filler(20)} Éééékim@corp.example.com {filler(20)}") for i in range(3)]
    rows += [(50, rows[0][1]), (51, rows[0][1])]
    rows += [(100 + i, f"{filler(20)} corp example {filler(20)}") for i in range(200)]
    out = {r.doc_id: r for r in privacy.find_personal_data(docs(rows)).collect()}
    for i, text in rows[:6] + rows[9:11]:
        terms = [text[s.start:s.end] for s in out[i].spans if s.kind == "term"]
        assert terms == ["Zanzibar", "ZANZIBAR", "quixotic"]
        assert "zanzibar" not in out[i].text.lower() and "[EMAIL]" in out[i].text
    assert all(out[i].text == text for i, text in rows[11:])
    assert all("[EMAIL]" in out[10 + i].text and "kim@" not in out[10 + i].text for i in range(3))


def test_overlaps_and_empty_table(docs):
    text = "1.2.3.4 then +1.2.3.4.5.6.7.8.9 end"
    row = privacy.find_personal_data(docs([(1, text)])).first()
    assert row.text.startswith("[IP] then ") and row.text.endswith(" end")
    empty = privacy.find_personal_data(docs([(1, "x")]).limit(0))
    assert empty.columns == ["doc_id", "spans", "text"] and empty.count() == 0


@pytest.mark.parametrize("text", ["", "no data"])
def test_digest_of_no_spans(docs, text):
    found = privacy.find_personal_data(docs([(1, text)]), keep_text=False)
    got = found.select(F.sha2(privacy.span_texts(F.col("spans"), privacy.KINDS), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()
