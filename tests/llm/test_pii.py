import random
import re

from metricloom.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text) if passes(k, m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def base(text):
    return [(start, kind, end) for start, end, kind, _ in pii.spans(text) if kind in pii.BASE]


def test_base_spans_follow_their_rules():
    rng = random.Random(1)
    pieces = ["a@b.c", "x_y@d.e_f@g.hi", "@", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (706) 555-3138", "+", "-", " ",
              "4644348398010899", "4111 1111 1111 1111", "4111-1111-1111-1112", "%", "ü", "0", "12", "007.8.9.10", "a.b@c-d.e", "\n", "+49.30", "(5)"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        assert base(text) == brute(text), text


def test_added_kinds_need_their_checksum_or_a_word_nearby():
    found = {s[2] for s in pii.spans("IBAN DE89 3704 0044 0532 0130 00 ok")}
    assert "iban" in found
    assert "iban" not in {s[2] for s in pii.spans("IBAN DE88 3704 0044 0532 0130 00 ok")}
    assert [s[2] for s in pii.spans("ssn 123-45-6789.")] == ["ssn"]
    assert pii.spans("part 123-45-6789.") == [] and pii.spans("ssn 666-45-6789") == []


def test_words_nearby_adjust_the_score():
    score = {t: pii.spans(t)[0][3] for t in ("1.2.3.4", "server 1.2.3.4", "version 1.2.3.4")}
    assert score["version 1.2.3.4"] < score["1.2.3.4"] < score["server 1.2.3.4"]


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" + "(" * 100_000, "1." * 100_000):
        pii.spans(text)


def test_very_long_parts():
    zeros = "0" * 10_000
    assert base(f"{zeros}7.1.2.3") == [(0, "ip", 10_007)] and base(f"{zeros}.{zeros}.1.255")[0][1] == "ip"
    assert base(f"{zeros}256.1.2.3") == [] and base(f"9{zeros}.1.2.3") == []


def test_rows(spark):
    rows = [(1, "ü mail a@b.co", "x"), (2, None, "y"), (None, "", "z"), (1, "ü mail a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_spans(docs).collect()
    assert [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in got] == [
        (1, [("email", 7, 13)]), (2, []), (None, []), (1, [("email", 7, 13)]),
    ]
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "ü mail [EMAIL]", "x"), (2, None, "y"), (None, "", "z"), (1, "ü mail [EMAIL]", "x")]
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_account_numbers_end_before_what_follows():
    codes = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    tails = ["", " BIC COBADEFFXXX", " OR", " 2024-01-02", " and so on", " " + "A" * 40, " 12 34 56", ". Next"]
    for code in codes:
        for tail in tails:
            found = [s[:3] for s in pii.spans(f"to {code}{tail}") if s[2] == "iban"]
            assert found == [(3, 3 + len(code), "iban")], (code, tail)
    text = " ".join(codes)
    assert [text[s[0] : s[1]] for s in pii.spans(text) if s[2] == "iban"] == codes
    text = "AB12 CDEF GHIJ KLMN " + codes[0]
    assert [text[s[0] : s[1]] for s in pii.spans(text) if s[2] == "iban"] == codes[:1]
    assert not [s for s in pii.spans("DE88 3704 0044 0532 0130 00 BIC") if s[2] == "iban"]
    assert not [s for s in pii.spans("AB12 " * 20_000) if s[2] == "iban" and s[1] - s[0] < 15]
