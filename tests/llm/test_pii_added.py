"""The kinds that the method adds, against plain rules over every stretch of characters, and what words nearby decide."""

import math
import random
import re

from metricloom.llm import pii


def slow_secrets(text):
    """(start, end, score) by looking at every maximal stretch of key characters."""
    found, allowed = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        code, tail = text[at:end], end
        while tail < len(text) and text[tail] == "=" and tail - end < 2:
            tail += 1
        clean = (at == 0 or text[at - 1] != "=") and (tail == len(text) or text[tail] not in allowed | {"="})
        if len(code) >= 20 and clean:
            digit, lower, upper = (re.search(p, code) is not None for p in ("[0-9]", "[a-z]", "[A-Z]"))
            one_case_hex = len(code) >= 32 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", code) is not None
            bits = -sum(code.count(c) / len(code) * math.log2(code.count(c) / len(code)) for c in set(code))
            near = set(re.findall("[a-z]+", text[max(0, at - 48) : at].lower()))
            score = 0.4 + 0.3 * bool(near & pii.FITTING_WORDS["secret"]) - 0.3 * bool(near & pii.UNFITTING_WORDS["secret"])
            if digit and (one_case_hex or (lower and upper)) and bits >= pii.ENTROPY and score >= pii.THRESHOLD:
                found.append((at, tail, round(score, 3)))
        at = max(end, at + 1)
    return found


def test_secrets_equal_plain_rules():
    rng = random.Random(12)
    pieces = ["token = ", "commit ", "key: ", " the ", '"', "=", "==", "\n", "a" * 25, "0" * 40, "x1", "Password ", "é", "some-long-name-of-a-thing"]
    for _ in range(3000):
        text = ""
        for _ in range(rng.randint(1, 9)):
            if rng.random() < 0.4:
                alphabet = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "abcXYZ0123456789_-+/", "abcdefgh"])
                text += "".join(rng.choices(alphabet, k=rng.choice([10, 19, 20, 31, 32, 40, 64])))
            else:
                text += rng.choice(pieces)
        mine = [(s, e, score) for s, e, kind, score in pii.spans(text) if kind == "secret"]
        assert mine == slow_secrets(text), text


def test_words_nearby_decide_added_kinds():
    code, number = "9742a250774262d69ad6a86100194ed53da5a0ef", "078-05-1120"
    kinds = lambda text: {s[2] for s in pii.spans(text)}
    assert "secret" in kinds(f'token = "{code}"') and "secret" in kinds(f"TOKEN = {code.upper()}")
    assert "secret" not in kinds(f"in {code}") and "secret" not in kinds(f"commit token {code}")
    assert "ssn" in kinds(f"ssn {number}") and "ssn" not in kinds(f"see {number}")
    assert "iban" in kinds("DE89 3704 0044 0532 0130 00") and "iban" not in kinds("DE88 3704 0044 0532 0130 00")
    high, low = (pii.spans(f"{w} 192.168.0.1")[0][3] for w in ("host", "version"))
    assert high > low  # base kinds always come out; their scores tell


def test_secrets_are_redacted(spark):
    rows = spark.createDataFrame([(1, "token = 'ffc3105535f423f352535e4ac53b5fefe076ac6d'", 2)], "doc_id long, text string, spans int")
    assert pii.redact(rows).first().text == "token = '[SECRET]'"
    assert pii.find_spans(rows).first().spans[0].kind == "secret"
    assert pii.spans("k" * 200_000 + "1 token") == [] and pii.find_spans(rows.filter("false")).count() == 0
