"""Guess costs against all segmentations, whose spans are found here by their definitions."""

import math
import random
import re

import pytest

pytest.importorskip("weftline.llm.secrets")

from weftline.llm import secrets as S  # noqa: E402

DAY, MONTH, YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19|20)\d\d"
DATES = re.compile(rf"{YEAR}|{YEAR}([-/._]?){MONTH}\1{DAY}|{DAY}([-/._]?){MONTH}\2{YEAR}")


def prices(sub):
    """Costs of a substring as each kind of span."""
    word = sub.lower()
    for form, extra in ((word, 0.0), (word.translate(str.maketrans("013457@$!", "oieastasi")), 0.5)):
        if len(sub) >= 4 and form in S.WORDS:
            yield math.log10(S.WORDS.index(form) + 2) + extra + (0.3 if sub != word else 0.0)
            break
    if DATES.fullmatch(sub):
        yield math.log10(365 * 120 if len(sub) > 4 else 120)
    for unit in (1, 2, 3, 4):
        if len(sub) >= max(2 * unit, 3) and all(sub[k] == sub[k - unit] for k in range(unit, len(sub))):
            yield unit * S.brute_per_char(sub[:unit]) + math.log10(len(sub) // unit + 1)
    if len(sub) >= 3 and all(S._adjacent(a, b) for a, b in zip(sub, sub[1:])):
        yield math.log10(47 * len(sub)) + 0.25 * len(sub)


def exhaustive(value):
    per_char = S.brute_per_char(value)
    cost = [0.0]
    for j in range(1, len(value) + 1):
        cost.append(min([cost[j - 1] + per_char, *(cost[i] + 0.3 + p for i in range(j) for p in prices(value[i:j]))]))
    return cost[-1]


def test_least_of_all_segmentations():
    rng = random.Random(1)
    pieces = ["aaaa", "abab", "admin", "P4ssword", "qwerty", "2019-01-02", "1999", "zxc", "x", "7", "&", "Dragon", "aaab", "321", "01/02/2003", "!!"]
    values = ["aaaaadmin", "abababadmin1", "aaaa2019", "qwertyuadmin"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    for v in values:
        assert S.guess_cost(v)[0] == pytest.approx(exhaustive(v)), v
    assert S.guess_cost("aaaaadmin")[0] < 4 and S.guess_cost("abababadmin1")[0] < 7


def test_long_runs_cost_what_all_their_spans_cost():
    for v in ("admin" + "a" * 90 + "admin", "ab" * 45 + "badmin", "qwerty" * 12 + "x"):
        assert S.guess_cost(v)[0] == pytest.approx(exhaustive(v))


def test_segmentation_covers_the_value():
    for v in ("abababadmin1", "Tr0ub4dor&3x!Qz9", ""):
        cuts = S.guess_cost(v)[1]
        assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]][: len(cuts)] and (not v or cuts[-1][1] == len(v))


def test_dictionary_of_a_vocabulary():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = S.ranks(path)
    assert len(words) > 10_000 and all(words[w] == i + 1 for i, w in enumerate(S.WORDS))
    assert S.guess_cost("correcthorsebattery", path)[0] < S.guess_cost("correcthorsebattery")[0]


def test_contexts_that_expect_a_credential():
    from weftline.llm.secrets import scan

    def found(text):
        return [text[s.start : s.end] for s in scan(text) if s.kind == "guess"]

    for before, value, after in (
        ("DB_PASS='", "s3cr3t!Vq9#kd", "'"), ("pass: ", "Vq9#kd!x83Lm", "\n"), ("Authorization: Basic ", "dXNlcjpWcTkja2QheDgz", "\r\n"), ("Authorization: Bearer ", "aa.Vq9-kd_x83Lm77", ""),
        ("see postgres://admin:", "Vq9#kd!x83Lm", "@db.example.net:5432/x"), ("apiKey ", "9f8GhT21kdQ83LmZ", " was given"), ("password = ", "Ünlü#Vq9kd83", " "), ("secret key ", "9f8GhT21kdQ83LmZ77", "."),
    ):
        text = f"Text {before}{value}{after} and more"
        assert found(text) == [value], text
    for clean in (
        "PWD=/usr/local/lib/python3.13/site", "pass: the salt", "They pass = hand on", "password: ~/keys/old.txt", "the token Thursday was", "http://example.net:8080/a@b", "mail http://user@example.net", "the key 1234567890123456789 fits", "PWD=C:\\Users\\tom\\work",
        "bypass: somewhere", "api key abcdefghijklmnopqrst",
    ):
        assert found(clean) == [], clean


def test_very_long_texts_are_scanned_whole():
    from weftline.llm.secrets import scan

    text = "word " * 400_000 + "DB_PASS=s3cr3t!Vq9#kd " + "://a:b " * 50_000 + "password: " + "x" * 100_000
    got = scan(text)
    assert [text[s.start : s.end] for s in got if s.kind == "guess"][:1] == ["s3cr3t!Vq9#kd"] and got[-1].end == len(text)
