"""The randomness battery and its false-discovery rule against a plain version, and on ordinary names beside keys."""

import math
import random
import re
import string
from collections import Counter

import pytest

from trajspark.llm import secret_scan

WORDS = "get set is a an of the user name list map to from my http url id by in on file data value index count size type error handler factory manager service client server request response builder config option default context session token thread pool queue cache buffer stream reader writer parser format version number string object class method field table column row page view model control event listener action state update delete insert select find search sort filter group merge split join copy move read write open close start stop run test debug info warn long very this camel case identifier message account order item product price total amount date time zone".split()


def normal(z):
    z = max(-12.0, min(12.0, z))
    return 1 / (1 + math.exp(-1.5976 * z - 0.070565 * z**3))


def plain_p(s):
    name, _, alphabet, coincidence = next(e for e in secret_scan.ENCODINGS if re.search(e[1], s))
    n, k, x = len(s), len(alphabet), [alphabet.find(c) + 1 for c in s]
    deviation = lambda text, k, ic: ((k / n * sum(v * v for v in Counter(text).values()) - n) - (k - 1 + n * (k * ic - 1))) / math.sqrt(2 * (k - 1 + 2 * n * (k * ic - 1)))
    if name in secret_scan.MIXED:
        turns = sum((a - 1) // 26 != (b - 1) // 26 for a, b in zip(x, x[1:]))
        c = secret_scan.CHANGES
        structure = normal(-(-deviation(s.lower(), secret_scan.FOLDED, secret_scan.LETTERS) + (turns - c * (n - 1)) / math.sqrt(c * (1 - c) * (n - 1))) / math.sqrt(2))
    else:
        structure = normal(deviation(s, k, coincidence))
    runs = 1 + sum((a > (k + 1) / 2) != (b > (k + 1) / 2) for a, b in zip(x, x[1:]))
    runs_z = (runs - (n + 1) / 2) / math.sqrt((n - 1) / 4)
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / spread * math.sqrt(n) if spread else math.sqrt(n)
    away = lambda z: normal(abs(z) - secret_scan.STRAY * math.sqrt(n))
    return max(structure, away(runs_z), away(serial))


def plain_discoveries(values, alpha=secret_scan.ALPHA):
    weight = [max(8, min(128, len(v))) for v in values]
    usual = sum(weight) / len(weight)
    bins = [min(secret_scan.BINS, math.floor(-20 * math.log(min(1.0, plain_p(v) / (w / usual))))) for v, w in zip(values, weight)]
    cuts = [b for b in set(bins) if math.exp(-b / 20) <= alpha * sum(x >= b for x in bins) / len(bins)]
    return {i for i, b in enumerate(bins) if cuts and b >= min(cuts)}


def name(rng):
    words = rng.choices(WORDS, k=rng.randint(4, 9))
    kind = rng.randrange(5)
    if kind == 0:
        s = "".join(w.capitalize() for w in words)
        at = rng.randint(0, len(s))
        return rng.choice([s, s[:1].lower() + s[1:], s[:at] + str(rng.randint(0, 99)) + s[at:], s + str(rng.randint(0, 9999))])
    if kind == 1:
        return "".join(words) + str(rng.randint(0, 999))
    if kind == 2:
        return "".join(words).upper() + rng.choice(["", str(rng.randint(0, 99))])
    if kind == 3:
        return f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}T{rng.randint(0, 23):02}{rng.randint(0, 59):02}{''.join(w.capitalize() for w in words[:3])}"
    return "".join(words[:3]) + "".join(w.capitalize() for w in words[3:])


def key(rng):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=rng.choice([32, 40, 43])))


@pytest.fixture(scope="module")
def names():
    rng = random.Random(7)
    return [x for x in (name(rng) for _ in range(7_500)) if len(x) >= secret_scan.LEAST][:5_000]


@pytest.mark.parametrize("share, found_at_least", [(0.01, 0.2), (0.1, 0.65), (0.5, 0.8)])
def test_names_are_not_secrets(spark, names, share, found_at_least):
    rng = random.Random(int(share * 100))
    keys = [key(rng) for _ in range(round(len(names) * share / (1 - share)))]
    values = names + keys
    df = spark.createDataFrame(list(enumerate(values)), "i int, m string").repartition(4)
    got = {r.i for r in secret_scan.discoveries(secret_scan.battery(df)).collect()}
    assert got == plain_discoveries(values)
    false = sum(i < len(names) for i in got)
    assert false <= 0.02 * len(got) and len(got) - false >= found_at_least * len(keys), (false, len(got), len(keys))


def test_p_of_each_encoding(spark, names):
    rng = random.Random(1)
    alphabets = [e[2] for e in secret_scan.ENCODINGS]
    values = names[:300] + ["".join(rng.choices(a, k=n)) for a in alphabets for n in (20, 33, 64)] + ["a" * 30, "aA" * 15, "0123456789" * 3, "-_" * 20]
    df = spark.createDataFrame(list(enumerate(values)), "i int, m string")
    for r in secret_scan.battery(df).collect():
        assert r.p == pytest.approx(plain_p(values[r.i]), rel=1e-9, abs=1e-12), values[r.i]
