import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from sparkrinse.llm import secret_scan

PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
}


def base(text):
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(2)) >= 6 if kind == "assign" else len(m.group()) >= {"access": 20, "hex": 24}[kind]:
                found.append((m.start(), number, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def corpus():
    rng = random.Random(8)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pieces = [
        "password: ", "PassWord='", "api_key=", "ApiKey \" : ", "secret", "token: token = abcdefgh", "token=abc", "passwd :=x", "toKen\"=\"a.b-c/d",
        "AKIA" + made(string.ascii_uppercase + string.digits, 16), "AKIAAKIA" + "A" * 30, "AKIA12", made("0123456789abcdef", 40), made("0123456789abcdef", 23),
        "𝒳 größe ", "ſecret=abcdefgh", "Key ", " ", "\n", "= ", "ünïcode", made("0123456789abcdef", 24) + "g",
    ]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    return rows + [None, "", "a" * 50_000, ("token=abcdef1 " * 300), made("0123456789abcdef", 9000)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, spans string, s int").repartition(4)
    return {r.doc_id: r for r in secret_scan.with_digest(secret_scan.secrets(df)).collect()}


def test_base_spans_against_plain_python(spark):
    rows = corpus()
    found = run(spark, rows)
    for i, text in enumerate(rows):
        want, r = base(text), found[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in PATTERNS)
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == want


def test_random_tokens_and_words(spark):
    rng = random.Random(2)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base62 = string.ascii_letters + string.digits
    hidden = [made(base62, rng.randrange(28, 60)) for _ in range(120)] + [made(base62 + "+/", 44) + "=" for _ in range(60)]
    plain = ["article-number-" + str(i) + "-of-the-series-1111111" for i in range(100)] + ["a1" * 20, "abcdefghijklmnopqrstuvwxyz0123456789", "z" * 30 + "9", "inanouthtioninganderlyer"]
    found = run(spark, [f"see {x} there" for x in hidden + plain])
    caught = [f"random:4:{4 + len(x)}" in found[i].spans for i, x in enumerate(hidden + plain)]
    # An all-letter draw has no digit and counts as a word.
    assert sum(caught[:len(hidden)]) >= 0.85 * len(hidden)
    assert sum(caught[len(hidden):]) <= 0.05 * len(plain)


def test_tail_probabilities(spark):
    import statistics

    rows = [(z / 4,) for z in range(-20, 21)]
    for r in spark.createDataFrame(rows, "z double").select("z", secret_scan.upper_tail(F.col("z")).alias("p")).collect():
        assert abs(r.p - (1 - statistics.NormalDist().cdf(r.z))) < 2e-7


def test_even_tokens_have_even_probabilities(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("0123456789abcdef") for _ in range(64)),) for _ in range(600)]
    token = F.col("t")
    got = [r[0] for r in spark.createDataFrame(rows, "t string").repartition(4).select(secret_scan.random_probability(token, F.lit("hex"))).collect()]
    assert 0.35 < sum(got) / len(got) < 0.65
    assert sum(p < 0.05 for p in got) < 0.1 * len(got)


def test_empty_table(spark):
    assert run(spark, []) == {}
