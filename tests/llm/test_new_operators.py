"""Personal data, the filter audit and whitening against plain Python; what odd rows give."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsieve.llm import filteraudit, private, whitening
from hostsieve.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"

# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    each = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in each) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c_d@e.f g@h.i@j.k @x.y a@b a@b. %+-@z.co.uk.. Ä.ö@ü.de é55@mail.example.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3 1..2.3.4 300.1.1.1.1 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 411111111111111111111 1 4111111111111111",
    "+1 (017) 555-7713 +1 (017) 555-7713... +12 ++49 30 123456- +1-2 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 +49(30)",
    "🙂 x@y.z 🙂 +49 30 1234567 🙂 10.0.0.1",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 2 x 0000 0000 0000 0000 000",
]


def test_base_matches_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    alphabet = "ab1279@.+- ()_%\n😀é"
    rows = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)] + ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: text_of([(s.kind, s.start, s.end) for s in r.base]) for r in private.base_spans(df).collect()}
    assert got == {k: text_of(plain_base(t)) for k, t in enumerate(rows)}


def test_long_runs_neither_recurse_nor_square(spark):
    rows = ["9" * 200_000, "1 " * 100_000, "a." * 100_000 + "@b.c", "x@" + "y." * 100_000 + "z", "1.2.3.4 " * 20_000, "+1 234 567 89 " * 5_000, "é" * 100_000 + " +49 30 1234567"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found, _ = private.find_private(df)
    got = {r.doc_id: text_of([(s.kind, s.start, s.end) for s in r.base]) for r in found.collect()}
    want = ["", "", "email:0:200004", "email:0:200003", text_of([("ip", 8 * k, 8 * k + 7) for k in range(20_000)]), text_of([("phone", 14 * k, 14 * k + 13) for k in range(5_000)]), "phone:100001:100015"]
    assert got == dict(enumerate(want))  # the plain patterns would take the square of a run's length here


def test_running_sums_of_lengths(spark):
    lengths = [k % 7 for k in range(1000)]
    df = spark.createDataFrame([(lengths,), ([],), ([5],)], "n array<long>")
    assert [r.s for r in df.select(private.running(F.col("n"), 16).alias("s")).collect()] == [[0, *itertools.accumulate(lengths)][:-1], [], [0]]


def leaky(spark):
    """Contexts that stand before addresses and numbers of base kinds, and before others; a context without personal data."""
    rng, rows = random.Random(6), []
    for k in range(40):
        rows.append(f"{rng.choice(('Hello there', 'So then'))} you can reach me at user{k}@mail{k % 7}.example.com any day")
        rows.append(f"please call us on +49 30 {5550000 + k * 37} or later, thanks")
        rows.append(f"see the standard version number {k}.0.1234 of the text")
    rows += ["you can reach me at bob#77@home today", "please call us on 030-5551234 now", "please call us on (0221) 555 1234 now", "the version number 99.0.4321 of it", "no context: 12345678"]
    return rows


def plain_bootstrap(rows, rounds=3, least=3, sure=0.6):
    """The patterns and their confidences by dictionaries, from the tokens that the operator reads."""
    edges = {(p, t["value"].lower()): t["kind"] for row in rows for t in row["tokens"] for p in t["patterns"]}
    degree, score = {}, {(i, k): 1.0 for (_, i), k in edges.items() if k}
    for p, _ in edges:
        degree[p] = degree.get(p, 0) + 1
    seeds, known = dict(score), {}
    for _ in range(rounds):
        sums = {}
        for (p, i), seed in edges.items():
            for k in private.KINDS:
                s = score.get((i, k)) if (seed is None or seed == k) else None
                if s:
                    w, n = sums.get((p, k), (0.0, 0))
                    sums[p, k] = (w + s, n + 1)
        known = {pk: w / (degree[pk[0]] + 1) for pk, (w, n) in sums.items() if n >= least and w / (degree[pk[0]] + 1) >= sure}
        doubt = {}
        for (p, i), seed in edges.items():
            for (q, k), c in known.items():
                if p == q and seed is None:
                    doubt[i, k] = doubt.get((i, k), 1.0) * (1 - min(c, 0.999))
        score = seeds | {ik: 1 - d for ik, d in doubt.items()}
    return known


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = leaky(spark)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found, patterns = private.find_private(df)
    read = private.tokens(private.base_spans(df)).select("tokens").collect()
    want = plain_bootstrap([r.asDict(recursive=True) for r in read])
    got = {(r.pattern, r.kind): r.confidence for r in patterns.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {("me at", "email"), ("us on", "phone")} <= got.keys()
    spans = {(rows[r.doc_id][s.start : s.end], s.like) for r in found.collect() for s in r.found or []}
    assert {("030-5551234", "phone"), ("(0221) 555 1234", "phone")} <= spans
    assert not any("4321" in t or "12345678" in t or ".1234" in t for t, _ in spans)
    digest = {r.doc_id: r for r in private.digest(found).collect()}
    assert all(r.spans.startswith(text_of(plain_base(rows[k]))) and r.base_sha256 == hashlib.sha256(text_of(plain_base(rows[k])).encode()).hexdigest() for k, r in digest.items())
    assert sum(r.n_found for r in digest.values()) == len(spans) and sum(r.n_email for r in digest.values()) == 40


def test_private_query_on_the_given_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op11_private"](spark, SF).collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PLAIN)
        assert r.spans.startswith(text_of(base)) and (r.n_found or r.spans == text_of(base))


def test_private_has_no_python_in_its_plan(spark):
    plan = private.find_private(spark.read.parquet(f"{SF}/documents.parquet"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_private_odd_rows(spark):
    rows = [(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc"), (2, None), (None, None), (3, ""), (4, "   ")]
    df = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], "doc_id long, text string, base string, tokens string, found string, __row int")
    got = private.digest(private.find_private(df)[0]).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == sorted((str(i), int(bool(t and "@" in t)), "email:0:6" if t and "@" in t else "") for i, t in rows)
    assert private.digest(private.find_private(df.limit(0))[0]).count() == 0


# Filter audit


def plain_audit(docs, labels):
    """Each order's filters applied one after another to the documents of each part."""
    least, rows = {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))
    for i, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text])
        rows.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, own in rows.items():
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                lost, left = [r for r in left if r[0][k]], [r for r in left if not r[0][k]]
                shapley[name] += len(lost)
                found.append((part, "".join(order), step, len(left), len(lost), sum(r[0][k] for r in own) - len(lost), sum(r[0][k] and sum(r[0]) == 1 for r in own), sum(r[1] for r in lost), sum(r[2] for r in lost), name))
        out += [(*r[:9], shapley[r[9]]) for r in found]
    return sorted(out)


def test_audit_equals_filters_applied_one_by_one(spark):
    rng, docs = random.Random(7), []
    for k in range(120):
        words = [rng.choice(("low", "Cap", "CAPS", "tail%", "plain", "word")) + ("" if rng.random() < 0.6 else str(rng.randrange(400))) for _ in range(rng.choice((3, 150, 199, 200, 260)))]
        docs.append((k, " ".join(words), rng.choice(("en", "de", None, ""))))
    docs += [(k + 200, docs[k][1], "en") for k in range(0, 60, 2)]
    docs += [(5, docs[5][1], docs[5][2]), (None, docs[6][1], "en"), (None, None, None), (300, None, "en"), (301, "", "fr"), (302, "x" * 100_000 + " y", "fr")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 230)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None)]
    df = spark.createDataFrame([(*d, 1, "m", "c") for d in docs], "doc_id long, text string, lang string, part int, mask string, code string")
    known = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = sorted(map(tuple, filteraudit.audit(df, known).collect()))
    assert got == plain_audit(docs, labels)
    assert filteraudit.audit(df.limit(0), known).count() == 0
    assert len(filteraudit.audit(df, known.limit(0)).collect()) == len(got)


def test_walk_gives_the_survivors_of_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (32, 3))
    states = filteraudit.walk(counts)
    for subset in range(32):
        assert (states[subset] == counts[[m for m in range(32) if not m & subset]].sum(0)).all()


# Whitening


def plain_whitening(x, k=32):
    x = np.floor(64 * x.astype(float)) + 1_000_000
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(c))
    e, v = e[::-1], v[:, ::-1]
    return (c @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :k], (e / e.sum())[:k]


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def compare(got, x, k, tol=1e-6):
    n = len(x)
    want, explained = plain_whitening(x, k)
    w = np.zeros((n, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.explained == pytest.approx(explained[r.component - 1], rel=1e-6) and r.identity_error < 1e-4
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < tol
    xs = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in row] for row in x]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in xs]
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    return w


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * np.geomspace(30, 0.1, 12)).astype(np.float32)
    got = whitening.whiten(frame(spark, x).repartition(5), components=10).collect()
    assert len(got) == 7000
    compare(got, x, 10, 1e-5)


def test_badly_conditioned_rows_need_the_shift(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 6))
    x = np.concatenate([base * 1e6, base[:, :2] * 1e6 + rng.normal(size=(400, 2))], 1).astype(np.float32)
    rows = whitening.usable(frame(spark, x))
    model = whitening.fit(rows, 8)
    assert model.passes >= 3 and whitening.identity_error(rows, model) < 1e-4
    compare(whitening.whiten(frame(spark, x), components=6).collect(), x, 6, 1e-4)


def test_dependent_and_constant_entries(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 3)).astype(np.float32)
    x = np.concatenate([base, base[:, :1], np.full((90, 1), 7, np.float32)], 1)
    got = whitening.whiten(frame(spark, x)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)
    compare(got, x, 3)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    good = frame(spark, x)
    bad = spark.createDataFrame([(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = good.unionByName(bad).withColumns({"component": F.lit("c"), "n": F.lit(1), "x": F.lit("x")})
    got = whitening.whiten(rows).collect()
    assert {r.vec_id for r in got} == set(range(40))
    compare(got, x, 3)
    twice = whitening.whiten(good.unionByName(good)).collect()
    assert len(twice) == 240 and all(r.n == 80 and r.identity_error < 1e-9 for r in twice)
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == whitening.whiten(one.limit(0)).count() == whitening.whiten(bad.where("vec_id = 104")).count() == 0


def test_partial_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    x = np.random.default_rng(7).normal(size=(60, 4)).astype(np.float32)
    got = whitening.whiten(frame(spark, x).repartition(14)).collect()
    compare(got, x, 4)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    place = {r.vec_id: k for k, r in enumerate(rows)}
    x = np.array([r.embedding for r in rows], np.float32)
    got = QUERIES["op13_whitening"](spark, SF).collect()
    want, explained = plain_whitening(x)
    w = np.zeros_like(want)
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-6 and {r.identity_error for r in got}.pop() < 1e-9
    assert "op13_whitening" not in ORACLE_SQL


def test_sums_of_squares_beyond_a_long():
    x = np.array([[3, -4], [3 << 30, 0], [3 << 30, 1 << 30], [1 << 40, -(1 << 41)], [0, 0]], np.int64)
    assert [int(v) for v in whitening.squares(x).to_pylist()] == [sum(int(v) ** 2 for v in row) for row in x]
    assert [int(v) for v in whitening.squares(x[:2]).to_pylist()] == [25, 9 << 60]
    assert not len(whitening.squares(x[:0]))
