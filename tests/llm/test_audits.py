"""Both audits against plain Python over small tables with nulls, ties, copies and repeated rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from pricegrain.llm.filter_audit import corner, filter_audit, polynomial, shapley
from pricegrain.llm.source_audit import divergence, share, source_divergence

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def failing(docs):
    """Each document's failing filters, in plain Python."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield p or "", frozenset(c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if bad)


def test_filters(spark):
    rng = random.Random(2)
    say = lambda n, words: " ".join(rng.choices(words, k=n))
    many, few = [f"w{i}" for i in range(900)], ["Ab", "c", "😀é"]
    texts = [say(rng.choice([3, 199, 200, 320]), rng.choice([many, few, many + few])) + rng.choice(["", " #", "\x0b&", " "]) for _ in range(60)] + ["", None, " \t ", "A" * 300]
    docs = [(rng.choice([None, *range(90)]) if rng.random() < 0.1 else 100 + i, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(300)]
    docs += docs[:5] + [(3, "w " * 250, "s"), (3, "w " * 250, "t"), (4, "w " * 250, "t")]
    labels = [(rng.choice([None, *range(400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    want = {}
    rows = [(p, bad, d in good, d in toxic) for (d, *_), (p, bad) in zip(docs, failing(docs), strict=True)]
    for part in {r[0] for r in rows}:
        own, total = [r[1:] for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                out = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                total[c] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), sum(c in r[0] for r in own) - len(out), sum(r[0] == {c} for r in own), sum(r[1] for r in out), sum(r[2] for r in out))
        want |= {k: (*v, total[k[1][k[2] - 1]]) for k, v in want.items() if k[0] == part}
    d, marks = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, digest int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit(d, marks).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == want and len(found) == len(want)
    assert filter_audit(d.limit(0), marks).count() == 0


def test_polynomial():
    """Corners are unions, and Shapley values are means over orders."""
    rng = random.Random(4)
    counts = {m: rng.randint(0, 50) for m in range(32)}
    p = polynomial(counts)
    for used in range(32):
        assert corner(p, used) == sum(n for m, n in counts.items() if m & used)
    for i in range(5):
        gains = [sum(n for m, n in counts.items() if m >> i & 1 and not any(m >> j & 1 for j in order[: order.index(i)])) for order in permutations(range(5))]
        assert shapley(p, 1 << i) == Fraction(sum(gains), len(gains))


def test_divergence(spark):
    rng = random.Random(5)
    vocabulary = ["the", "The", "É", "é", "straße", "a1b", "x", "zz", "co-op", "日本", "rare"]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S", None]), rng.choice([None, "", "12 3", " ".join(rng.choices(vocabulary[: rng.randint(1, 11)], k=rng.randint(1, 30)))])) for _ in range(120)]
    docs += [("xx", "a", "one"), ("xx", "b", "two"), ("yy", "only", "w w w"), ("yy", "only", "w"), ("yy", "only", "w q")] + [("en", "s1", "long " * 20000)] * 3
    lang = lambda x: x or ""
    terms = [(lang(a), lang(b), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))) for a, b, t in docs]
    want = {}
    for la in {t[0] for t in terms}:
        df, whole = Counter(w for t in terms if t[0] == la for w in set(t[2])), Counter(w for t in terms if t[0] == la for w in t[2])
        kept = sorted(w for w, n in df.items() if n >= 3)
        p = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        of, q = {s: Counter(w for t in terms if t[:2] == (la, s) for w in t[2]) for s in {t[1] for t in terms if t[0] == la}}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in of.items():
            own = p(c)
            parts = {"pair": [(sum(f(own[w], other[w]) for w in kept), x) for x, other in ((x, p(d)) for x, d in of.items()) if x != s], "term": [(f(own[w], q[w]), w) for w in kept if c[w] and own[w] > q[w]]}
            for part, rows in parts.items():
                for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[: 4 if part == "term" else None], 1):
                    want[la, s, part, item] = (value, rank)
    d = spark.createDataFrame([(*x, 1) for x in docs], "lang string, source string, text string, term int")
    found = source_divergence(d, most_terms=4).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found} == want and len(found) == len(want)
    assert any(v[1] == 4 for k, v in want.items() if k[2] == "term") and ("xx", "a", "pair", "b") in want
    assert source_divergence(d.limit(0)).count() == 0


def test_large_shares(spark):
    """Counts whose product with a share's unit is over 64 bits."""
    n, total, v = 10**13 + 7, 3 * 10**13 + 1, 12345
    row = spark.createDataFrame([(n, total, v, 10**9 + 1, 1)], "n long, t long, v long, p long, q long").select(share(F.col("n"), F.col("t"), F.col("v")).alias("s"), divergence(F.col("p"), F.col("q")).alias("f")).first()
    assert row["s"] == 1 + 10**9 * (n + 1) // (total + v) and row["f"] == 10**18
