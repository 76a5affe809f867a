"""Cases at the edges of several operators: repetitive and very long lines, extreme vectors, targets out of reach, against solvers beside them."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkfold.llm import ann, decontaminate, line_dedup, mixture, queries, substring_dedup, suffix_dedup, warc
from inkfold.llm.common import table


def removed(spark, lines):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(lines)], "doc_id long, text string, id string, line int").repartition(3)
    return {r.doc_id for r in line_dedup.dedup_lines(df, least_chars=1).where("n_removed > 0").collect()}


def jaccard(a, b):
    a, b = ({x[i : i + 10] for i in range(max(1, len(x) - 9))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_repetitive_lines_are_compared(spark):
    kinds = [["-" * (80 + i) for i in range(60)], ["| -- " * (12 + i % 9) + "#" * (i % 4) for i in range(60)], ["0, 0.5, " * (9 + i % 7) + str(i % 3) for i in range(60)]]
    lines = [x for some in kinds for x in some]
    gone = removed(spark, lines)
    like = {i for i in range(1, len(lines)) if any(jaccard(lines[i], lines[j]) >= 0.8 for j in range(i))}
    assert len(like & gone) >= 0.99 * len(like) > 30


def test_a_crowd_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch):
    rng, asked = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(60)]
    lines = []
    for _ in range(160):  # two copies share about 0.75 of their shingles, some pairs 0.8
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            copy[at] = word()
        lines.append(" ".join(copy))
    plain = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *given: asked.append(pairs.count()) or plain(pairs, *given))
    up = list(range(len(lines)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(lines)):
        for j in range(i):
            if jaccard(lines[i], lines[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert removed(spark, lines) == {i for i in range(len(lines)) if find(i) != i}
    assert sum(asked) < 8 * len(lines)


def test_very_long_lines_and_empty_table(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
    assert removed(spark, ["x" * 200_000, "y" * 30, "x" * 200_001, long, long.replace("w7919 ", "w7918 ")]) == {2, 4}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string, id string")).count() == 0


def test_extreme_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 4))
    factors = [1.0, 1e308, 1e-308, 5e307, 1e-300]
    rows = [(i, (v / np.abs(v).max() * factors[i % 5]).tolist(), "clash", 0.0) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, score double")
    got = ann.nearest(df, every=10).collect()
    unit = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in rows])
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    for q in range(0, 60, 10):
        s = unit @ unit[q]
        s[q] = -2
        want = np.argsort(-s, kind="stable")[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want.tolist() and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
    assert ann.nearest(df.limit(0)).count() == 0


def objective(w, p, n, target, ridge):
    total = n.sum()
    r = (w * n) @ p / total - target
    return 0.5 * r @ r + 0.5 * ridge * (n / total * (w - 1) ** 2).sum()


def test_rates_against_a_plain_solver(spark):
    sf = "/root/testdata/sf0.001"
    labels = queries.quality_domains(spark, sf)
    rows = mixture.mixture(table(spark, sf, "documents"), labels, {"high": 0.3, "low": 0.7}).collect()
    p, n, w = np.array([[r.p_high, r.p_low] for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    target, ridge, total = np.array([0.3, 0.7]), 1e-3, n.sum()
    best = np.ones(len(n))
    for _ in range(20_000):  # projected gradient in the metric of the tokens
        r = (best * n) @ p / total - target
        best = np.maximum(0, best - 0.9 * (p @ r + ridge * (best - 1)))
    assert (w >= 0).all() and objective(w, p, n, target, ridge) <= objective(best, p, n, target, ridge) * 1.02 + 1e-7
    assert np.abs((w * n) @ p / (w * n).sum() - target).max() < 0.02


def test_repeats_are_bounded(spark):
    rows = [(i, " ".join(f"plain{j % 50}" for j in range(40)), "x", 1) for i in range(80)] + [(100 + i, "### $$$ !!! " * 9, "x", 1) for i in range(3)] + [(200, None, "x", 1), (201, "", "x", 1), (202, "w " * 100_000, "x", 1), (5, " ".join(f"plain{j % 50}" for j in range(40)), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, p int")
    labels = spark.createDataFrame([(i, "high" if i < 80 else "low") for i in [*range(60), 100, 101, 102]], "doc_id long, domain string")
    got = mixture.mixed(docs, labels, {"high": 0.05, "low": 0.95}, most=4.0)
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert got.columns == docs.columns and set(counts) == {r[0] for r in rows} and max(c for i, c in counts.items() if i != 5) <= math.ceil(4.0)
    assert mixture.mixed(docs.where(F.lit(False)), labels, {"high": 0.05, "low": 0.95}).count() == 0


def test_long_repeated_and_no_rows(spark):
    """Very long texts, repeated rows, empty tables and columns of inner names, for the operators that read texts."""
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ao", "ei", "ou", "ia", "un", "er")]
    passage = " ".join(rng.choice(words, 80))
    long = " ".join(rng.choice(words, 60_000)) + " " + passage
    rows = [(1, long), (2, "start " + passage + " end"), (3, None), (4, ""), (5, "short"), (5, "short")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, packed string, doc long, bin int").repartition(2)
    empty = docs.limit(0)
    hit = {r.doc_id: (r.n_repeated, r.n_words) for r in substring_dedup.repeated_passages(docs).collect()}
    assert hit[1][0] >= 80 and hit[2][0] >= 80 and hit[3] == (0, 0) and hit[1][1] == 60_080 and substring_dedup.repeated_passages(empty).count() == 0
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1][0] == len(long) and len(passage) <= cut[1][1] <= len(passage) + 4 and cut[2][1] >= len(passage) and cut[4] == (0, 0) and suffix_dedup.remove_repeats(empty).count() == 0
    items = spark.createDataFrame([(7, passage, "x"), (8, None, "x"), (9, "!!! ---", "x"), (7, passage, "x")], "item_id long, text string, doc_id string")
    found = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect())
    assert found == [(1, 7, 0), (1, 7, 0), (2, 7, 0), (2, 7, 0)]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", "p" * 3_000_000, 0), (2, "u", "p" * 3_000_000, 0), (3, "v", None, 0), (3, "v", None, 0)], "page_id long, url string, html string, payload_bytes int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    assert got == [(1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), (3, 0, "response", None), (3, 0, "response", None)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_windows_of_a_frequent_line_do_not_all_meet():
    rng = np.random.default_rng(3)
    line = [f"l{i}" for i in range(12)]
    texts = [[*(f"a{x}" for x in rng.random(50)), *line, *(f"b{x}" for x in rng.random(50))] for _ in range(300)]
    for i in range(0, 40, 2):  # near copies: one word differs
        texts[i + 1][20:90] = [*texts[i][20:40], "changed", *texts[i][41:90]]
    runs = [["x"] * int(n) + [f"c{x}" for x in rng.random(60)] for n in rng.integers(30, 45, 200)]
    tokens = substring_dedup.tokens_of([" ".join(t) for t in (*texts, *runs)], 5)
    rows = substring_dedup.compact_windows(tokens, np.arange(len(tokens)), 46, 6)
    own, hits, opened = substring_dedup.hits_of(rows)
    pairs = {*zip(own.tolist(), hits["other"].tolist(), strict=True)}
    seen = np.concatenate([substring_dedup.seen_by(t, opened[opened["doc"] == i], 46) for i, t in enumerate(tokens)])
    for own, hits in substring_dedup.near_hits(seen, 46):
        pairs |= {*zip(own.tolist(), hits["other"].tolist(), strict=True)}
    assert {(i + 1, i) for i in range(0, 40, 2)} <= pairs and len(pairs) < 100  # 44,850 pairs share the line, 19,900 the run
