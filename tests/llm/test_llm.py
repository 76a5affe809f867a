"""Operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import ann, decontaminate, graph, jaccard_join, line_dedup, mixture, queries, rans, substring_dedup, suffix_dedup, toxicity, warc
from inkfold.llm.common import Scratch
from inkfold.llm.queries import tokenizer_file

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choices("abcdeghimnorstu", k=RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCABULARY, k=n))


def documents(spark):
    """Copies, near copies, shared passages, empty, null, very long and repeated rows; extra and clashing columns."""
    rng = random.Random(9)
    base, passage = [prose(120, rng) for _ in range(12)], prose(90, rng)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " tail"), (22, base[1].upper()), (23, prose(30, rng) + " " + passage), (24, passage + " " + prose(40, rng)), (25, passage)]
    words = base[2].split()
    for i in range(4):
        w = list(words)
        w[30 * i] = "edited"
        rows.append((30 + i, " ".join(w)))
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "one two"), (43, "one two"), (44, "x" * 5000), (45, prose(3000, rng)), (46, "a b\x0bc  d\r\n é ü — 's it's <|endoftext|> x"), (None, base[3]), (47, base[4] + "\n" + base[4])]
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long")


def empty(spark):
    return documents(spark).limit(0)


# --- 1 --------------------------------------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    long = "<p>" + "y" * 200
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "u\r\nv", "s" * 99), (2, "u", "s" * 99), (4, "u", None), (7, "u", ""), (8, "ü", "é\r\n\r\nWARC/1.1"), (3, "http://b", long)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    data = lambda h: (h or "").encode()
    want = sorted((p, len(data(h)), hashlib.sha256(data(h)).hexdigest(), "revisit" if h == long and p != 3 else "response", 3 if h == long and p != 3 else None) for p, _, h in rows)
    assert got == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(tmp_path, zip64):
    path = str(tmp_path / "a.zip")
    with open(path, "wb") as f:
        z = warc.ZipWriter(f, zip64)
        z.add("one/é.txt", [b"abc", b"PK\x05\x06 inside"])
        z.add("two", [b""])
        z.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("one/é.txt") == b"abcPK\x05\x06 inside"
    with warc.ZipReader(path) as z:
        assert list(z.members) == ["one/é.txt", "two"] and z.member("one/é.txt") == b"abcPK\x05\x06 inside" and z.member("two") == b""


def test_zip_of_others(tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("s", b"stored" * 9)
        z.writestr("d", b"deflated" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    with warc.ZipReader(str(tmp_path / "b.zip")) as z:
        assert z.member("s") == b"stored" * 9
        with pytest.raises(ValueError):
            z.member("d")


# --- 2 --------------------------------------------------------------------------------------------------------------
def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog and runs far away from the noisy town"
    near = a[:-1] + "ns"
    far = "an entirely different sentence that has nothing to do with any other one in here"
    rows = [(1, f"{a}\nshort\n{far}"), (2, f"{near}\nshort"), (3, f" {a} \nshort\n\n"), (4, None), (5, ""), (6, far), (6, far)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(1, 3, []), (2, 2, [0]), (3, 4, [0]), (4, 0, []), (5, 1, []), (6, 1, [0]), (6, 1, [0])]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    kept = line_dedup.kept_text(docs.where("doc_id in (1, 2)"), line_dedup.dedup_lines(docs)).orderBy("doc_id").collect()
    assert [r.text for r in kept] == [rows[0][1], "short"]


def jaccard_10(x, y):
    a, b = ({t[i : i + 10] for i in range(max(1, len(t) - 9))} for t in (x, y))
    return len(a & b) / len(a | b)


def test_line_bands_are_compared_whole(spark):
    rng = random.Random(5)
    frame, rows = prose(14, rng), []
    for i in range(60):  # a template and pairs of near copies in it: bands hold many unlike lines
        line = f"{frame} {prose(14, rng)}"
        rows += [(2 * i, line), (2 * i + 1, line[:-1] + "#")]
    for i in range(200):  # one word changed
        w = prose(26, rng).split()
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join([*w[:12], "y", *w[13:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    up = {i: i for i, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if jaccard_10(x, y) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = {i for i in up if find(i) != i}
    got = {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed > 0").collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_short_lines_take_part(spark, tmp_path):
    rows = [(1, "short\nx\n\nfifteen letters"), (2, "x\n\nshort "), (3, "fifteen letters\nfifteen_letters\nshor")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, 4, []), (2, 3, [0, 2]), (3, 3, [0])]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2040)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    for limit in (400_000, 0):
        got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), broadcast_rows=limit)
        assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in up}


# --- 3 --------------------------------------------------------------------------------------------------------------
def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(map(repr, zip([r.doc_id for r in rows], brute_repeats([r.text for r in rows], 200))))
    for limit in (24 << 20, 0):
        got = suffix_dedup.remove_repeats(docs, broadcast_bytes=limit).collect()
        assert sorted(repr((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))) for r in got) == want
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_collection_bwt():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 40, 25)]
    size = np.array([len(s) for s in strings])
    bwt = suffix_dedup.collection_bwt(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)
    suffixes = sorted((s[j:], i, s[j - 1] + 1 if j else 0) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert bwt.tolist() == [c for _, _, c in suffixes]


# --- 4 --------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words, bad = prose(60, rng).split(), i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zwurgel", "plokkig", "vrabbix"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "plokkig zwurgel"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(rows)
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_toxicity_of_awkward_texts():
    rng = random.Random(6)
    model = toxicity.fit([(prose(40, rng) + (" plokkig vrabbix" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)])
    scorer = toxicity.Scorer(model)
    long = " ".join(prose(50, rng) for _ in range(2000))
    found = scorer([None, "", "!?", "x" * 100_000, long, long])
    assert all(0 <= x <= 1 for x in found) and found[0] == found[1] == found[2] and found[4] == found[5]
    assert scorer([]) == [] and toxicity.windows("x" * 100) == toxicity.windows(" ".join(["x" * 48] * 2 + ["x" * 4]))


# --- 5 --------------------------------------------------------------------------------------------------------------
def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:140] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (5200, []), (None, [1.0] * 24), (5250, [1.0, 2.0]), (5300, [2.0, 4.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=400).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(1))
    hit = total = 0
    for q in range(0, 1500, 50):
        s = d @ d[q] / norm / norm[q]
        s[q] = -9
        best = sorted(range(1500), key=lambda i: (-round(s[i], 12), i))[:5]
        hit, total = hit + len(set(best) & {i for i, _ in found[q]}), total + 5
        assert all(abs(v - s[i]) < 1e-12 for i, v in found[q])
    assert hit / total >= 0.9
    assert [i for i, _ in found[50]] == [100, 101, 102, 103, 104] and [i for i, _ in found[100]] == [50, 101, 102, 103, 104]
    assert [i for i, _ in found[5250]] == [5300] and not {5000, 5050, 5100, 5150, 5200} & found.keys()


# --- 6 --------------------------------------------------------------------------------------------------------------
def distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_substring_distance():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(1, 12))), rng.integers(0, 4, int(rng.integers(0, 20)))
        d, s, e = decontaminate.substring_distance(a, b)
        assert d == distance(a.tolist(), b.tolist()) and 0 <= s <= e <= len(b) and distance(a.tolist(), b[s:e].tolist()) <= d


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, prose(rng.randint(14, 50), rng)) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs, want = [], set()
    for i in range(60):
        text = prose(80, rng).split()
        if i % 3 == 0:
            item = items[i % 12][1].split()
            for _ in range(len(item) // 8 if i % 2 else 0):
                item[rng.randrange(len(item))] = rng.choice(VOCABULARY)
            at = rng.randrange(80)
            text[at:at] = [w.capitalize() + "," for w in item]
            want.add((i, i % 12))
        docs.append((i, " ".join(text)))
    docs += [(70, None), (71, "")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    brute = {(i, k) for i, t in docs for k, x in items if x and len(x.split()) >= 8 and distance([w.strip(",").lower() for w in x.split()], [w.strip(",").lower() for w in (t or "").split()]) <= int(len(x.split()) * 0.2 + 1e-9)}
    assert want <= brute and got <= brute and len(got) >= 0.95 * len(brute)
    for size in (8 << 20, 500):
        assert {r.doc_id for r in decontaminate.clean_documents(d, b, block_bytes=size).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.clean_documents(d, b.limit(0)).count() == len(docs)


# --- 7 --------------------------------------------------------------------------------------------------------------
def test_repeated_passages(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.n_words): r for r in substring_dedup.repeated_passages(docs).collect()}
    texts = {r.doc_id: (r.text or "").lower().split(" ") for r in docs.collect() if r.doc_id is not None and r.doc_id < 40}
    seen = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    for i, w in texts.items():
        covered = {j + x for j in range(len(w) - 49) if len(seen[tuple(w[j : j + 50])]) > 1 for x in range(50)}
        r = got[i, len(w)]
        assert covered <= {x for s, e in zip(r.starts, r.ends) for x in range(s, e)}
    assert not got[45, 3000].n_passages and not got[43, 2].n_passages and got[30, 120].n_repeated >= 50
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_passage_among_frequent_lines(spark):
    rng = random.Random(8)
    frequent = [prose(8, rng) for _ in range(6)]

    def mixed_text(own):
        return " ".join(f"{line} {own()}" for line in rng.sample(frequent, 6))

    rows = [(i, mixed_text(lambda: " ".join(f"u{rng.random()}" for _ in range(6)))) for i in range(150)]
    shared = [mixed_text(lambda: " ".join(f"s{rng.random()}" for _ in range(4))) for _ in range(30)]
    for i, p in enumerate(shared):
        rows += [(1000 + 2 * i, f"{prose(20, rng)} {p} {prose(20, rng)}"), (1001 + 2 * i, f"{prose(30, rng)} {p} {prose(5, rng)}")]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(shared[0].split())
    for i in range(30):
        for d, start in ((1000 + 2 * i, 20), (1001 + 2 * i, 30)):
            assert set(range(start, start + n)) <= {x for s, e in zip(got[d].starts, got[d].ends) for x in range(s, e)}


def test_near_passages_of_one_changed_word(spark):
    rng, rows = random.Random(12), []
    for i in range(300):
        w = [f"p{rng.random()}" for _ in range(50)]
        for side, middle in enumerate((w, [*w[:24], "changed", *w[25:]])):  # 41 of 51 shingles are common
            rows.append((2 * i + side, " ".join([*(f"a{rng.random()}" for _ in range(60)), *middle, *(f"b{rng.random()}" for _ in range(60))])))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("n_passages > 0").count()
    assert got >= 0.99 * len(rows)


# --- 8 --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [32 << 20, 3000])
def test_jaccard_join(spark, chunk):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(repr((d, len(sets[i]), d if not sets[i] else least.get(find(i), d))) for i, (d, _) in enumerate(rows))
    got = jaccard_join.jaccard_join(docs, chunk_bytes=chunk).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_meeting_keys_are_lossless():
    rng = np.random.default_rng(6)
    bands = jaccard_join.Bands(85, 3000)
    for n in (1, 3, 6, 7, 12, 40, 333, 2500):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = a.copy()
            for _ in range(200):  # as far apart as the threshold lets
                c = np.unique(np.concatenate([np.delete(b, rng.integers(len(b))) if len(b) > 1 else b, rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64)]))
                if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                    break
                b = c
            for share in (0, 0.3, 0.9, 1):  # of frequent shingles
                frequent = jaccard_join.Frequent(a[rng.random(len(a)) < share])
                keys, nodes = jaccard_join.meeting_keys([a, b], np.array([1, 2]), bands, frequent)
                assert np.array_equal(a, b) or np.intersect1d(keys[nodes == 1], keys[nodes == 2]).size


def test_keep_one(spark):
    docs = documents(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 20 not in ids and 31 not in ids and {0, 2, 30 - 30, 45, 40, 41, 42} <= set(ids) and ids.count(43) == 1


def test_keep_one_decides_by_row(spark):
    words = prose(80, random.Random(1)).split()
    a, near, other = " ".join(words), " ".join([*words[:-1], "end"]), prose(80, random.Random(2))
    rows = [(3, a, "x"), (5, near, "x"), (5, other, "x"), (3, a, "y"), (None, near, "x"), (7, None, "x"), (7, "", "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, other), (7, None), (7, ""), (7, "")], key=str)
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 63, 64, 5000, 40_000])
def test_rans_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=5001))
    data = rans.encode_block(ids, table, every=4)
    assert np.array_equal(rans.decode_block(data, table), ids)
    marks = rans.BLOCK.unpack_from(data)[3]
    if marks > 1:
        parts = [rans.decode_block(data, table, -1, 0), *[rans.decode_block(data, table, k, k + 1) for k in range(marks - 1)], rans.decode_block(data, table, marks - 1)]
        assert np.array_equal(np.concatenate(parts), ids)
    with pytest.raises(ValueError):
        broken = bytearray(data)
        broken[-1 if n > 64 else rans.BLOCK.size] ^= 255
        rans.decode_block(bytes(broken), table)


def test_token_output(spark):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    docs = documents(spark)
    for r in sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = rans.token_output(docs, tokenizer_file(), tokens_per_file=3000).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert rans.token_output(empty(spark), tokenizer_file()).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------
def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, prose(50, rng) if i % 4 else " ".join(str(rng.randrange(10**6)) for _ in range(50))) for i in range(400)]
    docs = spark.createDataFrame([*[(*r, 0.5) for r in rows], (500, None, 0.5), (501, "", 0.5), (None, "a b", 0.5)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, "prose" if i % 4 else "numbers") for i in range(200)] + [(None, "prose"), (7, None)], "doc_id long, domain string")
    got = mixture.mixture(docs, labels, {"prose": 0.5, "numbers": 0.5}).toPandas()
    assert len(got) == 403 and (got.rate >= 0).all()
    weight = got.rate * got.n_tokens
    assert abs((weight * got.p_numbers).sum() / weight.sum() - 0.5) < 0.01
    more = mixture.mixed(docs, labels, {"prose": 0.5, "numbers": 0.5})
    counts = more.groupBy("doc_id").agg(F.count("*").alias("n")).toPandas().set_index("doc_id").n
    assert more.columns == docs.columns and len(counts) == 403 and counts.min() == 1 and counts.loc[[i for i in range(0, 400, 4)]].mean() > 2
    assert mixture.mixture(docs.limit(0), labels, {"prose": 1.0}).count() == 0


def test_words_encoded_apart():
    """Texts of all kinds of white space, words cut at runs of a few characters: the ids of the library."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, words, draw = Tokenizer.from_file(tokenizer_file()), rans.Words(tokenizer_file(), "<u2"), random.Random(1)
    bits = ["a", "b.", "don't", "'s", "x'll", "123", "\u00e9", "\u65e5\u672c", "\u0120", "|", "...", " ", " ", "\n", "  ", "\t", "\x1c", "\x85", "\u200b", "<|endoftext|>"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(3000)] + ["a b\nc " * 50 + "d"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert words.encode(pa.array(texts)) == want
    words.most = 7
    assert words.encode(pa.array(texts)) == want


def test_word_hashes():
    """Equal words and only they have equal hashes: words of one byte to many hundred, nulls, empty texts, slices."""
    import pyarrow as pa
    from inkfold.llm import shingles

    texts = ["ignored", None, "", " \t", "A b a", "\u00c9 \u00e9 x\u00a0y", "w" * 8 + " " + "w" * 9, "y" * 600 + "\n" + "y" * 601 + " Y" + "y" * 599]
    h, counts = shingles.word_hashes(pa.array(texts).slice(1))
    split = [(t or "").encode().lower().split() for t in texts[1:]]
    assert counts.tolist() == [len(x) for x in split]
    flat = [w for x in split for w in x]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert [len(s) for s in shingles.shingle_sets(["a b", "b a", "a a a a a a", None], 4)] == [1, 1, 1, 0]
    assert shingles.fingerprint([]).tolist() == []
