"""The manifest against a tree built row by row, on awkward rows and on trees of several buckets."""

import zlib
from collections import defaultdict
from hashlib import sha256

from inkfold.llm import manifest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, k string, i long, leaf string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(nodes, paths):
    """The top of a tree, and for each node its siblings on the way, with those before it apart."""
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for x, own in enumerate(at):
            run = nodes[own // 8 * 8 : own // 8 * 8 + 8]
            paths[x].append((run[: own % 8], run[own % 8 + 1 :]))
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [own // 8 for own in at]
    return nodes[0]


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r, leaf_of(r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops, paths = [], {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        paths[lang] = [[] for _ in by_lang[lang]]
        tops.append(climbed([h for _, h in by_lang[lang]], paths[lang]))
    upper = [[] for _ in langs]
    root = climbed(tops, upper)
    out = []
    for lang, top, above in zip(langs, tops, upper, strict=True):
        for (r, leaf), path in zip(by_lang[lang], paths[lang], strict=True):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = leaf_of((*r[:4], text))
            for left, right in path + above:
                now = digest(*left, now, *right)
            out.append((r[0], leaf, top, root, digest(*[h for left, right in path + above for h in left + right]), now, now == root))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, lang, s, n, "clash", 7, "clash") for d, s, lang, n, t in rows], KINDS).repartition(4)
    got = sorted((tuple(r) for r in manifest.manifest(df).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    return got


def test_manifest_against_plain_trees(spark):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(1100)]  # three buckets, the last one short
    rows += [(i, "s", "de", 3, f"Äb {i}") for i in range(512)] + [(i, "s", "fr", 3, f"x {i}") for i in range(513)]  # a full bucket; one leaf over
    rows += [(i, None, None, None, None) for i in range(9)] + [(5000, "s", "", 0, ""), (5001, "s", "Zz", 1, "ALONE É"), (None, "s", "en", 1, "No id"), (3, "s", "en", 3, "Text 3"), (3, "s", "en", 3, "Text 3")]
    rows += [(6000, "s", "long", 1, "W " * 150_000), (6001, "a:b", "long", -1, "7:x")] + [(7000 + i, "s", f"l{i:02d}", 1, "T") for i in range(12)]
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_empty_table(spark):
    got = check(spark, [(1, "s", "en", 1, "t")])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha256(b"").hexdigest()
    assert manifest.manifest(spark.createDataFrame([], KINDS)).count() == 0
