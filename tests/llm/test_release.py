"""The replay of conversations against a closed form, turn by turn, on awkward rows and on conversations cut into parts."""

import random
import zlib
from collections import defaultdict

import pytest

from inkfold.llm import release

KINDS = "conv_id long, turn long, text string, status string, p long, part string"


def plain(rows):
    """Each turn from its parent's delivery by formula; a release is a place in the sorted deliveries."""
    by_conv = defaultdict(list)
    for conv, turn, text in rows:
        by_conv[conv].append((turn, zlib.crc32((text or "").encode())))
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        h = lambda k, turn: zlib.crc32(f"{k}:{'null' if conv is None else conv}:{'null' if turn is None else turn}".encode())  # noqa: B023, E731
        found = []
        for p, (turn, crc) in enumerate(turns):
            back, start = h(0, turn) % 3, 7 * p
            if 0 < back <= p:
                parent = found[p - back]
                if parent[2] != "delivered":
                    found.append([conv, turn, "blocked", 0, None, None, None, None, crc])
                    continue
                start = max(start, parent[5])
            times = [start + 10 * (2**a - 1) for a in range(5)]
            faulty, mended = h(1, turn) % 101 < 35, 7 * p + h(2, turn) % 101
            good = [a for a, t in enumerate(times) if not faulty or (t >= mended and h(a + 3, turn) % 3)]
            last = good[0] if good else 4
            found.append([conv, turn, "delivered" if good else "dead", last + 1, start, times[last], None, None, crc])
        state = 0
        for k, (_, _, i) in enumerate(sorted((f[5], p, p) for p, f in enumerate(found) if f[2] == "delivered"), 1):
            state += k * found[i][8]
            found[i][6:8] = k, state
        out += [tuple(f[:8]) for f in found]
    return out


def conversations():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["a", "é" * 40, "", None, "x\ny"])) for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(500, t * 3, f"turn {t}") for t in range(700)]  # one long conversation with gaps
    rows += [(501, 4, "same"), (501, 4, "same"), (501, 4, "other"), (501, None, "no turn"), (None, 0, "nobody"), (None, 1, None), (502, 1, "w " * 150_000)]
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("split", [4096, 9])
def test_replay_against_formula(spark, split):
    rows = conversations()
    df = spark.createDataFrame([(c, t, x, "clash", 7, "clash") for c, t, x in rows], KINDS).repartition(4)
    got = sorted((tuple(r) for r in release.replay(df, split_turns=split).collect()), key=key)
    want = sorted(plain(rows), key=key)
    assert got == want
    assert {"delivered", "dead", "blocked"} == {r[2] for r in got}


def test_empty_table(spark):
    assert release.replay(spark.createDataFrame([], KINDS)).count() == 0


def test_state_wraps():
    assert release.wrapped(2**63) == -(2**63) and release.wrapped(2**63 - 1) == 2**63 - 1 and release.wrapped(5) == 5
