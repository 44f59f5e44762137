import random

import pytest
from xxhash import xxh64_intdigest

from carpalake.llm.simhash import drop_near, near_groups, near_links

SCHEMA = "doc_id long, text string, id int, least string"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    least = {f: f for f in fps}

    def top(f):
        while least[f] != f:
            f = least[f]
        return f

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("bucket", [4096, 9])
def test_links_connect_what_all_links_connect(spark, bucket):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(3):
        at = rng.getrandbits(64)
        for k in range(120):
            half = rng.choice([0, 32])
            fps.add(at ^ sum(1 << b for b in {rng.randrange(32) + half if k % 2 else rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 5]))}))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = {f - (f >> 63 << 64): f for f in fps}
    got = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket).distinct().collect()
    least = {f: f for f in fps}

    def top(f):
        while least[f] != f:
            f = least[f]
        return f

    for r in got:
        a, b = signed[r.a], signed[r.b]
        assert (a ^ b).bit_count() <= 3
        x, y = sorted((top(a), top(b)))
        least[y] = x
    assert {f: top(f) for f in fps} == classes(fps)


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "É"]
    out = [(0, None, 1, "x"), (1, "", 1, None), (2, " \n\t ", 1, None), (3, "One", 1, None), (4, "one two", 1, None), (5, "ONE  two\nthree", 1, None), (6, "one two three", 1, None), (6, "one two three", 1, None)]
    for i in range(10, 60):
        text = [rng.choice(words) for _ in range(rng.choice([5, 80, 400]))]
        out.append((i, " ".join(text), 1, "x"))
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "changed"
            out.append((i + 100, "\n".join(text), 1, "x"))
    out.append((999, " ".join(rng.choice(words) for _ in range(120_000)), 1, "x"))
    return out


def test_groups_against_brute_force(spark):
    data = rows()
    fps = {}
    for r in data:
        fps.setdefault(plain_fingerprint(r[1]), []).append(r[0])
    cls = classes(fps)
    first = {}
    for f, ids in fps.items():
        first[cls[f]] = min(ids + [first.get(cls[f], 10**9)])
    got = near_groups(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((r[0], f"{plain_fingerprint(r[1]):016x}", first[cls[plain_fingerprint(r[1])]]) for r in data)
    kept = drop_near(spark.createDataFrame(data, SCHEMA), text_col="text")
    assert kept.columns == ["doc_id", "text", "id", "least"]
    assert {r.doc_id for r in kept.collect()} == set(first.values())


def test_null_ids_and_empty_table(spark):
    got = near_groups(spark.createDataFrame([(None, "a b c d", 1, ""), (None, None, 1, ""), (4, "", 1, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (None, 4, False), (4, 4, True)}
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
