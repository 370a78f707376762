import math
import random

import pytest
import xxhash

from loremill.llm import simhash
from loremill.llm.simhash import drop_near_duplicates, fingerprints, near_groups, simhash_components, simhash_rows

from .helpers import ODD, docs, odd


def brute_print(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    ids = list(range(len(prints)))
    parent = ids[:]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


@pytest.mark.parametrize("cap", [1, 64])
def test_against_brute_force(spark, cap):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(120)]
    texts = base + [b.upper() for b in base[:10]] + ["", "  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = simhash_components(docs(spark, rows), list_cap=cap).collect()
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints)
    assert {r["k"]: (r["fps"][0] & (2**64 - 1), r["root"]) for r in got} == {i: (p, w) for i, (p, w) in enumerate(zip(prints, want))}


def test_odd_rows(spark):
    rows = simhash_rows(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[8]["component_id"] == 1
    assert by[9]["fingerprint"] == f"{brute_print(ODD[-1][1]):016x}"
    assert simhash_rows(odd(spark).where("false")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [[word() for _ in range(400)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(20):
        copy = texts[i][:]
        copy[rng.randrange(400)] = word()
        rows.append((100 + i, " ".join(copy)))
    kept = {r["doc_id"] for r in drop_near_duplicates(docs(spark, rows)).collect()}
    assert set(range(40)) <= kept
    assert kept == set(range(40))
    assert drop_near_duplicates(odd(spark)).columns == odd(spark).columns


def test_rows_go_not_doc_ids(spark):
    a, b, c = " ".join(map(str, range(90))), " ".join(map(str, range(100, 190))), " ".join(map(str, range(200, 290)))
    rows = [(1, a), (2, a + " "), (2, b), (None, c), (None, a + "  "), (5, b + " "), (5, b + " ")]
    left = drop_near_duplicates(docs(spark, rows).withColumnsRenamed({"lang": "k", "source": "h1", "n_chars": "H2"})).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted([("None", a + "  "), ("2", b), ("None", c)])
    assert {r["h1"] for r in left} <= {"s0", "s1", "s2"} and {r["k"] for r in left} == {"en"}
    again = drop_near_duplicates(docs(spark, [(7, a), (7, a), (8, b)]))
    assert sorted(r["doc_id"] for r in again.collect()) == [7, 8]


def test_no_link_is_lost_through_a_third_text(spark):
    # the words of 1 in two other orders: 2 and 3 are alike, 4 and 5 are alike, and none is like 1
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    second, third = rng.sample(words, 60), rng.sample(words, 60)
    rows = [(1, " ".join(words)), (2, " ".join(second)), (3, "  ".join(second)), (4, " ".join(third)), (5, "  ".join(third))]
    got = {r["k"]: r["root"] for r in near_groups(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_recall_on_a_whole_table_by_true_similarity(spark, sf):
    # every pair of texts with a true Jaccard similarity of 0.8 or more, from sets of shingles
    table = sf.replace("sf0.001", "sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{table}/documents.parquet").collect()]
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    together = {(a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    alike = [(a, b) for a, b in together if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    different = [(a, b) for a, b in alike if words[a] != words[b]]
    root = {r["k"]: r["root"] for r in near_groups(docs(spark, rows)).collect()}
    assert different and sum(root[a] == root[b] for a, b in alike) >= 0.98 * len(alike)
    assert sum(root[a] == root[b] for a, b in different) >= 0.9 * len(different)
    # and nothing is in a group that has no partner at 0.7 or more in it
    partner = {i for a, b in together if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) for i in (a, b)} | {i for i, s in sets.items() if not s}
    sizes = {}
    for r in root.values():
        sizes[r] = sizes.get(r, 0) + 1
    assert all(sizes[r] == 1 or i in partner for i, r in root.items())


def test_count_filter(spark):
    sets = simhash.position_sets()
    assert len(sets) == 14 and all(sum(set(t) <= set(s) for s in sets) == 1 for t in __import__("itertools").combinations(range(8), 3))
    base = 0x0123456789ABCDEF
    flips = [0, 1, 1 | 1 << 8, 1 | 1 << 8 | 1 << 16, 1 | 1 << 8 | 1 << 16 | 1 << 24, 0xFF]
    nodes = spark.createDataFrame([(base ^ f, n) for n, f in enumerate(flips)], "fp long, rep long")
    got = {(r["x"]["rep"], r["y"]["rep"]): r["shared"] for r in simhash.tallied(simhash.postings(nodes)).collect()}
    norm = {tuple(sorted(k)): v for k, v in got.items()}
    differ = lambda a, b: sum((flips[a] ^ flips[b]) >> 8 * i & 255 != 0 for i in range(8))
    want = {(a, b): (14, 7, 3)[differ(a, b)] for a in range(6) for b in range(a + 1, 6) if differ(a, b) <= 2}
    assert norm == want  # three differing bytes share one posting and are filtered out, five share none
    linked = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(nodes).collect()}
    assert linked == {(a, b) for a, b in want if bin(flips[a] ^ flips[b]).count("1") <= 2}


def test_extra_fingerprints_differ():
    a = fingerprints("one two three four five six", 3, 3)
    assert len(a) == len(set(a)) == 4


def _shingles(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("edit", ["append", "cut", "replace", "scatter"])
def test_copies_with_every_kind_of_edit_are_found(spark, edit):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, alike = [], []
    for i in range(60):
        text = [word() for _ in range(rng.randint(150, 600))]
        n = len(text) // 9
        at = rng.randrange(len(text) - n)
        copy = text[:]
        if edit == "append":
            copy += [word() for _ in range(n)]
        elif edit == "cut":
            copy = copy[: len(copy) - n]
        elif edit == "replace":
            copy[at : at + n // 2] = [word() for _ in range(n // 2)]
        else:
            for _ in range(max(1, len(text) // 60)):
                copy[rng.randrange(len(copy))] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        a, b = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.8:
            alike.append(i)
    root = {r["k"]: r["root"] for r in near_groups(docs(spark, rows)).collect()}
    assert len(alike) > 40
    assert sum(root[2 * i + 1] == 2 * i for i in alike) >= 0.99 * len(alike)
    # and no others
    assert {k for k, r in root.items() if k != r} <= {2 * i + 1 for i in alike}


@pytest.mark.parametrize("cap", [1, 64])
def test_every_pair_that_meets_is_decided(spark, cap, monkeypatch):
    # chains from one text: neighbours are alike, the ends are not, and all share a long common part
    monkeypatch.setattr(simhash, "RUN", 8)
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = []
    for family in range(2):
        core = [word() for _ in range(240)]
        for chain in range(12):
            text = core[:]
            at = rng.randrange(200)
            text[at : at + 40] = [word() for _ in range(40)]
            for _ in range(4):
                rows.append((len(rows), " ".join(text)))
                at = rng.randrange(225)
                text[at : at + 14] = [word() for _ in range(14)]
    rng.shuffle(rows)
    got = {r["k"]: r["root"] for r in near_groups(docs(spark, rows), list_cap=cap).collect()}
    keys = {i: simhash.band_keys(simhash.shingle_hashes(t, 5)) for i, t in rows}
    sigs = {i: fingerprints(t, 5, simhash.NUMBER - 1) for i, t in rows}
    share = math.acos(1.6 / 1.8) / math.pi
    most, stray = int(64 * simhash.NUMBER * share), 4 * math.sqrt(64 * simhash.NUMBER * share * (1 - share))
    sets = {i: _shingles(t) for i, t in rows}

    def groups(near):
        root = {i: i for i, _ in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        failed = 0
        for a, _ in rows:
            for b, _ in rows:
                if a < b and any(p == q for p, q in zip(keys[a], keys[b])):
                    d = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(sigs[a], sigs[b]))
                    if near(d, len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
                    else:
                        failed += 1
        return {i: find(i) for i, _ in rows}, failed

    exact, failed = groups(lambda d, true: d <= most - stray or d <= most + stray and true)
    assert failed > 100 and 2 < len(set(exact.values())) < len(rows)
    if cap > 1:
        assert got == exact
    else:  # long lists: by signatures, and exactly with the list's hub
        least, most_of_all = groups(lambda d, _: d <= most)[0], groups(lambda d, true: d <= most or d <= most + stray and true)[0]
        assert all(got[i] == got[r] for i, r in least.items()) and all(most_of_all[i] == most_of_all[r] for i, r in got.items())


def test_near_copies_meet_in_the_index_without_any_band(spark):
    # no bands here: only the byte-position index and its tally bring the copies together
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(900)] for _ in range(6)]
    rows = [(2 * i, " ".join(t)) for i, t in enumerate(texts)] + [(2 * i + 1, " ".join(t[:-1] + ["end"])) for i, t in enumerate(texts)]
    close = [2 * i for i in range(6) if (fingerprints(rows[i][1], 5)[0] ^ fingerprints(rows[6 + i][1], 5)[0]).bit_count() <= 2]
    nodes = spark.createDataFrame([(n, fingerprints(t, 5, simhash.NUMBER - 1)) for n, (_, t) in enumerate(rows)], "rep long, sig array<long>")
    got = {(r["a"], r["b"]) for r in simhash.index_pairs(nodes).collect()}
    assert len(close) > 2 and {(k // 2, 6 + k // 2) for k in close} <= got
