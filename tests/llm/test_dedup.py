import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers_llm import CLASHING, ODD, docs, documents, of
from pyspark.sql import functions as F

from tessella.llm import edit_fingerprint, exact_dedup, graph, jaccard_join, line_dedup


# --- exact ---


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t, *_ in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        keep = None if best[1] else best[2]
        kept = keep == i and len(t or "") == -best[0]
        out.append((i, keep, len(groups[key]), kept, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact(spark, small):
    for rows in (ODD, documents(small), []):
        df = docs(spark, rows, CLASHING)
        assert of(exact_dedup.exact_dedup(df), *NAMES) == plain_dedup(rows)
    df = docs(spark, ODD)
    for split in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") > 2, F.lit(False))):
        assert of(exact_dedup.exact_dedup(df, split), *NAMES) == plain_dedup(ODD)


def test_without_copies_keeps_one(spark):
    rows = of(exact_dedup.without_copies(docs(spark, ODD)), "doc_id", "text")
    assert [r[0] for r in rows].count(2) == 0 and [r[0] for r in rows].count(10) == 1  # the longer of the equal texts
    both = docs(spark, [(1, "a b"), (1, "a b"), (2, "c")])
    assert of(exact_dedup.without_copies(both), "doc_id") == [(1,), (2,)]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        sizes, bits, slots = exact_dedup.mph_build(keys)
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact_dedup.mph_slots(keys, sizes, bits) == slots).all()
        strangers = exact_dedup.mph_slots(rng.integers(0, 1 << 63, (20, 4), dtype=np.uint64), sizes, bits)
        assert ((strangers >= -1) & (strangers < max(n, 1))).all()


# --- components ---


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(500, i) for i in range(600, 640)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = dict(of(graph.components(spark.createDataFrame(edges, "a long, b long")), "id", "label"))
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}


# --- shingles ---


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def plain_join(rows):
    sets, n = sets_of(rows), len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    best = {}
    for i in range(n):
        if rows[i][0] is not None:
            best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], len(s), best.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def families(seed, n=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 5, 8, 12, 20, 60, 200]))]
        if rng.random() < 0.5:
            base = common + base
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randint(max(1, int(0.8 * len(copy))), len(copy))]
            text = (" " * rng.randint(1, 2)).join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    return rows


def test_jaccard(spark, small, monkeypatch):
    names = ("doc_id", "n_shingles", "component_id")
    rows = families(1) + [(i + 10_000 if i is not None and i != 2 else i, t) for i, t in ODD]
    assert of(jaccard_join.jaccard_join(docs(spark, rows, CLASHING)), *names) == plain_join(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)  # several turns and slices
    monkeypatch.setattr(jaccard_join, "SLICE", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = families(2)
    assert of(jaccard_join.jaccard_join(docs(spark, rows)), *names) == plain_join(rows)
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0


def test_null_ids_link_and_ids_may_clash(spark, monkeypatch):
    names = ("doc_id", "n_shingles", "component_id")
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])
    rows = [(None, near(59)), (7, " ".join(base)), (7, " ".join(base)), (None, "alone here"), (None, "alone here"), (3, near(58)), (3, "other words"), *families(4, 6)[5:]]
    assert of(jaccard_join.jaccard_join(docs(spark, rows)), *names) == plain_join(rows)
    # functions that a task calls by name come from the module itself: both are replaced
    ids = lambda s: (17 if len(s) < 20 else int(s[0]) >> 1, int(s.sum() >> np.uint64(1)))
    monkeypatch.setattr(jaccard_join, "set_ids", ids)
    monkeypatch.setattr(jaccard_join, "_rid", lambda s, clashes: ids(s)[ids(s)[0] in clashes])
    rows = [(i, f"one two three four five{i % 3}") for i in range(9)] + [(20, near(59)), (21, " ".join(base))]
    assert of(jaccard_join.jaccard_join(docs(spark, rows)), *names) == plain_join(rows)


def test_sketches_leave_what_is_similar():
    rng = np.random.default_rng(8)
    ruled_out = 0
    for k in range(400):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0, 0.5, 0.9, 0.97])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, max(1, int(n * rng.choice([0.01, 0.05, 0.1, 1]))), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        cells = np.frombuffer(jaccard_join.sketch(b), np.uint8).reshape(1, -1)
        left = jaccard_join.may_link(len(a), jaccard_join.sketch(a), np.array([len(b)]), cells, 80)[0]
        assert left or 100 * both < 80 * (len(a) + len(b) - both)
        ruled_out += not left
    assert ruled_out > 100


def test_signatures_meet():
    rng = np.random.default_rng(5)
    for _ in range(600):
        n = int(rng.integers(6, 800))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        drop = int(rng.integers(0, n // 7 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 12 + 1)), dtype=np.uint64) * np.uint64(2)])
        both = n - drop
        if 100 * both >= 85 * (n + len(b) - both) and set(a.tolist()) != set(b.tolist()):
            x, y = (set(jaccard_join.signatures(np.unique(s)).tolist()) for s in (a, b))
            assert x & y


def test_signatures_meet_at_80():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(6, 1500))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b, gone = a, int(rng.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = jaccard_join.signatures(a, 80).tolist(), jaccard_join.signatures(b, 80).tolist()
        if 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert set(x) & set(y)
        if n > 200:  # before, more partitions than that, mostly of one element or none
            assert len(x) < 0.8 * n


# --- lines ---


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        rows.append((*sorted((a, b), key=len, reverse=True), min(3, edit(a, b))))
    df = spark.createDataFrame(rows, "x string, y string, d int")
    assert df.filter(F.least(F.lit(3), line_dedup.banded_distance(F.col("x"), F.col("y"), 2)) != F.col("d")).count() == 0


def line_rows(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(25):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([4, 10, 19, 20, 21, 39, 40, 41, 42, 80, 120])))
        for _ in range(rng.randint(1, 5)):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randint(0, len(new))
                new[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[0]])
            lines.append("".join(new))
    rng.shuffle(lines)
    return [(k, "\n".join(lines[i : i + 4])) for k, i in enumerate(range(0, len(lines), 4))] + [(90, None), (91, ""), (92, " \n\t\n"), (93, lines[0] + "\n" + lines[0])]


def test_lines(spark):
    for seed in (1, 2):
        rows = line_rows(seed)
        occ = [(i, k, s.strip(" \t\x0b\x0c\r")) for i, t in rows for k, s in enumerate((t or "").split("\n"))]
        occ = [o for o in occ if o[2]]
        distinct = sorted({o[2] for o in occ})
        t = lambda n: 2 if n >= 40 else 1 if n >= 20 else 0
        parent = {s: s for s in distinct}

        def find(s, parent=parent):
            while parent[s] != s:
                s = parent[s]
            return s

        for a in distinct:
            for b in distinct:
                if a < b and abs(len(a) - len(b)) <= 2 and edit(a, b) <= t(min(len(a), len(b))):
                    parent[find(a)] = find(b)
        first, size = {}, defaultdict(set)
        for i, k, s in occ:
            first[find(s)] = min(first.get(find(s), (i, k)), (i, k))
            size[find(s)].add(s)
        want = []
        for i, _ in rows:
            mine = [(k, s) for j, k, s in occ if j == i]
            want.append((i, len(mine), sum(first[find(s)] == (i, k) for k, s in mine), sum(len(size[find(s)]) > 1 for _, s in mine),
                         ",".join(f"{k}:{first[find(s)][0]}:{first[find(s)][1]}" for k, s in mine if first[find(s)] != (i, k))))
        assert of(line_dedup.line_report(docs(spark, rows, CLASHING)), "doc_id", "n_lines", "n_kept", "n_near", "dropped") == sorted(want, key=str)


def test_long_lines(spark):
    rng, lines = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    for kind in range(4):
        for n in (126, 129, 161, 240):
            base = {0: " ".join(word() for _ in range(60)), 1: "".join(rng.choice("abcdé") for _ in range(300)), 2: "ab " * 100, 3: "x" * 120 + " " + " ".join(word() for _ in range(40))}[kind][:n].strip()
            for k in (0, 2, n // 20, n // 20 + 2):
                new = list(base)
                for j in range(k):  # spread, so that they leave short runs
                    i = min(len(new) - 1, j * len(new) // k + rng.randint(0, 20))
                    new[i : i + rng.randint(0, 1)] = rng.choice(["", "X", " ", "YZ"[j % 2]])
                lines.append("".join(new).strip())
    lines = sorted(set(lines))
    t = lambda n: n // 20 if n >= 128 else 2
    want = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            m = t(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= m and sum((Counter(a) - Counter(b)).values()) <= m and edit(a, b) <= m:
                want.add(frozenset((a, b)))
    df = docs(spark, [(i, x) for i, x in enumerate(lines)])
    text = dict(of(line_dedup.occurrences(df), "lid", "line"))
    assert {frozenset((text[a], text[b])) for a, b in of(line_dedup.links(df), "a", "b")} == want
    assert sum(2 < edit(*p) for p in want) > 10


def test_long_line_keys(spark):
    """At most 2t + 1 keys in each of two bands, and the lengths that a key can't hold."""
    rng, rows = random.Random(12), []
    for i, n in enumerate((128, 200, 300, 450, 700) * 4):
        rows.append((i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))[:n].strip()))
    got = Counter(r["lid"] for r in line_dedup.keys(spark.createDataFrame(rows, "lid long, line string")).collect())
    for i, line in rows:  # before: 3t + 1, or 8t + 1 where words are few
        assert 0 < got[i] <= 2 * (2 * (len(line) // 20) + 1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6000))
    df = docs(spark, [(1, long), (2, long.replace("a", "", 900)), (2, long[::-1])])
    assert line_dedup.links(df).count() == 1


def test_long_line_places(spark):
    """Lines that hold the same words far from each other don't become candidates (before: each two of them did)."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    lines = [" ".join(words[k:] + words[:k]) for k in range(0, 60, 10)]
    lines += [lines[0].replace(words[30], "x" * 14), "yy " + lines[1]]
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    assert {frozenset(p) for p in of(line_dedup._candidates(df), "x", "y")} == {frozenset((0, 6)), frozenset((1, 7))}
    # a word that comes often may be met anywhere
    often = ["aaaaaaaaaaaa " * 20 + " ".join(words[:8]), "b " + "aaaaaaaaaaaa " * 20 + " ".join(words[:8])]
    df = spark.createDataFrame(list(enumerate(often)), "lid long, line string")
    assert line_dedup._candidates(df).count() == 1


def test_long_line_distance(spark):
    rng, rows = random.Random(14), []
    for _ in range(150):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([128, 150, 171])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 6, 8, 11, 60])):
            i = rng.choice([0, len(b), rng.randint(0, len(b))])
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "X"])
        b = "".join(b)
        x, y = sorted((a, b), key=len, reverse=True)
        if len(y) >= 128:
            rows.append((x, y, len(y) // 20, edit(x, y)))
    df = spark.createDataFrame(rows, "x string, y string, t int, d int")
    x, y, t, d = (F.col(c) for c in "xytd")
    assert df.filter(line_dedup._distance_within(x, y, t) != F.when(d <= t, d).otherwise(-1)).count() == 0
    assert df.filter((d <= t) & ~line_dedup.ends_alike(x, y, t)).count() == 0
    assert 20 < df.filter(d <= t).count() < len(rows) - 5 and df.filter(~line_dedup.ends_alike(x, y, t)).count() > 0


def test_lines_odd(spark):
    got = of(line_dedup.line_report(docs(spark, ODD)), "doc_id", "n_lines", "n_kept")
    assert len(got) == len({i for i, _ in ODD}) and (None, 1, 1) in got and (1, 0, 0) in got
    assert line_dedup.line_report(docs(spark, [])).count() == 0


# --- fingerprints ---


def test_fingerprints(spark, small):
    for rows in (ODD, documents(small), [(1, "one only")], []):
        got = edit_fingerprint.edit_fingerprints(docs(spark, rows, CLASHING)).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        texts = [t or "" for _, t, *_ in order]
        new = [edit_fingerprint.edited(t, n) for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
        want = sorted((r[0], len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(order, texts, new, strict=True) if r[0] is not None)
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want
        assert len(got) == len(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        if len(rows) > 100:
            assert np.mean([r["near_edited"] for r in got]) > 0.7 and np.mean([r["near_next"] for r in got]) < 0.3


def test_fingerprints_depend_on_the_text_alone():
    texts = ["", "a", "word " * 500, "é ü ß " * 40, "x" * 5000, "some other text of a few words"]
    alone = [edit_fingerprint.fingerprints([t])[0].tobytes() for t in texts]
    assert [x.tobytes() for x in edit_fingerprint.fingerprints(texts[::-1])][::-1] == alone
    assert alone[0] == bytes(64)


def test_near_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(200)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "!" + t[301:]) for i, t in enumerate(base)]
    found = of(edit_fingerprint.near_pairs(docs(spark, rows)), "a", "b")
    assert len(set(found) & {(i, 100 + i) for i in range(12)}) >= 11 and all(b - a == 100 for a, b in found)


def test_near_pairs_of_shared_bands(spark, monkeypatch):
    """Bands of so few bits that unrelated documents share them by chance."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(base)) + [(100 * k + i, t[: 90 * k] + "!" + t[90 * k + 1 :]) for k in (1, 2) for i, t in enumerate(base[10:])]
    want = []
    for n, (a, s) in enumerate(rows):
        for b, t in rows[n + 1 :]:
            if sum((Counter(s) - Counter(t)).values()) <= 0.2 * max(len(s), len(t)) and 1 - edit(s, t) / max(len(s), len(t)) >= 0.8:
                want.append((a, b))
    assert len(want) == 60
    for size in (1024, 3):
        monkeypatch.setattr(edit_fingerprint, "SLICE", size, raising=False)
        assert of(edit_fingerprint.near_pairs(docs(spark, rows), bands=32, band_bits=4), "a", "b") == sorted(want, key=str)


def test_near_pairs_recall(spark):
    """Against brute force over texts with a block replaced, up to the threshold; the
    figures for scattered edits are in the README."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(rng.randint(50, 80))) for _ in range(30)]

    def replaced(t, share):
        n = int(len(t) * share)
        at = rng.randrange(len(t) - n + 1)
        return t[:at] + " ".join(word() for _ in range(n))[:n] + t[at + n :]

    rows = list(enumerate(base)) + [(100 * (k + 1) + i, replaced(t, share)) for k, share in enumerate((0.05, 0.1, 0.18)) for i, t in enumerate(base)]
    want = set()
    for i in range(len(base)):  # texts of different bases share nothing but chance
        group = [(d, t) for d, t in rows if d % 100 == i]
        for (a, s), (b, t) in itertools.combinations(group, 2):
            if 1 - edit(s, t) / max(len(s), len(t)) >= 0.8:
                want.add((a, b))
    found = set(of(edit_fingerprint.near_pairs(docs(spark, rows)), "a", "b"))
    assert len(want) > 100 and found <= want and len(found) >= 0.9 * len(want)


def test_near_pairs_of_copies(spark):
    """Copies are one text: no pairs among them, and no link between different texts is lost."""
    rng = random.Random(10)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100))
    rows = [(i, text) for i in range(40)] + [(i, text[:200] + "!" + text[201:]) for i in range(50, 90)] + [(7, "another text"), (None, text), *ODD]
    df = docs(spark, rows, CLASHING)
    assert of(edit_fingerprint.near_pairs(df), "a", "b") == [(0, 50)] + [p for p in of(edit_fingerprint.near_pairs(docs(spark, ODD)), "a", "b")]
    got = edit_fingerprint.members(df)
    assert got.count() == len([r for r in rows if r[0] is not None])
    assert {r["representative"] for r in got.filter("doc_id between 11 and 39").collect()} == {0}
    assert {r["representative"] for r in got.filter("doc_id >= 50").collect()} == {50}
    assert edit_fingerprint.near_pairs(docs(spark, [])).count() == 0
