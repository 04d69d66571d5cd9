import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from helpers_llm import CLASHING, ODD, docs, documents, of
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import license_scan, mixing, pii, toxicity
from tessella.llm.common import written

# --- personal data ---

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base_spans(text):
    x, d = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    return [
        [m.span() for m in E.finditer(x)],
        [m.span() for m in I.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in C.finditer(x) if 13 <= len(d(m)) <= 19 and luhn(d(m))],
        [m.span() for m in P.finditer(x) if 9 <= len(d(m)) <= 15],
    ]


TRICKY = [
    "a@b.c_d@e.f x..y@z-1.co.uk.. 1.2.3.4.5.6.7.8 256.1.1.1 0300.1.1.1 0255.01.1.9 12345678901234567890",
    "4111 1111-1111 1111 4111  111111111111 +1 (2).3-4567890. +12 + 3 \u0001 +49 30 1234567 4111111111111111\U0001F600 me@é.com q@r.s9",
    "1.2.3.4" * 300, "4" * 3000, "a." * 1000 + "@x.y", "x@y" + ".z" * 3000, "+1" + " " * 3000 + "2",
]


def test_base_spans(spark, small):
    rng = random.Random(9)
    odd = ["".join(rng.choice("01245 .-+@a_()\u0001é") for _ in range(rng.randint(5, 60))) for _ in range(600)]
    rows = [*ODD, *documents(small), *((10_000 + i, t) for i, t in enumerate(TRICKY + odd))]
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.pii_report(docs(spark, rows, CLASHING)).collect()}
    want = set()
    for i, t, *_ in rows:
        found = base_spans(t)
        said = ",".join(f"{k}:{s}:{e}" for k, v in zip(("email", "ip", "card", "phone"), found, strict=True) for s, e in v)
        want.add((i, *map(len, found), hashlib.sha256(said.encode()).hexdigest()))
    assert got == want
    assert pii.pii_report(docs(spark, [])).count() == 0


def test_addresses_with_zero_parts(spark):
    rows = [(i, t) for i, t in enumerate([
        "10.0.0.1 192.168.0.1 0.0.0.0", "127.0.0.1", "00.000.0.00 01.0.0255.1", "256.0.0.0 0.0.0.0256", "0." * 500 + "0", "0" * 3000 + ".0.0.0 0.0.0." + "0" * 3000 + "256",
    ])]
    got = of(pii.pii_report(docs(spark, rows)), "doc_id", "n_ip")
    assert got == [(i, len(base_spans(t)[1])) for i, t in rows]
    assert [n for _, n in got] == [3, 1, 2, 0, 125, 1]
    assert pii.masked(docs(spark, [(1, "at 10.0.0.1!")])).first()["text"] == "at [ip]!"


def test_other_spans(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01; ssn 123-45-6789 or 000-45-6789, call (415) 555-1212"
    row = pii.pii_report(docs(spark, [(1, text), (2, "id (415) 555-1212 only")])).orderBy("doc_id").collect()
    kinds = [s.split(":")[0] for s in row[0]["spans"].split(",")]
    assert kinds == ["iban", "ssn", "phone_local"] and row[1]["spans"] == ""
    assert all(text[int(s):int(e)] for _, s, e in (x.split(":") for x in row[0]["spans"].split(",")))
    assert pii.masked(docs(spark, [(1, "to a@b.co é, 1.2.3.4!")])).first()["text"] == "to [email] é, [ip]!"


# --- toxicity ---


def test_decoding():
    words = {w: 5 for w in "idiot stupid trash moron pathetic disgusting loser the and house garden".split()}
    chars = toxicity.CharModel.fit(toxicity.Counter(words))
    for seen, meant in {"1d10t": "idiot", "$tup1d": "stupid", "tr@sh": "trash", "m.o.r.o.n": "moron", "looooser": "loser", "d1sgu5t1ng": "disgusting"}.items():
        assert toxicity.restored(seen, chars) == meant
    assert toxicity.restored("house", chars) is None and toxicity.restored("12345", chars) is None


def test_decoding_against_all_readings():
    """Every reading of a token, one option for each sign, scored by itself."""
    words = {w: 5 for w in "idiot stupid trash moron loser the and house garden".split()}
    chars, rng = toxicity.CharModel.fit(toxicity.Counter(words)), random.Random(12)
    for _ in range(150):
        token = "".join(rng.choice("0134578$!*|.-aiostt") for _ in range(rng.randint(1, 6)))
        choices, before, run = [], "", 0
        for sign in token:
            run = run + 1 if sign == before else 1
            before = sign
            choices.append(toxicity.options_of(sign, run))
        best = defaultdict(lambda: -1e9)
        for path in itertools.product(*choices):
            text = "".join(c for c, _ in path)
            s = "^^" + text + "$"
            value = sum(cost for _, cost in path) + sum(chars.logp(*s[i - 2 : i + 1]) for i in range(2, len(s)))
            best[text] = max(best[text], value)
        assert best[toxicity.decode(token, chars)] >= max(best.values()) - 1e-9, token


def test_held_out_scores(spark, small):
    at = small.replace("sf0.001", "sf0.01")
    df, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    t = pq.read_table(f"{at}/labels.parquet").to_pydict()
    held = [(got[i]["score"], y) for i, y in zip(t["doc_id"], t["toxic"], strict=True) if i in got and got[i]["held_out"]]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in yes for b in no]) > 0.85


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (7, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [*ODD, *((100 + i, "you idiot fool here" if i % 2 else "a fine day here") for i in range(40)), (500, "an 1d10t"), (501, "i d i o t!")]
    got = toxicity.toxicity(docs(spark, rows, CLASHING), labels)
    scores = dict(of(got.filter("doc_id >= 500 or doc_id = 1"), "doc_id", "score"))
    assert got.count() == len(rows) and scores[500] > scores[1] and scores[501] > scores[1]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs(spark, ODD), none).count() == len(ODD)
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def test_toxicity_learns_from_all_labels(spark):
    """Six words of which each is in a few of some thousand toxic rows: none may be lost to a sample."""
    bad = ["zorgle", "quabbit", "fremlin", "dwarkle", "snibbet", "vontrup"]
    rows = [(i, f"you {bad[i % 6] if i % 400 < 6 else 'idiot'} today" if i % 2 else "a fine day here") for i in range(12000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    learned = toxicity.training_rows(docs(spark, rows), labels, ~toxicity.held_out(F.col("doc_id")))
    want = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r["doc_id"] for r in learned.collect()) == want
    model = toxicity.fit(learned)
    texts = {i: t for i, t in rows}
    for word in bad:
        n = sum(word in texts[i] for i in want)
        assert (word in model.known) == (n >= 5), word


def test_decodings_without_use_are_left_out():
    rng = random.Random(5)
    chars = toxicity.CharModel.fit(Counter({"stupid": 9, "idiot": 7, "liebe": 5, "table": 5}))
    known = {f: i for i, f in enumerate(["stupid", "stup~", "idio~", "tab"])}
    every, wanted = toxicity.Featurizer(chars, known), toxicity.beginnings(known)
    every.wanted = None
    tokens = ["".join(rng.choice("5$tup1!diioxa..--") for _ in range(rng.randint(1, 8))) for _ in range(3000)] + ["s-t-u-p-i-d", "1d10t", "stuuuupid", "7@b", "xx4"]
    some = toxicity.Featurizer(chars, known)
    assert [some.of_word(t) for t in tokens] == [every.of_word(t) for t in tokens]
    assert any(some.of_word(t) for t in tokens) and not all(toxicity.may_begin(t, *wanted) for t in tokens)


def test_kept_features_are_the_best_of_all(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(int(i < 60), sorted({f"w{int(rng.expovariate(0.05))}" for _ in range(20)} | ({"bad", "worse"} if i < 55 else set()))) for i in range(400)]
    words = spark.createDataFrame(rows, "toxic int, words array<string>")
    monkeypatch.setattr(toxicity, "FEATURES", 2)
    of_kept = lambda: [tuple(r) for r in toxicity._kept(words, 60, 340)]
    want, made, counted = of_kept(), [], toxicity._feature_counts
    monkeypatch.setattr(toxicity, "_feature_counts", lambda some=None: made.append(some) or counted(some))
    for sent in (0, 3, 40):
        monkeypatch.setattr(toxicity, "SENT_FEATURES", sent)
        assert of_kept() == want and {r[0] for r in want} == {"bad", "worse"}


# --- licences ---


def test_licences(spark, small):
    lines = {
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "mit": "Released under the MIT License.",
        "apache": "Licensed under the Apache License, Version 2.0.",
    }
    for i, t, *_ in documents(small):
        assert i is not None
    want = [(i, ",".join(sorted(k for k, v in lines.items() if v in t))) for i, t, *_ in documents(small)]
    assert of(license_scan.scan_licenses(docs(spark, documents(small), CLASHING)), "doc_id", "families") == sorted(want, key=str)


WRAPPED = {
    "mit": "MIT\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files, to deal in it",
    "gpl": "# This program is free software: you can\n# redistribute it and/or modify it under the\n# terms of the GNU General Public License as published",
    "isc": "Permission to use, copy, modify, and/or distribute\nthis software for any purpose with or\nwithout fee is hereby granted",
    "unlicense": "This is free and unencumbered\nsoftware released into the public\ndomain",
    "boost": "Distributed under the Boost\nSoftware License, Version 1.0.",
    "eupl": "Licensed under the European\nUnion Public Licence.",
}


def test_wrapped_licences(spark):
    rows = [(i, f"Some prose here.\n{t}\n\nMore prose there.") for i, t in enumerate(WRAPPED.values())]
    rows += [(50, "The license of the\ndriver expired in spring."), (51, "Released under the MIT License.\nand then\nmore"), *((None if i is None else 100 + i, t) for i, t in ODD)]
    got = sorted(license_scan.scan_licenses(docs(spark, rows, CLASHING)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [by_id[i]["families"] for i in range(len(WRAPPED))] == list(WRAPPED)
    assert all(by_id[i]["n_notices"] == 1 for i in range(len(WRAPPED))) and by_id[2]["notices"].startswith("1:isc:")
    assert by_id[50]["n_notices"] == 0 and (by_id[51]["families"], by_id[51]["n_notices"]) == ("mit", 1)
    assert all(r["n_notices"] == 0 for r in got if r["doc_id"] is None or r["doc_id"] > 60)
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_runs(spark):
    text = "a\nb.\nc\n\nd\n e\n \nf!) \ng\nh"
    got = docs(spark, [(1, text), (2, None), (3, "")]).select("doc_id", license_scan.runs(F.col("text")).alias("r")).collect()
    assert {r["doc_id"]: [(x["i"], x["m"], x["s"]) for x in r["r"]] for r in got} == {1: [(0, 2, "a\nb."), (4, 2, "d\n e"), (8, 2, "g\nh")], 2: [], 3: []}


def test_licences_in_long_paragraphs(spark):
    long = {0: "я" * 20000, 1: " . " * 20000, 2: "\n" * 20000, 3: ("." * 300 + "\n") * 100, 4: "a" * 100000}
    got = license_scan.scan_licenses(docs(spark, [(i, f"{t} Released under the MIT License.") for i, t in long.items()]))
    assert of(got, "doc_id", "families", "n_notices") == [(i, "mit", 1) for i in long]


def test_licence_scores_against_numpy(spark):
    m, families = license_scan.trained(), [*license_scan.NOTICES, "unknown"]
    lines = [a.format(t) for k in license_scan.NOTICES.values() for t in k for a in license_scan.AROUND] + license_scan.UNKNOWN
    rows = docs(spark, list(enumerate(lines))).select("doc_id", license_scan.paragraphs(F.col("text")).alias("p")).collect()
    for r in rows:
        f = license_scan._features(lines[r["doc_id"]])
        z = (np.array([x in f for x in m["vocabulary"]]) @ m["weights"].T + m["bias"]) / m["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p.argmax())
        if families[best] == "unknown" or p[best] < license_scan.LEAST_PROBABILITY - 1e-3:
            assert not r["p"], lines[r["doc_id"]]
        elif p[best] > license_scan.LEAST_PROBABILITY + 1e-3:
            assert [x["family"] for x in r["p"]] == [families[best]] and abs(r["p"][0]["probability"] - p[best]) < 1e-3
    # all of the notices that the model is fitted on, and none of the other sentences
    named = {r["doc_id"]: bool(r["p"]) for r in rows}
    n = len(lines) - len(license_scan.UNKNOWN)
    assert sum(named[i] for i in range(n)) >= 0.9 * n and not any(named[i] for i in range(n, len(lines)))



def test_licences_held_out(spark):
    """Notices in other words than those of the fit, and sentences that are none."""
    rows = [
        (1, "Distributed under the MIT License.", "mit"), (2, "intro\nThis code is licensed under the Apache License, Version 2.0 (the License).", "apache"),
        (3, "Free software under the GNU Lesser General Public License version 3.", "lgpl"), (4, "Content is licensed under CC BY-SA 4.0 by its authors.", "cc-by-sa"),
        (5, "SPDX-License-Identifier: MPL-2.0 OR other", "mpl"), (6, "He has a fishing license.", ""), (7, "The public library opened in version two.", ""),
        (8, "Use of this file is governed by a BSD-style license found elsewhere.", "bsd"),
    ]
    got = dict(of(license_scan.scan_licenses(docs(spark, rows)), "doc_id", "families"))
    assert sum(got[i] == f for i, _, f in rows) >= 7 and got[6] == got[7] == ""
    assert license_scan.scan_licenses(docs(spark, ODD)).count() == len(ODD)
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


# --- mixing ---


def plain_targets(sizes, cycle=mixing.CYCLE, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: cycle[i % len(cycle)][0] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing(spark, small):
    sources = [(i, t, s) for i, t, s in documents(small)]
    skewed = [(i, t, f"s{min(i % 7, 3)}" if i % 11 else None) for i, t, _ in sources]
    for rows in (sources, skewed, [(*r[:2], "z") for r in ODD] + skewed[:50]):
        got = mixing.curriculum(docs(spark, rows, "label kept")).collect()
        sizes = defaultdict(int)
        count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        for _, t, s in rows:
            sizes[s] += count(t)
        targets, taken = plain_targets(sizes), defaultdict(int)
        assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, count(t)) for i, t, _ in rows if i is not None)
        for r in got:
            assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
        places = [r["position"] for r in got if r["position"] is not None]
        assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert mixing.curriculum(docs(spark, [])).count() == 0


def test_positions_follow_the_schedule(spark):
    """Of a source's demand, the part before time t is the part of its schedule's integral before t."""
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    got = mixing.curriculum(docs(spark, rows)).collect()
    for k, (weight, shape) in enumerate(mixing.CYCLE):
        assert abs(mixing.integral(shape)[-1] - 1) < 0.1 and weight > 0
        places = np.array([p for r in got if r["source"] == f"s{k}" for p in (r["position"], r["second_position"]) if p is not None])
        knots, heights = zip(*shape, strict=True)
        grid = np.linspace(0, 1, 2001)
        area = np.cumsum(np.interp(grid, knots, heights))
        for t in (0.25, 0.5, 0.75):
            assert abs((places <= t).mean() - np.interp(t, grid, area / area[-1])) < 0.02


def test_mixed_documents(spark):
    rows = [(i, f"word{i} a b c", f"s{i % 4}") for i in range(60)]
    plan = {r["doc_id"]: r for r in mixing.curriculum(docs(spark, rows)).collect()}
    out = mixing.mixed(docs(spark, rows, "extra"))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == plan[i]["taken"] for i in plan)
    twice = docs(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")])
    assert mixing.mixed(twice).count() == sum(r["copies"] for r in mixing.curriculum(twice).collect())


def test_mixed_rows_of_two_sources(spark):
    rows = [(i, "one two three four", s) for i in range(20) for s in ("p", "q")] + [(i, "a b c", "q") for i in range(20, 60)]
    for some in (rows, rows + rows[:7]):
        df = docs(spark, some, CLASHING)
        planned, taken = defaultdict(int), defaultdict(int)
        for r in mixing.curriculum(df).collect():
            planned[r["doc_id"], r["source"]] += r["taken"]
        for r in mixing.mixed(df).collect():
            taken[r["doc_id"], r["source"]] += len(r["text"].split())
        assert dict(taken) == {k: n for k, n in planned.items() if n}


# --- pipeline ---


def test_stages_of_odd_rows(spark, small):
    rows = [*ODD, *((100 + i, f"word{i} a b c d e f g", f"s{i % 3}" if i % 5 else None) for i in range(30)), (None, None), (100, "word0 a b c d e f g")]
    for some in (rows, []):
        df = docs(spark, some, CLASHING)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, small)
            assert out.columns == df.columns, name
            got = out.collect()
            assert (not some) == (not got), name
            if name == "toxicity":
                assert len(got) == len(some)
            if name == "exact_dedup":
                want = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in some}
                assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got) == sorted(want)
        packed = corpus_pipeline.STAGES[-1][1](spark, df, small)
        assert sum(r["piece"] == 0 for r in packed.collect()) == len(some)


def test_near_copies_under_one_id(spark, small):
    base = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(base), " ".join(base[:-1] + ["x"]), "something else that shares no words with it"
    out = lambda rows: of(corpus_pipeline.drop_near_copies(spark, docs(spark, rows), small), "doc_id", "text")
    assert out([(3, text), (5, near), (5, other)]) == [(3, text), (5, other)]
    assert len(out([(4, text), (4, near), (None, text + " y"), (None, near)])) == 1
    assert len(out([(None, text), (None, near), (None, other)])) == 2
    assert out([(1, text), (1, text), (2, ""), (3, None), (4, " ")]) == sorted([(1, text), (2, ""), (3, None), (4, " ")], key=str)


def test_sequences_follow_the_curriculum(spark, tmp_path, monkeypatch):
    from tessella.llm import packing

    rows = [(i, f"word{i} " * (5 + i * 37 % 400), f"s{i % 3}") for i in range(300)]
    plan = mixing.curriculum(docs(spark, rows))
    mixed = mixing.mixed(docs(spark, rows))
    mixed.write.parquet(str(tmp_path / "mixed"))
    read = spark.read.parquet(str(tmp_path / "mixed"))
    got = packing.pack_in_order(read).collect()
    heads = [r for r in got if r["piece"] == 0]
    assert len(heads) == read.count() == len({r["place"] for r in heads})
    # documents by place are documents by training position
    at = sorted((p, r["doc_id"], k) for r in plan.collect() for k, p in enumerate((r["position"], r["second_position"])) if p is not None)
    assert [r["doc_id"] for r in sorted(heads, key=lambda r: r["place"])] == [i for _, i, _ in at]
    for size, least in ((packing.RANGE_ROWS, 1), (16, 20)):
        monkeypatch.setattr(packing, "RANGE_ROWS", size)
        got = packing.pack_in_order(read).collect()
        # ranges of places don't overlap, and their sequences come in the same order
        spans, cells = defaultdict(list), defaultdict(list)
        for r in got:
            spans[r["sequence_id"] >> 27].append(r["place"])
            cells[r["sequence_id"]].append((r["offset"], r["length"]))
        ends = [(min(v), max(v)) for _, v in sorted(spans.items())]
        assert len(ends) >= least and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
        for c in map(sorted, cells.values()):
            assert [x for x, _ in c] == [0, *itertools.accumulate(n for _, n in c[:-1])] and sum(n for _, n in c) <= 1024


def test_pipeline_stages(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    df, names = rows, rows.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, small), name)
        assert df.columns == names
        kept.append({r["doc_id"] for r in df.collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and len(kept[2]) > 0.7 * rows.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, df, small)
    assert {r["doc_id"] for r in packed.collect()} == kept[3]


def test_near_copies_against_brute_force(spark, small):
    from test_dedup import plain_join

    rows = documents(small)
    out = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), small)
    assert of(out, "doc_id") == sorted({(c,) for _, _, c in plain_join(rows)}, key=str)


def plain_components(rows, words, percent):
    """The smallest doc_id of each component of documents that are similar on shingles of so many words."""
    sets = [(lambda w: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())(t.lower().split()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(rows[i][0] for i, x in enumerate(label) if x == y) for y in set(label)}


def test_near_copies_of_five_words(spark, small):
    from test_dedup import families

    base = [f"w{i}" for i in range(100)]
    # of 97 and 96 shingles, two changes leave 89 and 86: 0.848 on four words, 0.811 on five
    rows = [(1000, " ".join(base)), (1001, " ".join(base[:30] + ["x"] + base[31:60] + ["y"] + base[61:]))] + families(3)
    want = plain_components(rows, 5, 80)
    assert 1001 not in want and want < plain_components(rows, 4, 85)
    assert of(corpus_pipeline.drop_near_copies(spark, docs(spark, rows), small), "doc_id") == sorted({(i,) for i in want}, key=str)


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).first()
    assert out["n"] > 100 and out["m"] <= 1024
