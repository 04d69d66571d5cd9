import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers_llm import CLASHING, ODD, docs, documents, of

from tessella.llm import packing, token_store, tokens
from tessella.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_ids_are_the_library_s(plain, small):
    e = tokens.encoder(tokens.tokenizer_path())
    rng = random.Random(1)
    odd = ["", " ", "a  b", "\n", "a\n\nb", " lead", "trail ", "tab\there", "it's we'll", "x<|endoftext|>y", "a b c", "re. x y", "ok, (yes)!?.. end", "½ ² ⅷ a,1. b²."]
    odd += ["".join(rng.choice("ab ,.'\n1é ß漢́\U0001F600") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text in odd + [t for _, t, _ in documents(small)]:
        assert e.ids(text) == plain(text), repr(text)


def test_added_tokens_have_their_ids():
    ids = np.frombuffer(tokens.encoder(tokens.tokenizer_path()).ids("a <|endoftext|> b"), "<u4").tolist()
    assert 50256 in ids and ids[-1] == 2


def check_store(spark, df, rows, plain, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(df, path)
    back = token_store.read_documents(spark, path).collect()
    assert all(r["verified"] for r in back)
    want = sorted((i is not None, i or 0, zlib.crc32(plain(t)), len(plain(t)) // 4) for i, t, *_ in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in back)
    assert got == want
    order = sorted(back, key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order] == [w[:2] for w in want]
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()][: len(order)]
    return path


def test_store_odd_rows(spark, plain, tmp_path):
    path = check_store(spark, docs(spark, ODD, CLASHING), ODD, plain, tmp_path)
    ids = {(r["doc_id"], bytes(r["ids"])) for r in token_store.read_ids(spark, path).collect()}
    assert ids == {(i, plain(t)) for i, t, *_ in ODD}


def test_store_documents(spark, small, plain, tmp_path):
    rows = documents(small)
    path = check_store(spark, docs(spark, rows), rows, plain, tmp_path)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg({"n_docs": "sum"}).first()[0] == len(rows)
    files = sorted((tmp_path / "store" / "recipes").glob("*.parquet"))
    order = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert order == sorted(order)


def test_store_empty_and_damage(spark, tmp_path):
    check = str(tmp_path / "none")
    token_store.write_store(docs(spark, []), check)
    assert token_store.read_documents(spark, check).count() == 0
    path = str(tmp_path / "hurt")
    token_store.write_store(docs(spark, [(1, "some words here"), (2, "other words")]), path)
    rows = spark.read.parquet(f"{path}/chunks").collect()
    hurt = [(r["digest"], bytearray(r["payload"][:-1] + b"\x07") if i == 0 else r["payload"]) for i, r in enumerate(rows)]
    spark.createDataFrame(hurt, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert of(token_store.read_documents(spark, path), "verified") == [(False,), (True,)]


def test_store_lost_recipe(spark, tmp_path):
    path = str(tmp_path / "lost")
    token_store.write_store(docs(spark, [(i, f"words of {i}") for i in range(6)]), path)
    assert of(token_store.read_documents(spark, path), "verified") == [(True,)] * 6
    left = spark.read.parquet(f"{path}/recipes").filter("doc_id <> 3").collect()
    spark.createDataFrame(left, spark.read.parquet(f"{path}/recipes").schema).write.mode("overwrite").parquet(f"{path}/recipes")
    assert of(token_store.read_documents(spark, path), "verified") == [(False,)] * 5


def test_store_repeated_chunks(spark, plain, tmp_path, monkeypatch):
    rows = [(i, "the same words " * 900 if i % 2 else f"own {i}") for i in range(40)]
    for k, most in enumerate((500_000, 0)):
        monkeypatch.setattr(token_store, "BROADCAST_CHUNKS", most)
        path = check_store(spark, docs(spark, rows), rows, plain, tmp_path / str(k))
        chunks = spark.read.parquet(f"{path}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count()


def test_chunks_survive_edits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50000, 20000).astype("<u4")
    b = np.concatenate([a[:5000], np.array([1, 2, 3], "<u4"), a[5000:]])

    def pieces(x):
        ends = token_store.cuts(0, len(x), token_store.cut_candidates(x))
        return {x[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)}

    assert len(pieces(a) & pieces(b)) > 0.9 * len(pieces(a))


def test_crc_of_parts():
    rng = random.Random(3)
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 5000)) for _ in range(rng.randint(1, 6))]
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
        crcs = np.array([zlib.crc32(p) for p in parts], np.uint32)
        assert np.bitwise_xor.reduce(token_store.crc_shift(crcs, after)) == zlib.crc32(b"".join(parts))


def test_merkle():
    from hashlib import sha256

    h = lambda b: sha256(b).digest()
    a, b, c = h(b"a"), h(b"b"), h(b"c")
    assert token_store.merkle_root([a]) == a and token_store.merkle_root([a, b, c]) == h(h(a + b) + c)


def check_packing(rows, out, plain, capacity):
    from collections import defaultdict

    seqs, parts = defaultdict(list), []
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for cells in seqs.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, t, *_ in rows:
        ids = plain(t)
        n = len(ids) // 4
        first = n if n <= capacity else n % capacity or capacity
        edges = [0, *range(first, n, capacity), n]
        want += [(i, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted(parts, key=str) == sorted(want, key=str)
    return len(seqs)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, small, plain, capacity):
    rows = documents(small) + ODD
    out = packing.pack(docs(spark, rows, CLASHING), capacity).collect()
    n = check_packing(rows, out, plain, capacity)
    assert n <= 1.02 * sum(r["length"] for r in out) / capacity + 2


def test_packing_empty_and_sequences(spark, plain):
    assert packing.pack(docs(spark, [])).count() == 0
    packed = packing.pack(docs(spark, [(1, "a b c"), (2, "d e")]), 8, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sorted(bytes(r["ids"]) for r in rows) in ([plain("a b c") + plain("d e")], [plain("d e") + plain("a b c")])


def test_histogram_plan_uses_every_piece():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        patterns = packing.pack_histogram(counts, 100)
        used = {}
        for p, n in patterns:
            assert sum(p) <= 100 and n > 0
            assert sum(3 * k > 100 for k in p) <= 2
            for k in p:
                used[k] = used.get(k, 0) + n
        assert used == counts


def test_query_columns(spark, small):
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(QUERIES["op1_token_store"](spark, small).columns)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(QUERIES["op4_best_fit_packing"](spark, small).columns)
