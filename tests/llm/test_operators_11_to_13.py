"""Divergences, shards and token links against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest

from arborspark.llm.divergence import SQL, divergences, shares
from arborspark.llm.sharding import first_map, load_map, rebalanced, save_map, shard
from arborspark.llm.token_links import Aligner, byte_values, merged, pack, token_links, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars string, size string, term string, task string"


def table(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "x", "y", "z", "t") for r in rows], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- divergences


def plain_divergences(rows, least=3, top=200):
    count, in_docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for w in words:
            count[lang, source, w] += 1
        for w in set(words):
            in_docs[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in in_docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def p(cells):
            total = sum(cells.values()) + len(kept)
            return {w: 1 + 10**9 * (cells[w] + 1) // total for w in kept}

        cells = {s: Counter({w: count[lang, s, w] for w in kept}) for s in sources}
        whole, each = p(sum(cells.values(), Counter())), {s: p(cells[s]) for s in sources}
        f = lambda x, q: (x - q) ** 2 // q
        for s in sources:
            found = {"pair": [(sum(f(each[s][w], each[o][w]) for w in kept), o) for o in sources if o != s]}
            found["term"] = [(f(each[s][w], whole[w]), w) for w in kept if cells[s][w] and each[s][w] > whole[w]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out, key=repr)


CASES = [
    (1, "The cat sat; the CAT ran. Ünïcode", "en", "a"),
    (1, "The cat sat; the CAT ran. Ünïcode", "en", "a"),
    (2, "the dog and the cat", "en", "b"),
    (3, "a dog", "en", "b"),
    (4, None, "en", "c"),
    (5, "", "en", None),
    (6, "seul", "fr", "a"),
    (7, "deux", "fr", "b"),
    (8, "the cat the cat", None, None),
    (None, "Cat cat É é é \x00 x_y [z] 猫 the" * 50, "en", "c"),
    (9, "ÀB àb ab AB " * 400, "en", "d"),
    (10, "only one source", "de", "a"),
]


@pytest.mark.parametrize("at_once", [1024, 2])
def test_divergences_as_by_hand(spark, at_once):
    got = divergences(table(spark, CASES), sources_at_once=at_once, shards=3).select("lang", "source", "part", "item", "value", "rank")
    assert rows_of(got) == plain_divergences(CASES)


def test_divergences_keep_ranks_to_a_limit(spark):
    rows = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i, i + 60)), "en", "ab"[i % 2]) for i in range(40)]
    got = divergences(table(spark, rows), top=7).select("lang", "source", "part", "item", "value", "rank")
    assert rows_of(got) == plain_divergences(rows, top=7)


def test_divergences_of_nothing(spark):
    assert divergences(table(spark, [])).count() == 0


def test_divergences_as_in_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((tuple(r) for r in con.execute(SQL).fetchall()), key=repr)
    assert rows_of(divergences(docs).select("lang", "source", "part", "item", "value", "rank")) == want


def test_shares_are_exact_for_large_counts():
    import numpy as np

    for count, total in [(0, 1), (5, 7), (10**15, 8 * 10**15), (8 * 10**15 - 1, 8 * 10**15), (3 * 10**12, 10**13 + 7)]:
        assert shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


# ---- shards


def test_shards_are_whole_gapless_and_near_equal(spark):
    rows = [(i, "é" * (i % 97), "en", "a") for i in range(3000)] + [(None, "null id", "en", "a")] * 1500 + [(7, None, "en", "a")] * 1500
    got = shard(table(spark, rows), shards=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    size, places = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_first_map_gives_the_largest_slot_to_the_least_shard(spark):
    bytes_ = {i: (i * 7919) % 101 + 1 for i in range(60)}
    sizes = spark.createDataFrame([(s, 0, b, 1) for s, b in bytes_.items()], "virtual_slot int, lane int, bytes long, rows long")
    loads, want = [0] * 5, {}
    for s in sorted(bytes_, key=lambda s: (-bytes_[s], s)):
        want[s] = loads.index(min(loads))
        loads[want[s]] += bytes_[s]
    assert {r.virtual_slot: r.shard for r in first_map(sizes, 5).collect()} == want


def test_rebalancing_moves_little_and_keeps_versions(spark, tmp_path):
    sizes = lambda n, extra=0: spark.createDataFrame([(i, 0, 100 + (i * 31) % 17 + extra * (i % 5 == 0), 1) for i in range(n)], "virtual_slot int, lane int, bytes long, rows long")
    folder = f"file://{tmp_path}/maps"
    save_map(first_map(sizes(800), 8), folder)
    before = {r.virtual_slot: r.shard for r in load_map(spark, folder).collect()}
    save_map(rebalanced(load_map(spark, folder), sizes(800), 9), folder)
    after = {r.virtual_slot: r.shard for r in load_map(spark, folder).collect()}
    load = Counter()
    for s, k in after.items():
        load[k] += 100 + (s * 31) % 17
    assert max(load.values()) <= 1.03 * sum(load.values()) / 9
    assert sum(before[s] != after[s] for s in before) <= 1.2 * 800 / 9
    assert {r.virtual_slot: r.shard for r in load_map(spark, folder, 1).collect()} == before
    save_map(rebalanced(load_map(spark, folder), sizes(850, 60), 7), folder)
    third = {r.virtual_slot: r.shard for r in load_map(spark, folder).collect()}
    assert set(third) == set(range(850)) and set(third.values()) == set(range(7))
    assert load_map(spark, folder).first().version == 3
    with pytest.raises(Exception, match="(?i)exist"):
        save_map(load_map(spark, folder, 2), folder)


def test_shards_follow_the_stored_map(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/maps", [(i, "x" * (i % 50), "en", "a") for i in range(2000)]
    a = {r.doc_id: r for r in shard(table(spark, rows), 4, 64, folder).collect()}
    b = {r.doc_id: r for r in shard(table(spark, rows), 4, 64, folder).collect()}
    c = {r.doc_id: r for r in shard(table(spark, rows), 5, 64, folder).collect()}
    assert all(a[d].shard == b[d].shard for d in a) and {a[0].map_version, b[0].map_version, c[0].map_version} == {1, 2, 3}
    moved = [d for d in a if a[d].shard != c[d].shard]
    assert 0 < len(moved) < 0.4 * len(a)


def test_shards_of_nothing_and_of_one(spark):
    assert shard(table(spark, [])).count() == 0
    assert [r.slot for r in shard(table(spark, [(None, None, None, None)])).collect()] == [0]


# ---- token links


def plain_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value, docs = byte_values(), []
    for doc, text, *_ in rows:
        body = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        x = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
        y = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, b.id_to_piece(ids_b))]
        if b"".join(x) != body or b"".join(y) != body:
            ids_a, ids_b, x, y = [], [], [], []
        owner = [[k for k, t in enumerate(tokens) for _ in t] for tokens in (x, y)]
        ends = [set(itertools.accumulate(map(len, tokens))) for tokens in (x, y)]
        links = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(*owner)))]
        groups, lo = [], 0
        for e in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(own[lo:e])) for ids, own in zip((ids_a, ids_b), owner)))
            lo = e
        docs.append((doc, len(ids_a), len(ids_b), groups, links))
    count = Counter(p for d in docs for p in d[4])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "\n", " \n", "\n\n a", "a", "a b", "a  b", "a \n b", "a\n\nb", "end.\nNext line\n", "it's <|endoftext|> here", "<s> </s> <unk>", "tab\there\r\nand", "café naïve é é\né",
    "  x  y  z", "　 猫 猫は 走る", "a▁b", "▁", "\x00\x01 \x1c \x1f x", "x  y  z\u0085 w", "12345 678 9.5e3", "\U0001f600 \U0001f600\U0001f600 é", "trailing   ", "﻿bom �", "\U000e0001 tag",
    "word " * 300, "longwithoutspaces" * 200, "<0x41> A", "'s 'S don't  'll", "بسم الله", "a\x0bb \x0c c", "  o ᠎ x",
]


def test_token_links_as_by_hand(spark):
    rows = [(i % 30, t, "en", "a") for i, t in enumerate(ODD * 2)] + [(None, "null id it is", "en", "a")]
    assert rows_of(token_links(table(spark, rows).repartition(5), buckets=3, lot=2)) == plain_links(rows)


def test_token_links_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(token_links(docs.repartition(3), lot=1)) == plain_links([(r.doc_id, r.text) for r in docs.collect()])


def test_long_texts_are_cut_at_units(spark, monkeypatch):
    import numpy as np

    from arborspark.llm import token_links as t

    with_ = t.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for text in (" ".join(f"wörd{i % 97}, it's\n{i}" for i in range(2000)), "a▁b " * 3000):
        data = np.frombuffer(text.encode(), np.uint8)
        monkeypatch.setattr(t, "CHUNK_BYTES", 4 << 20)
        whole = t.found(with_, data, np.array([0, len(data)]))
        monkeypatch.setattr(t, "CHUNK_BYTES", 1000)
        parts = t.found(with_, data, np.array([0, len(data)]))
        assert whole[0].tolist() == parts[0].tolist() and whole[1] == parts[1] and all(x.tolist() == y.tolist() for x, y in zip(whole[2], parts[2]))


def test_token_links_of_nothing(spark):
    assert token_links(table(spark, [])).count() == 0
    assert rows_of(token_links(table(spark, [(1, None, "en", "a")]))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_units_do_not_change_the_tokens():
    import numpy as np

    with_ = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert with_.splits
    for t in ODD:
        if not t:
            continue
        body = (" " + t).encode()
        starts = with_.units(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
        parts = [body[i:j] for i, j in zip(starts, [*starts[1:], len(body)])]
        assert b"".join(parts) == body
        assert sum(with_.ids_b([p.decode() for p in parts]), []) == with_.b.encode(t), repr(t)
        assert sum((e.ids for e in with_.a.encode_batch([p.decode() for p in parts], add_special_tokens=False)), []) == with_.a.encode(" " + t, add_special_tokens=False).ids


def test_runs_are_merged_by_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    streams, want = [], Counter()
    for _ in range(7):
        pairs = np.sort(rng.integers(0, 40, 200))
        times = rng.integers(1, 9, 200)
        for p, t in zip(pairs.tolist(), times.tolist()):
            want[p] += t
        streams.append(iter([(pairs[i : i + 13], times[i : i + 13]) for i in range(0, 200, 13)]))
    got = [(int(p), int(t)) for pairs, times in merged(streams) for p, t in zip(pairs, times)]
    assert got == sorted(want.items())
    assert [c.tolist() for c in unpack(pack(np.array([0, 300, 7]), np.array([1 << 40, 0, 2])))] == [[0, 300, 7], [1 << 40, 0, 2]]
