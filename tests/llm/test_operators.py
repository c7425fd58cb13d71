"""Every operator against a brute-force version, with nulls, empty tables, repeats and clashing names."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborspark.llm import decontaminate, exact_dedup, graph, language, licenses, near_dedup, packing, quality, substrings, suffixes, token_counts, tokens
from arborspark.llm.registry import ORACLE_SQL, QUERIES

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, part string, id int, grp long, at string, gone int, kept boolean"
random.seed(5)
WORDS = ["".join(random.choice(["an", "the", "ti", "or", "éa", "st", "wh", "ou"]) for _ in range(random.randrange(1, 5))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "", ".", ",", "\n", " \t"]) for _ in range(n))


def texts():
    base = prose(120, 1)
    words = base.split()
    near = " ".join(w if i % 37 else "other" for i, w in enumerate(words))
    passage = prose(60, 99)
    return [
        base, near, base.replace(" ", "  \n"), base, prose(30, 2) + " " + passage + " " + prose(30, 3), prose(40, 4) + " " + passage, None, "", " \t\n", "one two", "One\ttwo",
        prose(3000, 6), "a" * 300, "a" * 260, "…é" * 40, "Released under the MIT License.\nThis is a line.", prose(200, 7), prose(200, 7) + " x", "for " * 200, "for " * 190, "tail\n",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s", 0, 1, "x", 2, 3, "y", 4, True) for i, t in enumerate(texts())]
    rows += [rows[4], (None, texts()[0], None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    got = collections.Counter(map(tuple, token_counts.token_counts(docs, limit=100).collect()))
    want = collections.Counter()
    for d, t in plain(docs):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 100] += 1
    assert got == want
    assert token_counts.token_counts(empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_units_encode_as_the_library(name):
    path, c = public_tokenizers.path(name), tokens.codec(public_tokenizers.path(name))
    if name.endswith(".model"):
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        tok = Tokenizer.from_file(path)
        whole = lambda t: tok.encode(t, add_special_tokens=False).ids
    r = random.Random(9)
    alphabet = ["a", "B", "é", "É", "H̱", "İ", "Σ", "'s", "'T", "’", ".", "!", "...", "€", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "1", "2²", "½", "中", "ß", "_", "́", "​", "=", "̸", "🙂", "don't"]
    samples = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 12))) for _ in range(800)]
    got = c.id_bytes([s.encode() for s in samples])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(s) for s in samples]
    assert b"".join(tokens.safe_pieces(b"ab cd  ef " * 50, 16)) == b"ab cd  ef " * 50


def test_quality(spark, docs, empty):
    good = [(i, prose(60, 100 + i), 1) for i in range(120)]
    bad = [(1000 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(12, 300 + i + j).split()) for j in range(3)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.learn(rows.drop("quality"), rows.select("doc_id", "quality"))
    got = {r["doc_id"]: r for r in quality.quality_scores(rows, model).collect()}
    held = [r for r in good + bad if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[d]["predicted"] == q for d, _, q in held]) > 0.95
    out = quality.quality_scores(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert quality.quality_scores(empty, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert 0 < quality.keep_good(rows.drop("quality"), model).count() < 180
    nothing = quality.learn(empty, rows.select("doc_id", "quality"))
    assert {r["score"] for r in quality.quality_scores(docs, nothing).collect()} == {0.5}


def test_marginals_are_the_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    first = np.array([0, 3, 4, 9])
    scores, move = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    p, pairs, total = quality.marginals(scores, move, first)
    want, want_pairs, want_total = np.zeros((9, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        paths = {s: np.exp(sum(scores[a + i, x] for i, x in enumerate(s)) + sum(move[x, y] for x, y in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=b - a)}
        z = sum(paths.values())
        want_total += np.log(z)
        for s, w in paths.items():
            for i, x in enumerate(s):
                want[a + i, x] += w / z
            for x, y in zip(s, s[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and total == pytest.approx(want_total)


def test_quality_scores_by_hand(spark):
    """The score from all labellings of a text's lines, weighted by their lengths."""
    import itertools

    rng = np.random.default_rng(6)
    model = quality.Model(rng.normal(size=3 * quality.WIDTH) / 4, rng.normal(size=(2, 2)), 1.3, -0.2)
    texts = ["one line only", "First line here.\nSECOND!! 123\n\nfourth one, longer than the rest of them", "", "a\nb\na\nb\nb b b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_scores(rows, model).collect():
        body = texts[r["doc_id"]].encode()
        x, length, first = quality.line_features(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
        assert len(x) == max(1, len(body.split(b"\n"))) == r["n_lines"]
        s = np.concatenate([x, np.vstack([0 * x[:1], x[:-1]]), np.vstack([x[1:], 0 * x[:1]])], axis=1) @ model.weights
        good, total = np.zeros(len(x)), 0.0
        for path in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(sum((s[i] if y else -s[i]) / 2 for i, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:])))
            good, total = good + w * np.array(path), total + w
        w = np.maximum(length, 1)
        mean = np.clip(w @ (good / total) / w.sum(), 1e-4, 1 - 1e-4)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2))))


def test_language(spark, docs, empty):
    a = [(i, " ".join(random.Random(i).choice(["the", "and", "that", "with", "over"]) for _ in range(40)), "en") for i in range(80)]
    b = [(100 + i, " ".join(random.Random(i).choice(["und", "nicht", "über", "der", "sich"]) for _ in range(40)), "de") for i in range(60)]
    rows = spark.createDataFrame([*a, *b, (500, None, "en"), (501, "über", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.language(rows, language.learn(rows)).collect()}
    assert all(got[d]["lang_pred"] == x for d, _, x in a + b)
    assert (got[500]["lang_pred"], got[500]["score"]) == ("und", 0.0)
    out, text = language.language(docs, language.learn(rows)).collect(), dict(plain(docs))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] is not None and not re.search(r"[^\W\d_]", text[r["doc_id"]] or "")} == {"und"}
    assert {r["lang_pred"] for r in language.language(docs, language.learn(empty)).collect()} == {"und"}


def grams_by_hand(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    out = collections.Counter()
    for w in low.split():
        out.update(w)
        w = f" {w} "
        out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return out


def gram_hash(g):
    value = 0
    for c in g:
        value = value << 21 | (0 if c == " " else ord(c))
    return int(language.mix(np.array([value | (0, 1 << 62, 1 << 63)[len(g) - 1]], np.uint64))[0])


def test_language_is_that_of_the_least_distance_by_hand(spark, docs):
    length = language.LENGTH
    rows = spark.createDataFrame([(1000 + i, prose(80, i) if i % 3 else prose(50, i).replace("o", "ø"), f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    order = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))]
    hashed = lambda t: {gram_hash(g): n for g, n in grams_by_hand(t).items()}
    signed = lambda g: g - (1 << 64) if g >> 63 else g
    profiles = {}
    for lang in ("l0", "l1", "l2"):
        total = collections.Counter()
        for r in rows.collect():
            if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
                total.update(hashed(r["text"]))
        profiles[lang] = order({signed(g): n for g, n in total.items()})[:length]
    got = {r["doc_id"]: r for r in language.language(docs.unionByName(rows, True), language.learn(rows)).collect()}
    for d, t in plain(docs.unionByName(rows, True)):
        own = order(hashed(t or ""))[:length]
        if d is None or not own:
            continue
        away = {x: sum(abs(p.index(signed(g)) - i) if signed(g) in p else length for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[d]["score"] == pytest.approx(1 - away[best] / (length * len(own))) and away[got[d]["lang_pred"]] == away[best]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_grams_are_counted_alike_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(language, "SLICE", size)
    for text in ("", " ", "a", "Ab ab! é", "ß. İx 中文 don't STOP", prose(30, 3)):
        kinds, counts = language.counted(text)
        assert dict(zip(kinds.tolist(), counts.tolist())) == {gram_hash(g): n for g, n in grams_by_hand(text).items()}


def cut_by_hand(rows, w):
    out = collections.Counter()
    starts = collections.defaultdict(set)
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            starts[b[i : i + w]].add(key(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if min(starts[b[i : i + w]]) < key(d):
                gone[i : i + w] = True
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


@pytest.mark.parametrize(("group_bytes", "hot_groups"), [(500, 256), (8 << 20, 256), (500, 1), (2000, 3)])
def test_suffix_dedup(docs, empty, group_bytes, hot_groups):
    got = suffixes.suffix_dedup(docs, group_bytes=group_bytes, bucket_bytes=2000, hot_groups=hot_groups).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == cut_by_hand(plain(docs), suffixes.WINDOW)
    assert suffixes.suffix_dedup(empty).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[300:500] = 97
    s = suffixes.Suffixes(data)
    at = rng.permutation(840)
    group = np.sort(rng.integers(0, 3, 840))
    found = s.sort(at, group)
    for k in range(3):
        got = [data[i : i + 50].tobytes() for i in found[group == k]]
        assert got == sorted(data[i : i + 50].tobytes() for i in at[group == k])


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_packing_is_a_round_trip(docs, empty, size):
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(5)
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for d, t in plain(rows)}
    got = packing.pack(rows, size=size, windows=3, merge=2).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[d]) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[d][4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids[d]) // 4
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in plain(docs))


def edit_distance_in(item, words):
    """Least distance of item to any run of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    word = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in word.findall(t or "")]
    r = random.Random(8)
    items = [(i, prose(n, 500 + i)) for i, n in enumerate((15, 25, 40, 60, 3, 5, 12))] + [(50, None), (51, ""), (52, "a b"), (None, prose(20, 600))]
    rows, n = [], 0
    for rate in (0.0, 0.1, 0.2):
        for _, t in items:
            w = (t or "").split()
            for _ in range(int(len(w) * rate)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((n, prose(30, 700 + n) + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(w)) + " ! " + prose(30, 900 + n)))
            n += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate.contamination(table, bench).collect()}
    want = {}
    for d, t in plain(table):
        for i, item in items:
            w = split(item)
            if w and (e := edit_distance_in(w, split(t))) <= len(w) * 25 // 100:
                want[d, i] = min(e, want.get((d, i), e))
    assert got.keys() <= want.keys() and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.9 * len(want) and {k for k, e in want.items() if e == 0} <= got.keys()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(table, bench.limit(0)).count() == 0
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def leaks_in(built, rows):
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    return decontaminate.in_chunk(built, data, np.cumsum([0, *(len(x.encode()) for x in rows)]))


def test_items_that_begin_a_document_without_their_first_words():
    """A deletion at a document's start moves the copy's place into the document before."""
    found = total = 0
    for seed in range(20):
        r, words = random.Random(seed), [f"w{i}" for i in range(5000)]
        items = [(i, " ".join(r.sample(words, n))) for i, n in enumerate((20, 24, 32, 40, 60))]
        built = decontaminate.build(items, 75)
        for i, t in items:
            k = built.edits(i)
            rows = ["x y z " * 20, "", *(" ".join(t.split()[cut:]) + " " + " ".join(r.sample(words, 30)) for cut in range(1, k + 1))]
            got = leaks_in(built, rows)
            assert {(row, it) for row, it, _ in got} <= {(1 + cut, i) for cut in range(1, k + 1)} and all(d <= row - 1 for row, _, d in got)
            found, total = found + len(got), total + k
    assert found >= 0.95 * total, found / total


@pytest.mark.parametrize("percent", [75, 90, 100])
def test_recall_by_item_length(percent):
    """Of copies with edits of 10, 20 and 25 percent at random places, and the most allowed."""
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 24, 32, 40, 50, 60):
        r, words = random.Random(n), [f"w{i}" for i in range(3000)]
        items = [r.sample(words, n) for _ in range(40)]
        built = decontaminate.build([(i, " ".join(w)) for i, w in enumerate(items)], percent)
        recall = {}
        for k in sorted({0, *(min(n * rate // 100, built.edits(0)) for rate in (10, 20, 25)), built.edits(0)}):
            rows, want = [], {}
            for i, w in enumerate(items):
                for _ in range(5):
                    copy = list(w)
                    for _ in range(k):
                        at, kind = r.randrange(len(copy) + 1), r.randrange(3)
                        copy[at : at + (kind > 0)] = [r.choice(words)] * (kind < 2)
                    text = [*r.sample(words, r.choice((0, 0, 9))), *copy, *r.sample(words, r.choice((0, 0, 9)))]
                    want[len(rows), i] = edit_distance_in(w, text)
                    rows.append(" ".join(text))
            got = {(row, i): e for row, i, e in leaks_in(built, rows)}
            assert all(got[x] >= want.get(x, 0) and got[x] <= built.edits(x[1]) for x in got)
            recall[k] = sum(x in got for x in want) / len(want)
        print(percent, n, {k: round(x, 3) for k, x in recall.items()})
        assert recall[0] == 1 and min(recall.values()) >= 0.95, (n, recall)


def test_edit_distance():
    r = random.Random(3)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randrange(1, 9))], [r.randrange(5) for _ in range(r.randrange(0, 14))]
        assert decontaminate.best_edits(np.array(a), np.array(b, int)) == edit_distance_in(a, b)


def test_substring_dedup(spark, docs, empty):
    got = substrings.substring_dedup(docs).collect()
    assert len(got) == docs.count()
    rows = {r["doc_id"]: r for r in got}
    text = {d: t or "" for d, t in plain(docs)}
    assert rows[0]["n_removed"] == 0 and rows[9]["kept"] == "" and rows[9]["n_bytes_removed"] == rows[9]["n_bytes"]
    passage = prose(60, 99)
    assert rows[12]["n_removed"] == 0 and rows[15]["n_removed"] > 0 and len(rows[15]["kept"]) < len(text[15]) - len(passage) / 2
    assert rows[15]["kept"].split()[:30] == text[15].split()[:30]
    for d in (18, 21, 24, 27, 30, 60):
        assert rows[d]["n_removed"] == 0 and rows[d]["kept"] == text[d]
    assert substrings.substring_dedup(empty).count() == 0
    assert all(r["n_bytes"] - r["n_bytes_removed"] == len(r["kept"].encode()) for r in got)


def test_texts_that_share_a_doc_id_stay_apart(spark):
    a, b = prose(90, 31), ". ".join(prose(9, 900 + i).replace("\n", " ") for i in range(5))
    tables = ([(0, a), (1, "Some other start here now. " + a), (1, "short text.")], [(0, a), (1, a), (1, b), (1, b), (None, a), (None, b)])
    for rows in tables:
        got = collections.defaultdict(list)
        for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            got[r["doc_id"]].append((r["n_bytes"], r["n_bytes_removed"]))
        assert got[0] == [(len(a.encode()), 0)] and len(got[1]) == len([d for d, _ in rows if d == 1])
        left = dict(got[1])
        assert left.get(len(b"short text."), 0) == 0 and left.get(len(b.encode()), 0) == 0
        assert all(gone > n / 2 for n, gone in got[1] if n not in (len(b"short text."), len(b.encode())))
        assert all(gone == n for n, gone in got[None])


def removed_by_hand(rows):
    """(doc_id, n_bytes_removed) of each row: all spans and runs as tuples of words in a dictionary, each first place
    kept, every word of any other place removed with what follows it up to the next word."""
    places, texts = collections.defaultdict(set), {}
    last = float("inf")
    for d, t in rows:
        body = (t or "").encode()
        own = int(F_HASH[t or ""])
        data, offsets = np.frombuffer(body, np.uint8), np.array([0, len(body)])
        starts, first, at, _ = substrings.sentences(data, offsets)
        words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", body)]
        assert len(words) == len(starts)
        spans = []
        for kind, (_, number, lo, hi) in enumerate(substrings.numbered(at, first, substrings.sentences(data, offsets)[3], substrings.SPAN, substrings.MIN_WORDS)):
            spans += [((last if d is None else d, own, int(x)), (kind, *words[a:b]), a, b) for x, a, b in zip(number, lo, hi)]
        texts[d, t] = body, starts, spans
        for place, key, _, _ in spans:
            places[key].add(place)
    out = collections.Counter()
    for d, t in rows:
        body, starts, spans = texts[d, t]
        gone = np.zeros(len(starts) + 1, bool)
        for place, key, a, b in spans:
            if place != min(places[key]):
                gone[a:b] = True
        ends = [*starts[1:], len(body)]
        out[d, sum(int(e - s) for s, e, g in zip(starts, ends, gone) if g)] += 1
    return out


F_HASH = {}


def test_substring_dedup_by_hand(spark, docs):
    r = random.Random(4)
    rows = plain(docs) + [(200 + i, " ".join(prose(12, r.randrange(30)) + r.choice([". ", "\n", " "]) for _ in range(8))) for i in range(40)] + [(201, prose(50, 1)), (None, prose(60, 99))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << substrings.TEXT_BITS))
    F_HASH.update({x["text"] or "": x["own"] for x in table.select("text", own.alias("own")).collect()})
    got = collections.Counter((x["doc_id"], x["n_bytes_removed"]) for x in substrings.substring_dedup(table).collect())
    assert got == removed_by_hand(rows)


def test_passages_of_51_words_are_found_without_marks_and_with_others(spark):
    r, words = random.Random(14), [f"w{i}" for i in range(4000)]
    rows, passages = [], []
    for at in range(40):
        passage, (a, b, c, d, e, f) = r.sample(words, 51), (r.sample(words, k) for k in (at, 40, 17, 40 - at, 40 - at, at))
        ridden = [w + r.choice(["&&&", "%%%", ",", ".", ""]) for w in passage]
        rows += [(3 * at, " ".join(a + passage + b)), (3 * at + 1, " ".join(c + passage + d)), (3 * at + 2, " ".join(e + ridden + f))]
        passages.append(set(passage))
    got = {x["doc_id"]: x for x in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        gone = len(text.split()) - len(got[d]["kept"].split())
        assert (gone == 0) if d % 3 == 0 else (gone >= 10), (d, gone)
    kept = {d: set(re.findall("w[0-9]+", got[d]["kept"])) for d, _ in rows}
    assert sum(len(kept[d] & passages[d // 3]) for d, _ in rows if d % 3) < 0.4 * 51 * 80


def test_license_scan(spark, empty):
    lines = [(i, prose(30, 40 + i)) for i in range(150)]
    known = [(1000 + k, prose(20, k) + "\n" + t + "\nend", f) for k, (f, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
    rows = spark.createDataFrame([*lines, *((d, t) for d, t, _ in known), (5000, None), (5001, ""), (None, "Released under the MIT License.")], "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("paragraph", F.lit(1))
    model = licenses.train(rows)
    found = licenses.license_scan(rows, model)
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in found.collect()}
    right = sum(any(got.get((d, p)) == f for p in range(t.count("\n") + 1)) for d, t, f in known)
    assert right >= 0.9 * len(known)
    assert not [k for k in got if k[0] is not None and k[0] < 1000 and got[k] != "unknown"]
    assert got[None, 0] == "MIT"
    assert licenses.license_scan(empty, model).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_wrapped_licences_are_found(spark):
    lines = [(i, prose(30, 40 + i)) for i in range(150)]
    long = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 80]
    known = [(1000 + 2 * k + (width == 80), f"Code.\n\n# {sep.join(textwrap.wrap(t, width))}\n#\nend", f) for k, (f, t) in enumerate(long) for width, sep in ((40, "\n# "), (80, "\n"))]
    rows = spark.createDataFrame([*lines, *((d, t) for d, t, _ in known)], "doc_id long, text string")
    found = licenses.license_scan(rows, licenses.train(rows)).where("doc_id >= 1000 and confirmed").collect()
    text = {d: t for d, t, _ in known}
    # a short template of the family may stand in one line of the notice
    assert {(r["doc_id"], r["family"]) for r in found} == {(d, f) for d, _, f in known}
    assert all(r["n_lines"] == 1 or (r["paragraph"], r["n_lines"]) == (2, text[r["doc_id"]].count("\n") - 3) for r in found)
    assert any(r["n_lines"] > 1 for r in found)


def test_wording_that_is_no_template(spark):
    lines = [(i, prose(30, 40 + i)) for i in range(200)]
    new = ["The library is distributed under the terms of the MIT license", "this file is available under the Apache License, version 2.0 only", "You can use it under the GNU General Public License (version 3)", "Licensed under the terms of the BSD 3-clause license, see below"]
    odd = ["The licence fee is due in March.", "Copyright law is taught here in spring.", "Their public house is known for its general store."]
    rows = spark.createDataFrame([*lines, *((1000 + i, t) for i, t in enumerate(new)), *((2000 + i, t) for i, t in enumerate(odd))], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses.license_scan(rows, licenses.train(rows.where("doc_id < 1000"))).collect()}
    assert [got.get(1000 + i) for i in range(4)] == ["MIT", "Apache-2.0", "GPL-3.0", "BSD"]
    assert {f for d, f in got.items() if d < 1000 or d >= 2000} <= {"unknown"}


def test_short_forms_and_licences_of_no_family(spark):
    lines = [(i, prose(30, 40 + i)) for i in range(200)]
    short = {
        "SPDX-License-Identifier: MIT": {"MIT"}, "License: MIT": {"MIT"}, "License: GPLv3": {"GPL-3.0"}, "// SPDX-License-Identifier: BSD-3-Clause": {"BSD"}, "license: bsd": {"BSD"},
        "dual licensed under MIT and Apache-2.0": {"MIT", "Apache-2.0"}, "License: CC0": {"CC0"}, "SPDX-License-Identifier: ISC": {"unknown"}, "EUPL-1.2 license": {"unknown"}, "SPDX-License-Identifier: Foo-1.0": {"unknown"},
        "She studied at Harvard or MIT before.": set(), "Your driving license expires": set(),
    }
    rows = spark.createDataFrame([*lines, *((1000 + i, t) for i, t in enumerate(short))], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in licenses.license_scan(rows, licenses.train(rows.where("doc_id < 1000"))).collect():
        got[r["doc_id"]].add(r["family"])
    assert {t: got[1000 + i] - ({"unknown"} if not want else set()) for i, (t, want) in enumerate(short.items())} == short


def scanned_by_hand(rows, model):
    """The rows of license_scan as tuples, line by line and block by block, scores in NumPy."""
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    two = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    having, shapes = collections.defaultdict(set), collections.defaultdict(dict)
    single = [(f[0], name, two(split(t))) for f, name, _, t in licenses.template_rows() if len(f) == 1]
    for f, _, grams in single:
        for g in grams:
            having[g].add(f)
    for f, name, grams in single:
        tells = {g for g in grams if len(having[g]) <= licenses.SHARED}
        if grams:
            shapes[f][name] = tells or grams
    out = []

    def judge(w):
        grams = {*w, *two(w)}
        known = [np.array(model.weights[g]) for g in grams if g in model.weights]
        if not grams & {g for g in grams if " " not in g and g in model.gate} or not known:
            return []
        s = (sum(known) / max(1.0, np.sqrt(len(known))) + np.array(model.weights[""])) / model.temperature
        p = np.round(1 / (1 + np.exp(-s)), 6)
        found = []
        for i, f in enumerate(licenses.FAMILIES):
            if p[i] >= model.threshold:
                sim, _, name = max(((len(g & grams) / len(g), len(g), n) for n, g in shapes[f].items() if g & grams), default=(0.0, 0, None))
                found.append((f, p[i], name, round(sim, 6), sim >= licenses.CONFIRM and f != licenses.UNKNOWN, i == int(np.argmax(s))))
        named = any(x[4] for x in found)
        return [x[:5] for x in found if x[4] or (x[5] and not named)]

    for d, t in rows:
        lines, block = [split(x) for x in (t or "").split("\n")], []
        for i, w in enumerate([*lines, []]):
            if w:
                block.append((i, w))
            elif block:
                single = [(i, 1, x) for i, w in block for x in judge(w)]
                whole = [(block[0][0], len(block), x) for x in judge([y for _, w in block for y in w])] if len(block) > 1 else []
                for f in licenses.FAMILIES:
                    lone, wide = ([y for y in part if y[2][0] == f] for part in (single, whole))
                    use_whole = any(y[2][4] for y in wide) and not any(y[2][4] for y in lone)
                    out += [(d, at, f if x[4] else licenses.UNKNOWN, *x, n) for at, n, x in (wide if use_whole else lone)]
                block = []
    return out


def test_license_scan_by_hand(spark):
    r, rows = random.Random(9), []
    texts = [t for _, _, _, t in licenses.template_rows()]
    for i in range(160):
        parts = [prose(12, i)]
        for _ in range(r.randrange(4)):
            t = r.choice(texts)
            t = " ".join(w for w in t.split() if r.random() > 0.1)
            parts += [r.choice(["", "#", prose(6, i + 500)]), "\n".join(textwrap.wrap(t, r.choice([30, 60, 400])))]
        rows.append((i if i % 40 else None, "\n".join(parts)))
    rows += [(900, None), (901, ""), rows[5], rows[5]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(table)
    key = lambda x: tuple(str(v) for v in x)
    columns = ["doc_id", "paragraph", "family", "predicted", "probability", "template", "similarity", "confirmed", "n_lines"]
    got = sorted((tuple(x[c] for c in columns) for x in licenses.license_scan(table, model).collect()), key=key)
    want = sorted(((*x[:4], float(x[4]), *x[5:]) for x in scanned_by_hand(rows, model)), key=key)
    assert len(got) > 100 and len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[5:] == b[5:] and a[4] == pytest.approx(b[4], abs=2e-6)


def test_fitted_weights_by_hand(spark):
    r, n, k = random.Random(3), 12, len(licenses.FAMILIES)
    examples = [([0, *sorted(r.sample(range(1, n), r.randrange(1, 6)))], float(r.randrange(1, 9)), [float(r.random() < 0.2) for _ in range(k)]) for _ in range(30)]
    table = spark.createDataFrame([(examples,)], "ex array<struct<grams:array<int>,m:double,y:array<double>>>")
    got = np.array(table.select(licenses.fitted(n).alias("w")).first()["w"])
    x = np.zeros((len(examples), n))
    for i, (grams, _, _) in enumerate(examples):
        x[i, grams] = 1 / max(1.0, np.sqrt(len(grams) - 1))
        x[i, 0] = 1.0
    m, y = np.array([e[1] for e in examples])[:, None], np.array([e[2] for e in examples])
    w, q = np.zeros((n, k)), np.full((n, k), 1e-6)
    for _ in range(licenses.STEPS):
        g = x.T @ (m * (y - 1 / (1 + np.exp(-x @ w))))
        q += g * g
        w += licenses.RATE * g / np.sqrt(q)
    assert np.allclose(got, w, atol=1e-6)


@pytest.mark.parametrize("bucket_bytes", [400, 32 << 20])
def test_exact_dedup(docs, empty, bucket_bytes):
    rows = docs.select("doc_id", "text")
    got = exact_dedup.exact_dedup(rows.repartition(7), bucket_bytes).collect()
    groups = collections.defaultdict(list)
    for d, t in plain(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    want = collections.Counter()
    for body, members in groups.items():
        best = min(members)
        for m in members:
            want[m[3], best[3], len(members), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0
    stay = exact_dedup.keep_exact(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_buckets_are_cut_until_they_fit(spark):
    """One content in most rows of many partitions, and large distinct texts, with buckets of 4 KB."""
    hot, r = prose(40, 1), random.Random(3)
    rows = [(i, hot.replace(" ", " " * r.randrange(1, 3)) if i % 3 else prose(60 + i % 90, i)) for i in range(900)] + [(1000 + i, "x" * 9000 + str(i // 2)) for i in range(12)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(60), 4096).collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"\s", "", t)].append((-len(t), d))
    want = {(d, min(m)[1], len(m)) for m in groups.values() for _, d in m}
    assert {(x["doc_id"], x["keep_id"], x["group_size"]) for x in got} == want and len(got) == len(rows)


def test_open_table_compares_contents():
    t = exact_dedup.OpenTable(4)
    assert [t.place(7, b"a"), t.place(7, b"b"), t.place(7, b"a"), t.place(3, b"c"), t.place(11, b"d"), t.place(7, b"b")] == [0, 1, 0, 2, 3, 1]


def components_by_hand(rows):
    word, sets = re.compile(r"[^\x20\x09-\x0D]+"), []
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = word.findall(low)
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("dense", [0, 12])
def test_near_duplicates(spark, docs, empty, monkeypatch, dense):
    base = prose(150, 42).split()
    rows = plain(docs.where("doc_id is not null"))
    for i in range(60):  # one dense group of near copies, some too far from the others
        r = random.Random(i)
        w = list(base)
        for _ in range(1 + i % 9):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((1000 + i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("region", F.lit("clash"))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", 9)
    if dense:
        monkeypatch.setattr(near_dedup, "DENSE", dense)
    got = near_dedup.near_duplicates(table).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    lone = [r for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"] is None]
    assert len(lone) == 2 and all(r["component_id"] is None and r["kept"] for r in lone)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_hot_regions_are_cut(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 8)
    base = prose(100, 77).split()
    rows = [(i, " ".join(w if j != i else "zzz" for j, w in enumerate(base))) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, c) for d, _, c in components_by_hand(rows)}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", 3)
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = chain + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(7, 7), (900, 901), (901, 900)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    random.Random(2).shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {(x["id"], x["component"]) for x in got} == {(x, find(x)) for x in parent} and len(got) == len(parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registry():
    assert sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)", n)[1])) and {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 11)}
    assert ORACLE_SQL.keys() <= QUERIES.keys()


def test_stages_judge_rows_with_null_and_shared_ids(spark):
    bad = "\n".join("#### WORD!! %% " * 3 for _ in range(3))
    item, a, b = prose(30, 400), prose(70, 401), prose(70, 402)
    near = a.replace(a.split()[20], "other", 1)
    rows = [(i, prose(60, 100 + i)) for i in range(100, 160)] + [(i, bad) for i in range(200, 240)]
    rows += [(None, prose(20, 403) + " " + item), (1, prose(20, 404) + " " + item), (1, prose(50, 405)), (2, a), (2, near), (None, near + " more"), (None, b), (3, b), (None, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = lambda x: collections.Counter(map(tuple, x.select("doc_id", "text").collect()))
    every = kept(docs)
    labels = docs.where("doc_id >= 100").selectExpr("doc_id", "int(doc_id < 200) as quality")
    model = quality.learn(docs, labels)
    good = kept(quality.keep_good(docs, model))
    assert good <= every and (201, bad) not in good and (1, rows[-8][1]) in good
    once = kept(exact_dedup.keep_exact(docs))
    assert once[3, b] == 1 and (None, b) not in once and once[None, None] + once[4, ""] == 1 and sum(n for (_, t), n in once.items() if t == bad) == 1
    near_left = kept(near_dedup.keep_near(docs))
    assert sum(near_left[x] for x in ((2, a), (2, near), (None, near + " more"))) == 1
    assert near_left[None, None] == near_left[4, ""] == 1 and sum(n for (_, t), n in near_left.items() if t == b) == 1
    clean = kept(decontaminate.keep_clean(docs, spark.createDataFrame([(0, item), (None, None)], "item_id long, text string")))
    assert every - clean == collections.Counter({x: 1 for x in rows[100:102]})


def test_long_texts(spark):
    """Each operator on a text of more than 2 MB and its copy, whole."""
    long = " ".join(prose(1000, 5000 + i) for i in range(400))
    assert len(long) > 2 << 20
    rows = spark.createDataFrame([(0, long), (1, long + " tail words of the second"), (2, prose(50, 1)), (3, long[: 1 << 20])], "doc_id long, text string").repartition(2)
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    n = len(tok.encode(long, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(rows).collect()}[0] == n
    assert packing.pack(rows).where("doc_id = 0").agg(F.sum("length")).first()[0] == n + 1
    labels = spark.createDataFrame([(2, 1), (0, 0)], "doc_id long, quality int")
    assert quality.quality_scores(rows, quality.learn(rows, labels)).count() == 4
    known = rows.withColumn("lang", F.lit("x"))
    assert {r["lang_pred"] for r in language.language(rows, language.learn(known)).collect()} == {"x"}
    cut = {r["doc_id"]: r for r in suffixes.suffix_dedup(rows).collect()}
    assert (cut[0]["n_removed"], cut[1]["n_removed"], cut[3]["n_removed"]) == (0, len(long.encode()), len(long[: 1 << 20].encode()))
    item = " ".join(long.split()[150_000:150_040])
    leaks = decontaminate.contamination(rows, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["edits"]) for r in leaks} == {(0, 0), (1, 0)}
    kept = {r["doc_id"]: r for r in substrings.substring_dedup(rows).collect()}
    assert kept[1]["n_bytes_removed"] > 0.99 * len(long) and kept[3]["n_bytes_removed"] > 0.99 * (1 << 20)
    scan = rows.unionByName(spark.createDataFrame([(9, long + "\nReleased under the MIT License.\n" + long)], "doc_id long, text string"))
    assert (9, "MIT") in {(r["doc_id"], r["family"]) for r in licenses.license_scan(scan, licenses.train(rows)).collect()}
    same = exact_dedup.exact_dedup(rows.unionByName(rows.where("doc_id = 0").withColumn("doc_id", F.lit(5).cast("long")))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in same} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 0}
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("row", "part", "id", "grp", "at", "gone", "kept").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, prose(200, 7))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = left.columns, [left.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == columns
        sizes.append(left.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}
